"""Facts: rules as data, the keyed fold with its ladder, evidence, scores and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of severities, lowest first.
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Rule:
    """A predicate on observations, and what it makes of those that fulfil it."""

    name: str
    when: Column
    key: Column
    fact_type: str
    confidence: float
    severity: str
    risk: float
    #: Rules of one group exclude each other; the first that holds counts.
    group: str = ""


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0))


def candidates(observations: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each observation and rule that holds for it, in one pass."""
    taken: dict[str, Column] = {}
    hits = []
    for r in rules:
        when = F.coalesce(r.when, F.lit(False))
        if r.group:
            before = taken.get(r.group, F.lit(False))
            taken[r.group] = before | when
            when = when & ~before
        hit = F.struct(F.lit(r.name).alias("rule"), r.key.cast("string").alias("entity_key"), F.lit(r.fact_type).alias("fact_type"), F.lit(r.confidence).alias("confidence"), F.lit(r.severity).alias("severity"), F.lit(r.risk).alias("risk"))
        hits.append(F.when(when, hit))
    return observations.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(*observations.columns, "_h.*")


def ladder(n: Column) -> Column:
    """State of a fact with n distinct pieces of evidence."""
    return F.when(n >= 3, "Confirmed").when(n == 2, "Corroborated").otherwise("Candidate")


def saturate(start: Column, n: Column, second: float, further: float) -> Column:
    """start, raised by the second piece of evidence and each further one, up to 1."""
    return F.least(F.lit(1.0), start + F.when(n >= 2, second).otherwise(0.0) + F.greatest(n - 2, F.lit(0)) * further)


def keyed_fold(found: DataFrame, keys: list[str], evidence: str, at: str, start: Column, payload: str) -> DataFrame:
    """One fact a key: number of distinct evidence, state, confidence, first sighting and its payload."""
    own = found.groupBy(*keys).agg(F.countDistinct(evidence).alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min_by(payload, F.struct(at, evidence)).alias("payload"))
    return own.select(*keys, "n", ladder(F.col("n")).alias("state"), F.round(saturate(start, F.col("n"), 0.08, 0.1), 6).alias("confidence"), "first_seen", "last_seen", "payload")


def band(score: Column) -> Column:
    """Risk level of a host's largest score."""
    return F.when(score >= 80, "Critical").when(score >= 50, "High").when(score >= 20, "Medium").otherwise("Low")


def merge_assets(rows: DataFrame, key: str, order: list[str], first: list[str], lists: list[str]) -> DataFrame:
    """One asset a key: the first non-null value of some fields by order, the sorted distinct values of others."""
    rank = F.struct(*order)
    return rows.groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in first), *(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in lists))
