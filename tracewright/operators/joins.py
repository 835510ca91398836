"""Joins in time, by ranges, by lookup tables, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is known to have at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, window: int) -> DataFrame:
    """Pairs of equal keys whose times lie within window seconds, whole seconds after truncation toward zero, inclusive.

    Each left row is met in at most three time buckets, so a hot key is spread over its time range. Null times match nothing.
    """
    width = (window + 1) * 1_000_000
    a = left.withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(seconds(F.col(at)) / width) + d)))
    b = right.withColumn("_b", F.floor(seconds(F.col(other)) / width))
    apart = F.abs(F.expr(f"(unix_micros(cast({at} as timestamp)) - unix_micros(cast({other} as timestamp))) div 1000000"))
    return a.join(b, [*keys, "_b"]).where(apart <= window).drop("_b")


def first_match(pairs: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """For each key, the columns of keep from the first pair by order; combined before the shuffle."""
    first = pairs.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in keep if c not in order))).alias("_f"))
    return first.select(*keys, *(F.col(f"_f.{c}").alias(c) for c in keep))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high) of ranges with equal keys, by buckets of width; an open end is null and is met without a bucket."""
    closed = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) < F.col(high)))
    bucketed = closed.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    met = points.withColumn("_b", F.floor(F.col(value) / width)).join(bucketed, [*keys, "_b"]).where(inside).drop("_b")
    opened = ranges.where(F.col(low).isNull() | F.col(high).isNull())
    open_inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return met.unionByName(points.join(opened, keys).where(open_inside).select(*met.columns))


def lookup_last(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key and the value of its last row by order (last one wins)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def attribute(facts: DataFrame, lookup: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """facts with value looked up by key; unmatched rows stay, with default."""
    out = facts.join(lookup.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of updates, and those of base whose keys updates lacks."""
    return base.join(updates.select(*keys), keys, "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def merge_fields(base: DataFrame, updates: DataFrame, keys: list[str], largest: tuple[str, ...] = ()) -> DataFrame:
    """base and updates by key, with each field of the update unless null, and the larger value of fields in largest."""
    fields = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in fields))
    u = updates.select(*keys, *(F.col(c).alias(f"_u_{c}") for c in fields))
    pick = [(F.greatest(f"_b_{c}", f"_u_{c}") if c in largest else F.coalesce(f"_u_{c}", f"_b_{c}")).alias(c) for c in fields]
    return b.join(u, keys, "full").select(*keys, *pick)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base, and the rows of new whose keys it lacks."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def replace_partition(base: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """base without the partitions of column that new has, and new."""
    return base.join(new.select(column).distinct(), column, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))
