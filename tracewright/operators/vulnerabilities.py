"""Packages against advisories: intervals, matches, fixes, ratings and their order.

All are equi-joins on package names or ids with a filter on version keys behind them; nothing compares all pairs. A package or
advisory without a name, version or id matches nothing. Versions that have no order are affected by no interval with bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import versions
from .facts import severity_rank
from .graph import components

#: What distributions put before the id of a vulnerability.
PREFIXES = ("", "UBUNTU-", "DEBIAN-")
#: Parts that the packages of a name are spread over.
SALT = 16


def intervals(events: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """keys, introduced, fixed and last_affected of each interval that the events of a range open.

    An interval ends at the event behind the one that opens it, if that closes; else it stays open. 0 opens at the start.
    """
    by = Window.partitionBy(*keys).orderBy(step)
    own = events.where("introduced IS NOT NULL OR fixed IS NOT NULL OR last_affected IS NOT NULL")
    closes = F.lead("introduced").over(by).isNull()
    fixed = F.when(closes, F.lead("fixed").over(by))
    out = own.select(*keys, "introduced", fixed.alias("fixed"), F.when(closes & fixed.isNull(), F.lead("last_affected").over(by)).alias("last_affected")).where("introduced IS NOT NULL")
    return out.withColumn("introduced", F.when(F.col("introduced") != "0", F.col("introduced")))


def hits(packages: DataFrame, ranges: DataFrame, ecosystem: str, salt: int = SALT) -> DataFrame:
    """Packages (name, version and others) with the intervals of their name that their version lies in.

    ranges has id, name, introduced, fixed, last_affected and may have versions, a list of exact ones. A name may hold a
    third of all packages: they are spread over salt parts, and ranges, far fewer, are repeated for each.
    """
    key = lambda c: versions.key(F.col(c), ecosystem)
    spread = packages.withColumn("_p", F.pmod(F.xxhash64(*packages.columns), F.lit(salt)).cast("int")).withColumn("_own", key("version"))
    # a key for each version and each end of a range, before they meet
    keyed = ranges.withColumns({"_low": key("introduced"), "_high": key("fixed"), "_last": key("last_affected")})
    repeated = keyed.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = spread.join(repeated, ["name", "_p"])
    inside = versions.affected_by_keys(*map(F.col, ("_own", "introduced", "_low", "fixed", "_high", "last_affected", "_last")))
    listed = F.array_contains("versions", F.col("version")) if "versions" in ranges.columns else F.lit(False)
    return met.where(F.coalesce(inside, F.lit(False)) | F.coalesce(listed, F.lit(False))).drop("_p", "_own", "_low", "_high", "_last")


def first_fix(found: DataFrame, keys: list[str], ecosystem: str) -> DataFrame:
    """For keys, the smallest fixed version above the installed one; null where there is none."""
    own, fix = versions.key(F.col("version"), ecosystem), versions.key(F.col("fixed"), ecosystem)
    return found.groupBy(*keys).agg(F.min_by("fixed", F.when(fix > own, fix)).alias("fix"))


def upgrade_target(fixes: DataFrame, keys: list[str], ecosystem: str) -> DataFrame:
    """For keys, the largest of the fixes, with which all are fixed; null if one has no fix."""
    return fixes.groupBy(*keys).agg(F.when(F.count("*") == F.count("fix"), F.max_by("fix", versions.key(F.col("fix"), ecosystem))).alias("target"))


def largest(versions_: Column, ecosystem: str) -> Column:
    """The largest of an array of versions, and of equal ones the last as texts; null if none is a version of the ecosystem."""
    ordered = F.transform(versions_, lambda v: F.struct(versions.key(v, ecosystem).alias("key"), v.alias("version")))
    return F.array_max(F.filter(ordered, lambda x: x["key"].isNotNull()))["version"]


def own_record_first(found: DataFrame, records: DataFrame, package: list[str]) -> DataFrame:
    """found (package, id, cve) without advisories of a CVE that has a record of its own for the package which didn't match.

    records has the same columns for all records, matched or not; a record is a CVE's own where its id is the CVE.
    """
    own = records.where("id = cve").select(*package, "cve").distinct()
    matched = found.where("id = cve").select(*package, "cve").distinct()
    missed = own.join(matched, [*package, "cve"], "left_anti")
    return found.join(missed, [*package, "cve"], "left_anti").select(*found.columns)


def enrich(found: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """found with column of values (id and column) for its id, or for it with a distribution's prefix, the first that has one."""
    ids = found.select("id").distinct().select("id", F.posexplode(F.array(*(F.concat(F.lit(p), "id") for p in PREFIXES))).alias("place", "key"))
    best = ids.join(values.select(F.col("id").alias("key"), column).where(F.col(column).isNotNull()), "key").groupBy("id").agg(F.min_by(column, F.struct("place", column)).alias(column))
    return found.join(best, "id", "left")


def merged_advisories(aliases: DataFrame) -> DataFrame:
    """id and advisory, the smallest id of those that name one another or share a name, from rows of id and alias."""
    return components(aliases.where("id IS NOT NULL").select(F.col("id").alias("src"), F.coalesce("alias", "id").alias("dst"))).select("id", F.col("component").alias("advisory"))


def updated(required: Column, installed: Column, superseding: Column) -> Column:
    """Whether a required update, or one that supersedes it, is among the installed ones."""
    return F.coalesce(F.array_contains(installed, required), F.lit(False)) | F.coalesce(F.arrays_overlap(installed, superseding), F.lit(False))


def order() -> list[Column]:
    """What findings are sorted by: exploited ones, severity, score, likelihood, component, id."""
    return [F.coalesce("kev", F.lit(False)).desc(), severity_rank(F.col("severity")).desc(), F.coalesce("cvss", F.lit(-1.0)).desc(), F.coalesce("epss", F.lit(-1.0)).desc(), F.asc("name"), F.asc("id")]


def summary(found: DataFrame) -> DataFrame:
    """One row: findings by severity, known exploited ones, those without a fix, and the largest score."""
    levels = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")]
    return found.agg(F.count("*").alias("findings"), *levels, F.count_if("kev").alias("exploited"), F.count_if(F.col("fix").isNull()).alias("unfixed"), F.max("cvss").alias("top"))
