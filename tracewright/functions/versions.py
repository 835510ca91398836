"""Keys that order versions as package managers do. All run in the JVM and are null where a version isn't one.

A key is compared by Spark's own order of structs and arrays, so that sorting, minima and range joins need no comparator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import semver_key, windows_key

#: Marks that sort before letters: a tilde, and the end of a part.
TILDE, END, OTHER = "\x01", "\x02", "\x7f"


def _number(digits: Column) -> Column:
    """Digits of any length in the order of numbers: their count, then themselves, without leading zeros."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.length(bare).alias("size"), bare.alias("digits"))


def _after(version: Column, mark: str, default: str) -> Column:
    """What stands behind the last mark, or default."""
    return F.when(version.contains(mark), F.substring_index(version, mark, -1)).otherwise(default)


def debian_key(version: Column) -> Column:
    """Debian's order: epoch, upstream version and revision; a tilde sorts before everything, the end included."""
    v = F.trim(version)
    epoch = F.when(v.rlike(r"^\d+:"), F.substring_index(v, ":", 1)).otherwise("0").try_cast("long")
    rest = F.regexp_replace(v, r"^\d+:", "")
    upstream = F.when(rest.contains("-"), F.regexp_replace(rest, "-[^-]*$", "")).otherwise(rest)

    def parts(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"([^0-9]+[0-9]*|[0-9]+)"), F.lit(1))
        one = lambda p: F.struct(F.concat(F.translate(F.regexp_replace(F.regexp_replace(p, "[0-9]+$", ""), "([^A-Za-z~])", OTHER + "$1"), "~", TILDE), F.lit(END)).alias("t"), _number(F.regexp_extract(p, "([0-9]*)$", 1)).alias("n"))
        # zeros at the end are as good as none
        whole = F.transform(found, one)
        last = F.struct(F.lit(END).alias("t"), _number(F.lit("")).alias("n"))
        return F.when(text.rlike("^0*$"), F.array(last)).otherwise(F.concat(whole, F.array(last)))

    return F.when(v != "", F.struct(epoch.alias("epoch"), parts(upstream).alias("upstream"), parts(_after(rest, "-", "0")).alias("revision")))


def rpm_key(version: Column) -> Column:
    """RPM's order: epoch, version and release; numbers sort after letters, a tilde first, a caret after the end."""
    v = F.trim(version)
    epoch = F.when(v.rlike(r"^\d+:"), F.substring_index(v, ":", 1)).otherwise("0").try_cast("long")
    rest = F.regexp_replace(v, r"^\d+:", "")

    def parts(text: Column) -> Column:
        none = _number(F.lit(""))
        one = lambda p: F.struct(
            F.when(p == "~", 0).when(p == "^", 2).when(p.rlike("^[0-9]"), 4).otherwise(3).alias("kind"),
            F.when(p.rlike("^[A-Za-z]"), p).otherwise("").alias("t"), F.when(p.rlike("^[0-9]"), _number(p)).otherwise(none).alias("n"),
        )
        found = F.regexp_extract_all(text, F.lit(r"([0-9]+|[A-Za-z]+|~|\^)"), F.lit(1))
        return F.concat(F.transform(found, one), F.array(F.struct(F.lit(1).alias("kind"), F.lit("").alias("t"), none.alias("n"))))

    version_part = F.when(rest.contains("-"), F.regexp_replace(rest, "-[^-]*$", "")).otherwise(rest)
    return F.when(v != "", F.struct(epoch.alias("epoch"), parts(version_part).alias("version"), parts(_after(rest, "-", "")).alias("release")))


PEP440 = r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?(\d*))?((?:-\d+)|(?:[-_.]?(?:post|rev|r)[-_.]?\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+[a-z0-9._-]+)?$"


def python_key(version: Column) -> Column:
    """Python's order: development, alpha, beta, candidate, final, post releases; local labels don't count."""
    v = F.lower(F.trim(version))
    g = lambda k: F.regexp_extract(v, PEP440, k)
    release = F.transform(F.split(F.regexp_replace(g(2), r"(\.0+)+$", ""), r"\."), _number)
    stage = F.when(g(3).isin("a", "alpha"), 0).when(g(3).isin("b", "beta"), 1).when(g(3) != "", 2)
    is_post, is_dev = g(5) != "", g(6) == "dev"
    pre = F.coalesce(stage, F.when(is_dev & ~is_post, -1).otherwise(3))
    post = F.when(is_post, F.coalesce(F.regexp_extract(g(5), r"(\d*)$", 1).try_cast("long"), F.lit(0))).otherwise(-1)
    key = F.struct(
        F.coalesce(g(1).try_cast("long"), F.lit(0)).alias("epoch"), release.alias("release"), pre.alias("stage"), F.coalesce(g(4).try_cast("long"), F.lit(0)).alias("number"),
        post.alias("post"), (~is_dev).alias("final"), F.coalesce(g(7).try_cast("long"), F.lit(0)).alias("dev"),
    )
    # most versions are numbers alone, for which the parts needn't be looked for one by one
    zero = F.lit(0).cast("long")
    plain = F.struct(zero.alias("epoch"), F.transform(F.split(F.regexp_replace(v, r"(\.0+)+$", ""), r"\."), _number).alias("release"), F.lit(3).alias("stage"), zero.alias("number"), F.lit(-1).cast("long").alias("post"), F.lit(True).alias("final"), zero.alias("dev"))
    return F.when(v.rlike(r"^\d+(?:\.\d+)*$"), plain).when(v.rlike(PEP440), key)


def _by_parts(text: Column, ranks: dict[str, int], end: int, other: int, number: int) -> Column:
    """Numbers and words of a version in order, each with a rank; end is that of where a version stops, so that words below it come before a release and numbers behind it."""
    none = _number(F.lit(""))

    def one(part: Column) -> Column:
        digits = part.rlike("^[0-9]")
        rank = F.lit(other)
        for name, r in ranks.items():
            rank = F.when(part == name, r).otherwise(rank)
        text_too = F.when(digits | part.isin(*ranks), "").otherwise(part)
        return F.struct(F.when(digits, number).otherwise(rank).alias("rank"), F.when(digits, _number(part)).otherwise(none).alias("n"), text_too.alias("t"))

    # zeros at the end of a row of numbers are as good as none
    bare = F.regexp_replace(text, r"([.-]0+)+(?=$|[.-]?[a-z+])", "")
    found = F.regexp_extract_all(bare, F.lit("([0-9]+|[a-z]+)"), F.lit(1))
    return F.concat(F.transform(found, one), F.array(F.struct(F.lit(end).alias("rank"), none.alias("n"), F.lit("").alias("t"))))


#: Words of versions in the order in which Maven and Composer sort them.
MAVEN = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "milestone": 2, "m": 2, "rc": 3, "cr": 3, "snapshot": 4, "ga": 5, "final": 5, "release": 5, "sp": 6}
COMPOSER = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "rc": 3, "patch": 6, "pl": 6, "p": 6}


def maven_key(version: Column) -> Column:
    """Maven's order: alpha, beta, milestone, candidate, snapshot, release, service pack, other words, numbers."""
    v = F.lower(F.trim(version))
    plain = F.regexp_replace(v, "[.-]?(ga|final|release)$", "")
    return F.when(v.rlike("^[0-9a-z]"), _by_parts(plain, MAVEN, 5, 7, 8))


def composer_key(version: Column) -> Column:
    """Composer's order: development, alpha, beta, candidate, stable, patch; a leading v and build marks don't count."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(version)), r"\+.*$", ""), "^v(?=[0-9])", "")
    return F.when(v.rlike("^[0-9]"), _by_parts(F.regexp_replace(v, "[-_.]?stable$", ""), COMPOSER, 5, 0, 8))


def gem_key(version: Column) -> Column:
    """RubyGems' order: a part with letters makes a version an earlier one, further numbers a later one."""
    v = F.lower(F.trim(version))
    return F.when(v.rlike(r"^[0-9]+(\.[0-9a-z]+)*(-[0-9a-z.-]+)?$"), _by_parts(F.regexp_replace(v, "-", ".pre."), {}, 1, 0, 2))


def nuget_key(version: Column) -> Column:
    """NuGet's order: up to four numbers, then labels as semantic versions have them, without regard to case."""
    v = F.regexp_replace(F.lower(F.trim(version)), r"\+.*$", "")
    fourth = F.coalesce(F.regexp_extract(v, r"^v?\d+\.\d+\.\d+\.(\d+)", 1).try_cast("long"), F.lit(0))
    own = semver_key(v)
    return F.when(own.isNotNull(), F.struct(own["n0"].alias("n0"), own["n1"].alias("n1"), own["n2"].alias("n2"), fourth.alias("n3"), own["release"].alias("release"), own["labels"].alias("labels")))


#: The order of each ecosystem; others are ordered as semantic versions.
KEYS = {"Debian": debian_key, "Ubuntu": debian_key, "Red Hat": rpm_key, "AlmaLinux": rpm_key, "Rocky Linux": rpm_key, "SUSE": rpm_key, "PyPI": python_key, "Maven": maven_key, "Packagist": composer_key, "RubyGems": gem_key, "NuGet": nuget_key, "Windows": windows_key}


def key(version: Column, ecosystem: str) -> Column:
    """The key of an ecosystem, named as in advisories; a release behind a colon doesn't matter."""
    return KEYS.get(ecosystem.partition(":")[0], semver_key)(version)


def affected(version: Column, introduced: Column, fixed: Column, last: Column, ecosystem: str) -> Column:
    """Whether introduced <= version < fixed and version <= last. Null ends and an introduced of 0 are open; null if version has no order."""
    by = lambda c: key(c, ecosystem)
    return affected_by_keys(by(version), introduced, by(introduced), fixed, by(fixed), last, by(last))


def affected_by_keys(own: Column, introduced: Column, low: Column, fixed: Column, high: Column, last: Column, end: Column) -> Column:
    """As affected, with the keys of the version and of each end."""
    above = introduced.isNull() | (introduced == "0") | F.coalesce(own >= low, F.lit(False))
    below = (fixed.isNull() | F.coalesce(own < high, F.lit(False))) & (last.isNull() | F.coalesce(own <= end, F.lit(False)))
    return F.when(own.isNotNull(), above & below)
