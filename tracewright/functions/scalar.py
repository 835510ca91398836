"""Column functions: addresses, versions, scores, text and byte recipes. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value, which is evaluated once however often f uses it, and whose expression doesn't grow with that."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ip4(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one, or has a part with a zero before it."""
    parts = F.split(ip, r"\.")
    n = [F.element_at(parts, k + 1).try_cast("long") for k in range(4)]
    ok = ip.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & (F.greatest(*n) <= 255)
    return F.when(ok, n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def ip4_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an IPv4 address lies in a block such as 10.0.0.0/8, or equals an address."""
    base, _, size = cidr.partition("/")
    size = int(size or 32)
    number = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
    return F.shiftright(ip4(ip), 32 - size) == number >> (32 - size)


def in_scope(ip: Column, blocks: list[str]) -> Column:
    """Whether an address lies in any of the blocks; no blocks mean the local host alone."""
    out = F.lit(False)
    for b in blocks or ["127.0.0.1"]:
        out = out | F.coalesce(in_cidr(ip, b), F.lit(False))
    return out


def semver_key(version: Column) -> Column:
    """A struct that orders as semantic versions do; null if it isn't one."""
    p = r"^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:\.\d+)*(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    number = [F.coalesce(F.regexp_extract(version, p, k).try_cast("long"), F.lit(0)) for k in (1, 2, 3)]
    pre = F.regexp_extract(version, p, 4)
    labels = F.transform(F.split(pre, r"\."), lambda x: F.struct((~x.rlike(r"^\d+$")).alias("is_text"), F.coalesce(F.when(x.rlike(r"^\d+$"), x.try_cast("long")), F.lit(0)).alias("n"), x.alias("t")))
    return F.when(version.rlike(p), F.struct(*(n.alias(f"n{k}") for k, n in enumerate(number)), (pre == "").alias("release"), labels.alias("labels")))


def windows_key(version: Column) -> Column:
    """A struct that orders Windows versions; two parts mean 10.0.build.ubr."""
    p = F.split(version, r"\.")
    n = F.size(p)
    get = lambda k: F.coalesce(F.get(p, F.lit(k)).try_cast("long"), F.lit(0))
    return F.when(version.rlike(r"^\d+(\.\d+)*$"), F.when(n == 2, F.struct(F.lit(10).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), get(0).alias("c"), get(1).alias("d"))).otherwise(F.struct(get(0).alias("a"), get(1).alias("b"), get(2).alias("c"), get(3).alias("d"))))


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS 3.x vector; null if a metric is missing or unknown. Weights are the standard's fixed values.

    The vector is split once, and each step of the score is evaluated once, from the values of the step before.
    """
    return bound(F.str_to_map(F.regexp_replace(vector, r"^CVSS:3\.[01]/", ""), F.lit("/"), F.lit(":")), lambda m: bound(_weights(m), lambda w: bound(_impact(w), lambda x: bound(_total(x), _rounded_up))))


def _weights(m: Column) -> Column:
    def pick(name: str, values: dict[str, float]) -> Column:
        def of(metric: Column) -> Column:
            out = F.lit(None).cast("double")
            for k, v in values.items():
                out = F.when(metric == k, v).otherwise(out)
            return out

        return bound(F.try_element_at(m, F.lit(name)), of)

    scope = F.try_element_at(m, F.lit("S"))
    changed = scope == "C"
    pr = F.when(changed, pick("PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(pick("PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    c, i, a = (pick(x, {"H": 0.56, "L": 0.22, "N": 0.0}) for x in "CIA")
    av, ac, ui = pick("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}), pick("AC", {"L": 0.77, "H": 0.44}), pick("UI", {"N": 0.85, "R": 0.62})
    return F.struct(changed.alias("changed"), scope.isin("U", "C").alias("known"), (1 - (1 - c) * (1 - i) * (1 - a)).alias("base"), (8.22 * av * ac * pr * ui).alias("exploit"))


def _impact(w: Column) -> Column:
    impact = F.when(w["changed"], 7.52 * (w["base"] - 0.029) - 3.25 * F.pow(w["base"] - 0.02, F.lit(15.0))).otherwise(6.42 * w["base"])
    return F.struct(w["changed"].alias("changed"), w["known"].alias("known"), w["exploit"].alias("exploit"), impact.alias("impact"))


def _total(x: Column) -> Column:
    total = F.least(F.when(x["changed"], 1.08).otherwise(1.0) * (x["impact"] + x["exploit"]), F.lit(10.0))
    # up to one decimal, on integers; least leaves a null out
    there = x["impact"].isNotNull() & x["exploit"].isNotNull()
    return F.struct((x["known"] & there).alias("known"), x["impact"].alias("impact"), F.round(total * 100000).cast("long").alias("whole"))


def _rounded_up(x: Column) -> Column:
    whole = x["whole"]
    up = F.when(whole % 10000 == 0, whole / 100000).otherwise((F.floor(whole / 10000) + 1) / 10)
    return F.when(x["known"], F.when(x["impact"] <= 0, 0.0).otherwise(up))


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").when(score == 0, "None").otherwise("Unknown")


def risk(base: Column, exposure: Column, criticality: Column, patched: Column, kev: Column, epss: Column) -> Column:
    """Contextual risk: weighted base, raised by known exploitation and its likelihood, 10 at most, one decimal."""
    return F.round(F.least(F.lit(10.0), base * exposure * criticality * F.when(patched, 0.1).otherwise(1.0) + F.when(kev, 2.5).otherwise(0.0) + epss * 2), 1)


def words_of_identifier(name: Column) -> Column:
    """Lower-case words of a camel, snake or kebab name."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda w: w != "")


def shorten(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def strip_html(page: Column) -> Column:
    """Text without tags, five entities decoded, white space collapsed."""
    out = F.regexp_replace(page, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))


PLAIN = "abcdefghijklmnopqrstuvwxyz"


def rot13(text: Column) -> Column:
    turned = PLAIN[13:] + PLAIN[:13]
    return F.translate(text, PLAIN + PLAIN.upper(), turned + turned.upper())


def package_name(name: Column, ecosystem: str) -> Column:
    """A package's name as its ecosystem compares it."""
    if ecosystem == "PyPI":
        return F.regexp_replace(F.lower(name), "[-_.]+", "-")
    return F.lower(name) if ecosystem in ("NuGet", "Packagist") else name
