"""Functions of names, identifiers, paths and documents. All run in the JVM but for canonical JSON, which has to sort members at any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalar import bound, ip4, ip4_text

#: Severities that a summary may begin with, Windows systems, and marks of a processor in product names.
SEVERITIES = ("Critical", "Important", "Moderate", "Low")
WINDOWS = ("10", "11", "server", "7", "8.1", "rt", "vista")
PROCESSORS = r"(?i) (\(x64\)|\(x86\)|64-bit|32-bit)"


def product_key(name: Column) -> Column:
    """A product's name in lower case, with one space for any white space."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def cve_of(identifier: Column) -> Column:
    """The CVE that an identifier is or ends with; null if it has none."""
    found = F.regexp_extract(identifier, r"(?:^|-)(CVE-\d{4}-\d+)$", 1)
    return F.when(found != "", found)


def severity_prefix(summary: Column) -> Column:
    """The severity before the colon that a summary begins with, in the case it has there; null if it is none."""
    head = F.trim(F.split_part(summary, F.lit(":"), F.lit(1)))
    return F.when(F.contains(summary, F.lit(":")) & head.isin(*SEVERITIES), head)


def is_windows(product: Column) -> Column:
    """Whether a product is a release of Windows itself, and neither software on one nor its update services."""
    key = product_key(product)
    first = F.regexp_extract(key, "^windows ([^ ,]*)", 1)
    return first.isin(*WINDOWS) & ~F.contains(key, F.lit(" on ")) & ~key.startswith("windows server update services")


#: Releases of Windows by their builds, and processors by the names that products have for them.
CLIENTS = {
    10240: "", 10586: "1511", 14393: "1607", 15063: "1703", 16299: "1709", 17134: "1803", 17763: "1809", 18362: "1903", 18363: "1909", 19041: "2004", 19042: "20H2", 19043: "21H1", 19044: "21H2", 19045: "22H2",
    22000: "21H2", 22621: "22H2", 22631: "23H2", 26100: "24H2", 26200: "25H2", 28000: "26H1",
}
SERVERS = {26100: "2025", 25398: "2022, 23H2 Edition", 20348: "2022", 17763: "2019", 14393: "2016", 9600: "2012 R2", 9200: "2012"}
ARCHITECTURES, CORE_ONLY, FIRST_11 = {"x86_64": "x64-based", "aarch64": "ARM64-based", "x86": "32-bit"}, 25398, 22000


def windows_product(caption: Column, build: Column, display_version: Column, installation_type: Column, product_type: Column, architecture: Column) -> Column:
    """The name by which advisories know a Windows installation; null for a processor or build that they have no name for.

    A server of an unknown build takes the year of its caption, and a client the label of its release.
    """
    pick = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    processor = pick(ARCHITECTURES, architecture)
    server = F.coalesce(product_type.isin(2, 3), F.lit(False)) | F.coalesce(installation_type.startswith("Server"), F.lit(False)) | F.coalesce(F.contains(caption, F.lit("Server")), F.lit(False))
    year = F.regexp_extract(caption, r"^.*?Server (\d{4})", 1)
    base = F.concat(F.lit("Windows Server "), F.coalesce(pick(SERVERS, build), F.when(year != "", year)))
    core = F.coalesce(installation_type == "Server Core", F.lit(False)) | (build == CORE_ONLY)
    as_server = F.concat(base, F.when(core, " (Server Core installation)").otherwise(""))
    release = F.coalesce(pick(CLIENTS, build), F.when(display_version.rlike("^[0-9]{2}H[12]$"), display_version))
    family = F.when(build >= FIRST_11, "Windows 11").otherwise("Windows 10")
    as_client = F.concat(family, F.when(release == "", "").otherwise(F.concat(F.lit(" Version "), release)), F.lit(" for "), processor, F.lit(" Systems"))
    return F.when(processor.isNotNull(), F.when(server, as_server).otherwise(as_client))


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches a pattern as files of ignored paths have it: * within a name, ** across folders, ? one letter."""
    out, at = "", 0
    anchored = "/" in pattern.rstrip("/")
    for m in re.finditer(r"\*\*/|/\*\*$|\*\*|\*|\?", pattern):
        out += re.escape(pattern[at : m.start()]) + {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]]
        at = m.end()
    out += re.escape(pattern[at:].rstrip("/"))
    return path.rlike(("^" if anchored else "(?:^|/)") + out.removeprefix("/") + "(?:/|$)")


def masked(line: Column, pattern: str = r"(?i)(password|passwd|secret|token|api_?key)(\s*[:=]\s*)(\S+)") -> Column:
    """A line with what the pattern's third group matches as stars."""
    return F.regexp_replace(line, pattern, "$1$2***")


def plain_product(name: Column) -> Column:
    """A product's name up to the mark of a processor, and without a version as its last word."""
    # what follows a mark goes with it
    bare = F.trim(F.split(F.trim(name), PROCESSORS)[0])
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    return F.when((F.size(words) > 1) & last.rlike("^[0-9]") & F.contains(last, F.lit(".")), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(bare)


def identifier_part(text: Column) -> Column:
    """A part of an identifier: letters, numbers, points, dashes and underscores in lower case, blanks as underscores, and nothing else; a star if that leaves none."""
    own = F.regexp_replace(F.regexp_replace(text, " ", "_"), r"[^\p{IsAlphabetic}\p{N}._-]", "")
    return F.when(own == "", "*").otherwise(F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def software_identifiers(product: Column, publisher: Column, version: Column) -> Column:
    """A product's plain name, and its CPE and package URL. Without a known publisher, the product's name stands for it, or Microsoft's where that has it."""
    name = plain_product(product)
    unknown = (F.trim(publisher) == "") | (F.lower(publisher) == "unknown")
    vendor = F.when(~unknown, identifier_part(publisher)).when(F.contains(F.lower(name), F.lit("microsoft")), "microsoft").otherwise(identifier_part(name))
    own, number = identifier_part(name), identifier_part(version)
    return F.struct(
        name.alias("product"), F.concat(F.lit("cpe:2.3:a:"), F.concat_ws(":", vendor, own, number), F.lit(":*:*:*:*:*:*:*")).alias("cpe"),
        F.concat(F.lit("pkg:generic/"), vendor, F.lit("/"), own, F.lit("@"), number).alias("purl"),
    )


def build(text: Column) -> Column:
    """The four numbers of a build, without invisible characters; null if it hasn't four."""
    parts = F.split(F.regexp_replace(text, r"[^0-9.]", ""), r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("long"))
    return F.when((F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def month(token: Column) -> Column:
    """The first day of a month named as 2024-Jan."""
    return F.to_date(F.when(token.rlike("^[0-9]{4}-[A-Z][a-z]{2}$"), F.concat(token, F.lit("-01"))), "yyyy-MMM-dd")


#: Addresses that a target may stand for, but for the first; larger blocks are scopes to test against, not lists of targets.
MOST = 65_536


def target(text: Column) -> Column:
    """What a target is (kind: Address, Cidr, Range, Hostname, or Invalid with why) and its first and last address as numbers.

    A block stands for the addresses between its network and broadcast address, one of 32 bits for itself; one of 31 bits has none. Blocks
    below 16 bits and ranges longer than MOST are invalid, as is a range that ends before it begins. What reads as none of these is a name.
    """
    part = lambda mark: F.split_part(text, F.lit(mark), F.lit(1))
    bits = F.regexp_extract(text, r"^[^/]*/\+?([0-9]{1,3})$", 1).try_cast("int")
    read = F.struct(ip4(text).alias("one"), ip4(part("/")).alias("base"), bits.alias("bits"), ip4(part("-")).alias("first"), ip4(F.regexp_extract(text, "^[^-]*-(.*)$", 1)).alias("last"))

    def told(r: Column) -> Column:
        width = F.pow(F.lit(2), F.lit(32) - r["bits"]).cast("long")
        network = F.floor(r["base"] / width) * width
        block, span = r["base"].isNotNull() & (r["bits"] <= 255), r["first"].isNotNull() & r["last"].isNotNull()
        long = r["last"] - r["first"] > MOST
        answer = lambda kind, why=None, low=None, high=None: F.struct(
            F.lit(kind).alias("kind"), F.lit(why).cast("string").alias("why"), *((F.lit(None) if x is None else x).cast("long").alias(n) for n, x in (("low", low), ("high", high)))
        )
        return (
            F.when(r["one"].isNotNull(), answer("Address", None, r["one"], r["one"])).when(block & (r["bits"] < 16), answer("Invalid", "block too large")).when(block & (r["bits"] > 32), answer("Invalid", "block"))
            .when(block & (r["bits"] == 32), answer("Cidr", None, r["base"], r["base"])).when(block, answer("Cidr", None, network + 1, network + width - 2))
            .when(span & (r["last"] < r["first"]), answer("Invalid", "end before start")).when(span & long, answer("Invalid", "range too long")).when(span, answer("Range", None, r["first"], r["last"])).otherwise(answer("Hostname"))
        )

    return F.when(text.isNotNull(), bound(read, told))


def addresses(found: Column) -> Column:
    """The addresses that a target stands for, as an array: empty for names and for a block without any, null where it is invalid."""
    none = F.array().cast("array<string>")
    return bound(found, lambda f: F.when(f["kind"] != "Invalid", F.when(f["low"] <= f["high"], F.transform(F.sequence(f["low"], f["high"]), ip4_text)).otherwise(none)))


def locator(content: Column) -> Column:
    """Where content is kept by its own digest: ab/cd/abcd..."""
    digest = F.sha2(content, 256)
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with members in order at any depth and without spaces; null for what isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return text.map(one, na_action="ignore")
