"""Feeds of vulnerabilities, logs and scan reports as tables.

Logs and scores are read line by line, so that one large file is split over tasks. Malformed rows of scores are left out; those of
logs are kept as raw text. Empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of capture and event files.
MAGIC = (
    ("evtx", "456C6646696C6500"), ("pcap_us_le", "D4C3B2A1"), ("pcap_us_be", "A1B2C3D4"), ("pcap_ns_le", "4D3CB2A1"), ("pcap_ns_be", "A1B23C4D"), ("pcapng", "0A0D0D0A"),
)


def sniff(content: Column) -> Column:
    """Format by the first bytes, or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit("unknown")
    for name, magic in reversed(MAGIC):
        found = F.when(head.startswith(magic), name).otherwise(found)
    return found


def scores(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """cve, epss and percentile; plain or gzip. More may name file."""
    p = F.split("value", ",")
    rows = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file")).where(~F.col("value").startswith("#") & ~F.col("value").startswith("cve,"))
    at = [F.trim(F.get(p, F.lit(k))) for k in range(3)]
    return rows.select(*more, at[0].alias("cve"), at[1].try_cast("float").alias("epss"), at[2].try_cast("float").alias("percentile")).where("epss IS NOT NULL AND percentile IS NOT NULL")


def dated_scores(spark: SparkSession, path: str) -> DataFrame:
    """scores with score_date, the date that the comment of their file names; null where it names none."""
    named = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("value LIKE '#%'")
    dates = named.select("file", F.to_date(F.nullif(F.regexp_extract("value", r"score_date:(\d{4}-\d\d-\d\d)", 1), F.lit(""))).alias("score_date")).groupBy("file").agg(F.max("score_date").alias("score_date"))
    return scores(spark, path, "file").join(dates, "file", "left").drop("file")


def vendor_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Affected ranges of vendors' advisories, a JSON array a file: no first version, and the one that fixes. Entries that lack a field they need are left out."""
    rows = spark.read.schema("advisory_id string, cve_id string, ecosystem string, package_name string, release string, fixed_version string, summary string").option("multiLine", "true").json(path)
    need = ["advisory_id", "cve_id", "ecosystem", "package_name", "fixed_version"]
    named = F.lower("ecosystem")
    kind = F.when(named == "ubuntu", "Ubuntu").when(named == "debian", "Debian").when(named.isin("redhat", "rhel"), "RedHat").otherwise("Generic")
    return rows.dropna(subset=need).select("advisory_id", "cve_id", kind.alias("ecosystem"), "package_name", "release", F.lit(None).cast("string").alias("introduced"), F.col("fixed_version").alias("fixed"), F.lit(None).cast("string").alias("last_affected"))


def json_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, raw line and its record as a variant; record is null for lines that aren't JSON. Blank lines are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    return rows.withColumn("record", F.try_parse_json("raw"))


def exploited(spark: SparkSession, path: str) -> DataFrame:
    """Entries of catalogs of known exploited vulnerabilities, one JSON document a file."""
    one = "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, dueDate string, knownRansomwareCampaignUse string"
    rows = spark.read.schema(f"vulnerabilities array<struct<{one.replace(' string', ':string')}>>").option("multiLine", "true").json(path)
    return rows.select(F.inline("vulnerabilities")).where("cveID IS NOT NULL")


_RANGE = "struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>"
#: Fields of an OSV record that are read.
ADVISORY = f"id string, summary string, aliases array<string>, withdrawn string, affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,versions:array<string>,ranges:array<{_RANGE}>>>"


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """A row for each advisory, package and range event of OSV records, one JSON document a file."""
    return advisory_rows(spark.read.schema(ADVISORY).option("multiLine", "true").json(path))


def advisory_rows(records: DataFrame) -> DataFrame:
    """A row for each advisory, package and range event of records with the fields of ADVISORY; those without an id are left out."""
    rows = records.where("id IS NOT NULL").select("id", "summary", "aliases", "withdrawn", F.explode_outer("affected").alias("a"))
    rows = rows.select("id", "summary", "aliases", "withdrawn", "a.package.ecosystem", "a.package.name", "a.versions", F.posexplode_outer("a.ranges").alias("range", "r"))
    return rows.select(*(c for c in rows.columns if c != "r"), F.col("r.type").alias("type"), F.posexplode_outer("r.events").alias("step", "e")).select("*", "e.*").drop("e")


def scanned_ports(spark: SparkSession, path: str) -> DataFrame:
    """Ports of the hosts in Nmap reports; a host without ports has one row of nulls."""
    port = "struct<_protocol:string,_portid:int,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string>>"
    host = f"address array<struct<_addr:string,_addrtype:string>>, status struct<_state:string>, ports struct<port:array<{port}>>"
    rows = spark.read.format("xml").option("rowTag", "host").schema(host).load(path)
    ip = F.get(F.filter("address", lambda a: a["_addrtype"].isin("ipv4", "ipv6")), F.lit(0))["_addr"]
    rows = rows.select(ip.alias("ip"), F.col("status._state").alias("host_state"), F.explode_outer("ports.port").alias("p"))
    return rows.select("ip", "host_state", F.col("p._protocol").alias("protocol"), F.col("p._portid").alias("port"), F.col("p.state._state").alias("state"), F.col("p.service._name").alias("service"), F.col("p.service._product").alias("product"), F.col("p.service._version").alias("version"))
