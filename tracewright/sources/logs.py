"""Event logs in JSON as observations: raw_event_type, source_timestamp (UTC, null if absent or malformed) and data.

Security and Sysmon logs are read line by line, so that large files are split over tasks; lines that aren't JSON are left out. A
generic log may be one JSON document, and is read file by file. Blank lines and empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of events by their number, and where the time stands, first place first.
SECURITY = {4688: "process_create", 4624: "logon_success", 4625: "logon_failure", 4672: "special_privilege_logon", 7045: "service_installed"}
SYSMON = {1: "sysmon_process_create", 3: "sysmon_network_connect", 7: "sysmon_image_loaded", 11: "sysmon_file_created", 13: "sysmon_registry_value_set"}
SECURITY_TIME = ("$.System.TimeCreated['@SystemTime']", "$.Event.System.TimeCreated['#attributes'].SystemTime", "$.TimeCreated['@SystemTime']", "$.TimeCreated")
SYSMON_TIME = ("$.EventData.UtcTime", "$.UtcTime", "$.System.TimeCreated['@SystemTime']", "$.Event.System.TimeCreated['#attributes'].SystemTime")
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def at(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def instant(text: Column) -> Column:
    """An RFC 3339 date and time; null for anything else."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def dot_net_date(text: Column) -> Column:
    """`/Date(milliseconds)/`, or an RFC 3339 date and time; null for anything else."""
    text = F.trim(text)
    ms = F.regexp_extract(text, r"^/Date\((-?\d+)[^)]*\)/$", 1).try_cast("long")
    return F.coalesce(F.timestamp_millis(ms), instant(text))


def _numbered(spark: SparkSession, path: str, kinds: dict[int, str], other: str, times: tuple[str, ...]) -> DataFrame:
    record = F.col("record")
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("record")).where("record IS NOT NULL")
    # a number in quotes isn't one
    is_number = F.schema_of_variant(at(record, "$.EventID", "variant")) == "BIGINT"
    number = F.when(is_number, at(record, "$.EventID", "long"))
    kind = F.lit(other)
    for k, name in kinds.items():
        kind = F.when(number == k, name).otherwise(kind)
    return rows.select(number.alias("event_id"), kind.alias("raw_event_type"), instant(F.coalesce(*(at(record, p) for p in times))).alias("source_timestamp"), F.to_json("record").alias("data"))


def security(spark: SparkSession, path: str) -> DataFrame:
    """Security events, one JSON document a line."""
    return _numbered(spark, path, SECURITY, "security_event", SECURITY_TIME)


def sysmon(spark: SparkSession, path: str) -> DataFrame:
    """Sysmon events, one JSON document a line."""
    return _numbered(spark, path, SYSMON, "sysmon_event", SYSMON_TIME)


def generic(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an array, of the array `records`, or else of lines; a line that isn't JSON becomes {"raw_message": line}.

    Entries of arrays have the fields of their objects `data` and `event_data` at the top too, where these win.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    doc = text.withColumn("doc", F.try_parse_json("value"))
    records = F.coalesce(at(F.col("doc"), "$", "array<variant>"), at(F.col("doc"), "$.records", "array<variant>"))
    doc = doc.withColumn("records", records)
    one = F.col("record")
    listed = doc.where("records IS NOT NULL").select("file", F.posexplode("records").alias("place", "record"))
    # field by field, the last of its names wins
    data = at(one, "$", "map<string,variant>")
    for inner in ("$.data", "$.event_data"):
        more = F.coalesce(at(one, inner, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        data = F.map_concat(_without(data, more), more)
    listed = listed.select("file", "place", instant(at(one, "$.source_timestamp")).alias("source_timestamp"), F.coalesce(F.to_json(data), F.to_json(one)).alias("data"))
    lines = doc.where("records IS NULL").select("file", F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    parsed = F.to_json(F.try_parse_json("line"))
    lines = lines.select("file", "place", F.lit(None).cast("timestamp").alias("source_timestamp"), F.coalesce(parsed, F.to_json(F.struct(F.col("line").alias("raw_message")))).alias("data"))
    return listed.union(lines).withColumn("raw_event_type", F.lit("log_entry"))


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, records and bad lines of logs with a JSON document a line: lines that are no JSON objects are counted, and blank ones are not."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")).where("value <> ''")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return rows.groupBy("file").agg(F.count_if(good).alias("records"), F.count_if(~good).alias("bad"))
