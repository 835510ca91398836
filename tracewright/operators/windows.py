"""Sessions, hash chains, first k of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blake3
from . import graph


def instances(rows: DataFrame, keys: list[str], order: list[str], opens: Column, ends: Column) -> DataFrame:
    """rows with their instance within a key: a new one starts at an opening row once the current one has seen an end."""
    by = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("_open", opens.cast("int")).withColumn("_end", ends.cast("int"))
    out = out.withColumn("_segment", F.sum("_open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_ended", F.max("_end").over(Window.partitionBy(*keys, "_segment")))
    first = F.row_number().over(Window.partitionBy(*keys, "_segment").orderBy(*order)) == 1
    before = F.lag("_ended").over(by)
    out = out.withColumn("_first", first).withColumn("_split", F.when(F.col("_first") & (F.col("_open") == 1) & (F.coalesce(before, F.lit(0)) == 1), 1).otherwise(0))
    return out.withColumn("instance", F.sum("_split").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_open", "_end", "_segment", "_ended", "_first", "_split")


def chain(rows: DataFrame, key: str, sequence: str, own: Column, first: int = 0) -> DataFrame:
    """rows with prev (own of the row before) and whether the sequence has no gap there."""
    by = Window.partitionBy(key).orderBy(sequence)
    return rows.withColumn("prev", F.coalesce(F.lag(own).over(by), F.lit("GENESIS"))).withColumn("whole", F.col(sequence) == F.row_number().over(by) - 1 + first)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their number within each key, from 1 on, without all rows of a key in one task.

    Rows are dealt to ranges of key and order, written once, numbered within their range, and moved on by the rows of the ranges before, which are one count a key and range.
    """
    placed = graph.kept(rows.repartitionByRange(*map(F.col, keys), *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = None
    for c in (*keys, "_range"):
        one = within[c].eqNullSafe(before[c])
        same = one if same is None else same & one
    return within.join(before, same).select(*(within[c] for c in rows.columns), (within[name] + before["_before"]).cast("int").alias(name))


def first_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


#: The mark before a custody event's bytes, which is a deployment's own; fixed values: its fields in the order in which they follow the sequence number, and what the first event follows.
CUSTODY_MARK, GENESIS = b"CUSTODY-V1\x00", "GENESIS"
CUSTODY_FIELDS = ("event_id", "session_id", "artifact_id", "case_id", "action", "actor_id", "timestamp_utc", "sha256", "blake3", "details_hash")


def custody_bytes(previous: Column, sequence: Column, fields: dict[str, Column], mark: bytes = CUSTODY_MARK) -> Column:
    """What the digest of a custody event is taken of: texts with their lengths in bytes, four each, and the number in eight; a missing text is an empty one."""
    number = lambda n, digits: F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))

    def sized(text: Column) -> Column:
        raw = F.coalesce(text, F.lit("")).cast("binary")
        return F.concat(number(F.octet_length(raw), 8), raw)

    return F.concat(F.lit(mark), sized(previous), number(sequence, 16), *(sized(fields[name]) for name in CUSTODY_FIELDS))


def broken_custody(events: DataFrame, key: str = "session_id", mark: bytes = CUSTODY_MARK) -> DataFrame:
    """The first event of each key's chain that doesn't hold, and why: a number that isn't its place from 1 on, a first event that doesn't follow GENESIS, a previous
    digest that isn't that of the event before, or a digest that isn't the one of its fields. Nothing for chains that hold.

    events has the fields of CUSTODY_FIELDS, sequence_no, previous_event_hash and event_hash. A chain is the record of one session; its events are numbered in one task.
    """
    by = Window.partitionBy(key).orderBy("sequence_no", "event_id")
    own = events.withColumn("_place", F.row_number().over(by)).withColumn("_before", F.lag("event_hash").over(by))
    own = own.withColumn("_again", blake3.digest(custody_bytes(F.col("previous_event_hash"), F.col("sequence_no"), {f: F.col(f).cast("string") for f in CUSTODY_FIELDS}, mark)))
    follows = F.when(F.col("_place") == 1, F.when(~F.col("previous_event_hash").eqNullSafe(F.lit(GENESIS)), "genesis")).when(~F.col("previous_event_hash").eqNullSafe(F.col("_before")), "previous")
    why = F.when(~F.col("sequence_no").eqNullSafe(F.col("_place")), "sequence").otherwise(F.coalesce(follows, F.when(~F.col("event_hash").eqNullSafe(F.col("_again")), "digest")))
    bad = own.withColumn("issue", why).where("issue IS NOT NULL")
    return bad.groupBy(key).agg(F.min_by(F.struct("sequence_no", "issue"), "_place").alias("x")).select(key, "x.*")


def only_appended(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table that is only ever appended to which are gone or changed now; empty if there are none."""
    fields = [c for c in before.columns if c not in keys]
    own = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    met = own(before, "_was").join(own(now, "_is"), keys, "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"_is.`{c}`").eqNullSafe(F.col(f"_was.`{c}`"))
    return met.where(F.col("_is").isNull() | ~same).select(*keys, F.when(F.col("_is").isNull(), "gone").otherwise("changed").alias("issue"))


def uploads(chunks: DataFrame, limit: int) -> DataFrame:
    """The state of each upload (upload_id, arrival, start, size, total): bytes taken in order, and whether it is complete, open, or was refused and why.

    A chunk is taken where it begins at the end of what is there; the first one that doesn't, or that goes over the limit or the total, ends the upload.
    """
    by = Window.partitionBy("upload_id").orderBy("arrival")
    own = chunks.withColumn("_end", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    why = F.when(F.col("start") != F.col("_end"), "offset").when(F.col("_end") + F.col("size") > F.least(F.lit(limit), F.col("total")), "size")
    own = own.withColumn("_bad", why)
    own = own.withColumn("_stopped", F.max(F.col("_bad").isNotNull()).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first_bad = F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("arrival"))).alias("refused")
    out = own.groupBy("upload_id").agg(F.sum(F.when(~F.col("_stopped"), F.col("size")).otherwise(0)).alias("bytes"), F.max("total").alias("total"), first_bad)
    return out.select("upload_id", "bytes", F.when(F.col("refused").isNotNull(), F.concat(F.lit("refused: "), "refused")).when(F.col("bytes") == F.col("total"), "complete").otherwise("open").alias("state"))
