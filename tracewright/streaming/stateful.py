"""Operators on streams: duplicates, pairs close in time, windows, and tables that follow a stream exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def without_duplicates(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """One row a key among those that arrive within delay; later repeats may come through."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def close_pairs(left: DataFrame, right: DataFrame, key: str, at: str, seconds: int, delay: str) -> DataFrame:
    """Rows of left and right with the same key, at most so many seconds apart. Columns of right get the prefix r_.

    Rows that come later than delay are dropped, and state older than the window and delay is forgotten.
    """
    own = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withWatermark(f"r_{at}", delay)
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col(f"r_{at}") >= F.col(at) - span) & (F.col(f"r_{at}") <= F.col(at) + span)
    return left.withWatermark(at, delay).join(own, (F.col(key) == F.col(f"r_{key}")) & near)


def counts(stream: DataFrame, keys: list[str], at: str, length: str, slide: str | None, delay: str) -> DataFrame:
    """Rows by key and tumbling or sliding window."""
    own = stream.withWatermark(at, delay).groupBy(F.window(at, length, slide), *keys).agg(F.count("*").alias("n"))
    return own.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    own = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return own.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Followed:
    """fold(rows) over all rows of a stream so far, as if they had come at once: late and repeated rows count as any others.

    Rows are kept in buckets by key. A batch adds its own, under its number, and folds again the buckets that it touches. A batch that
    is repeated after a failure replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.fold, self.buckets = spark, root.rstrip("/"), keys, fold, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = f"{self.root}/rows"
        dynamic = {"partitionOverwriteMode": "dynamic"}
        placed = batch.withColumn("_batch", F.lit(number)).withColumn("_bucket", self.bucket())
        placed.write.partitionBy("_batch", "_bucket").options(**dynamic).mode("overwrite").parquet(rows)
        kept = self.spark.read.option("mergeSchema", "false").parquet(rows)
        # at most as many as there are buckets
        touched = [r[0] for r in kept.where(F.col("_batch") == number).select("_bucket").distinct().collect()]
        if touched:
            again = self.fold(kept.where(F.col("_bucket").isin(touched)).drop("_batch", "_bucket"))
            again.withColumn("_bucket", self.bucket()).write.partitionBy("_bucket").options(**dynamic).mode("overwrite").parquet(f"{self.root}/folded")

    def follow(self, stream: DataFrame) -> DataFrame:
        """The folded table, when what the stream holds now has been taken in."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.parquet(f"{self.root}/folded").drop("_bucket")
