"""Tables that are written: appended, inserted if absent, replaced by key or by partition.

A Table is a folder of versions, each named by its number, of parts, and of pointers: the one with the largest number names the parts of the current version. A part is complete
before a pointer names it, and a pointer is written whole or not at all by Spark's own commit of a job, so that a job that
is lost changes nothing, and readers of the version before keep theirs, also while rows are appended. Of two writers at a time the second one fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def pointer(self) -> tuple[int, list[str]]:
        """Number of the current version, 0 if there is none, and its parts."""
        try:
            rows = self.spark.read.schema("part string, version long").parquet(f"{self.root}/versions/*")
            top = rows.agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            top = None
        return (0, []) if top is None else (top, [r[0] for r in rows.where(F.col("version") == top).orderBy("part").collect()])

    def read(self) -> DataFrame | None:
        parts = self.pointer()[1]
        return self.spark.read.parquet(*parts) if parts else None

    def _point(self, version: int, parts: list[str]) -> None:
        # a version that another writer has made already isn't overwritten
        self.spark.createDataFrame([(p, version) for p in parts], "part string, version long").coalesce(1).write.mode("error").parquet(f"{self.root}/versions/{version:012d}")

    def _write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        path = f"{self.root}/parts/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        return path

    def replace(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """A new version that holds df alone."""
        version, _ = self.pointer()
        path = self._write(df, partition_by)
        self._point(version + 1, [path])
        return self.spark.read.parquet(path)

    def append(self, df: DataFrame) -> None:
        """A new version with the rows of the current one and those of df."""
        version, parts = self.pointer()
        self._point(version + 1, [*parts, self._write(df)])

    def insert_absent(self, df: DataFrame, keys: list[str], order: list[str]) -> None:
        """Adds the first row by order of each key that the table lacks; null keys equal each other."""
        new, old = first(df, keys, order), self.read()
        if old is not None:
            have = old.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(have, same, "left_anti")
        self.append(new)

    def upsert(self, df: DataFrame, keys: list[str], order: list[str]) -> None:
        """The last row by order of each key wins; rows of df win over those of the table."""
        old, tagged = self.read(), df.withColumn("_age", F.lit(0))
        if old is not None:
            tagged = tagged.unionByName(old.withColumn("_age", F.lit(1)))
        rest = [c for c in df.columns if c not in keys]
        rank = F.struct(-F.col("_age"), *order)
        won = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
        self.replace(won.select(*keys, "_r.*").select(*df.columns))

    def replace_partitions(self, df: DataFrame, by: str) -> None:
        """Rows of the partitions that df holds give way to those of df."""
        old = self.read()
        if old is not None:
            df = df.unionByName(old.join(df.select(F.col(by).alias("_by")).distinct(), F.col(by).eqNullSafe(F.col("_by")), "left_anti"))
        self.replace(df)


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)
