"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow maps."""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of an Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # on one machine, until the run ends
        found = tempfile.mkdtemp(prefix="shared")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: lost executors don't cost what led to it. The place is added to paths."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*paths: str, spark: SparkSession) -> None:
    """Empties what was cut and isn't needed any more, and has Spark clean the shuffle files that nothing refers to, which it does when the JVM has looked for that.

    A join of many rounds would else keep the files of all of them on disk until the driver's memory is short.
    """
    for p in paths:
        spark.range(0).write.mode("overwrite").parquet(p)
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def known(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at path; None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's queries in rows and bytes; each operator here that reads texts asks for it, and it lasts, since Spark reads it when a query is run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def change_batches(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], more: StructType | None = None) -> DataFrame:
    """docs, each Arrow batch changed by work; with further columns, if any."""
    bounded(docs.sparkSession)
    fields = [*docs.schema.fields, *(more or StructType()).fields]
    # names may hold dots, which mapInArrow doesn't take
    plain = [f"c{k}" for k in range(len(fields))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, fields, strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(work(batch).columns, names=plain)

    return docs.toDF(*plain[: len(docs.columns)]).mapInArrow(run, schema).toDF(*(f.name for f in fields))


def keep_batches(docs: DataFrame, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows of docs for whose texts (a null one as an empty one) keep says so, with their columns."""
    at = docs.columns.index("text")
    return change_batches(docs, lambda batch: batch.filter(pa.array(keep([t or "" for t in batch.column(at).to_pylist()]), pa.bool_())))


def map_batches(df: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """work turns the Arrow batches of a partition into dicts of columns."""
    bounded(df.sparkSession)
    fields = [x.split() for x in schema.split(",")]
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()),
    }
    out = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, a null text as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most so many rows, chosen by the hash of their keys. Most others are left out before the sort, by a share of the hashes that follows from the count."""
    h = F.xxhash64(*keys)
    part = F.pmod(h, F.lit(1 << 30))
    share = 1.5 * rows / max(1, df.count())
    few = df.where(part < int(share * (1 << 30))) if share < 1 else df
    return few.orderBy(part, h, *keys).limit(rows)


def bounded_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most so many labelled doc_ids, chosen by their hash; one whose rows disagree counts as its largest label."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return hashed_sample(one, ["doc_id"], rows)
