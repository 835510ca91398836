"""Zip archives and offline bundles of feeds as tables.

An archive is read by one task, its members one at a time. What breaks a limit gives a row that names the problem, and no content; the
other archives of the path are read all the same. Spark reads no file without bytes: such archives and empty folders give no rows, and in a bundle such a file is missing.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feeds

MEMBERS = "file string, member string, size long, content binary, problem string"
#: Most members of an archive, bytes of a member and of all, times that a member may grow, and bytes of a record of a feed.
MAX_MEMBERS, MAX_SIZE, MAX_TOTAL, MAX_RATIO, MAX_RECORD = 10_000, 2 << 30, 5 << 30, 100, 8 << 20
#: A value of Spark and Arrow stays below 2 GB, whatever MAX_SIZE says.
MAX_VALUE = (1 << 31) - (1 << 16)


def clean_path(name: str) -> str | None:
    """name as a relative path with slashes; null for one that leaves its folder, names a drive or is empty."""
    parts = [p for p in re.split(r"[/\\]", name.strip()) if p not in ("", ".")]
    if not parts or ".." in parts or re.match(r".:", parts[0]):
        return None
    return "/".join(parts)


def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple[bytes | None, str | None]:
    """Content or problem of a member. Stated sizes may be false, so it is read to the limit only."""
    if info.flag_bits & 1:
        return None, "encrypted"
    if info.file_size > most:
        return None, "too large"
    if info.file_size > MAX_RATIO * max(1, info.compress_size):
        return None, "grows too much"
    try:
        with archive.open(info) as f:
            content = f.read(most + 1)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError):
        return None, "unreadable"
    return (None, "too large") if len(content) > most else (content, None)


def _rows(content: bytes, most: int) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield None, None, None, "no archive"
        return
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_TOTAL:
        yield None, None, None, "too many members" if len(infos) > MAX_MEMBERS else "too large in all"
        return
    for info in infos:
        name = clean_path(info.filename)
        own, problem = _read(archive, info, most) if name is not None else (None, "unsafe path")
        yield (name if name is not None else info.filename), info.file_size, own, problem


def members(spark: SparkSession, path: str, glob: str = "*.zip", most: int = MAX_SIZE) -> DataFrame:
    """The members of all archives under path: size as the archive states it, content, or else the problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")
    out = pa.schema([("file", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])
    most = min(most, MAX_VALUE)

    def work(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                for row in _rows(content.as_py(), most):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file, *row), out, strict=True)], schema=out)

    return files.mapInArrow(work, MEMBERS)


def _records(spark: SparkSession, path: str) -> DataFrame:
    found = members(spark, path, most=MAX_RECORD).where("member IS NULL OR member LIKE '%.json'")
    record = F.from_json(F.col("content").cast("string"), feeds.ADVISORY)
    return found.withColumn("r", record).withColumn("read", F.col("r.id").isNotNull())


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """What feeds.advisories gives, of archives of OSV records. Unreadable members are left out; record_counts counts them."""
    return feeds.advisory_rows(_records(spark, path).where("read").select("r.*"))


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records read and unreadable ones (no JSON, no id, too large, or the archive as a whole), by archive."""
    return _records(spark, path).groupBy("file").agg(F.count_if("read").alias("records"), F.count_if(~F.col("read")).alias("unreadable"))


def ranged(content: Column, offset: int, length: int, most: int = 1 << 20) -> Column:
    """At most `most` of length bytes from offset, counted from 0; empty past the end, null for null or for a negative offset or length."""
    return F.substring(content, offset + 1, min(length, most)) if offset >= 0 and length >= 0 else F.lit(None).cast("binary")


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a bundle's manifest.json lists: feed_name, filename, and state, which is ok, missing or mismatch.

    The digest is SHA-256, which Spark computes where the file is read; the manifest has it as sha256, in either case.
    """
    own = "feeds array<struct<feed_name:string,filename:string,sha256:string>>"
    listed = spark.read.schema(own).option("multiLine", "true").json(f"{folder}/manifest.json").select(F.inline("feeds"))
    # one name a feed; only listed files that are there are read
    names = {r["filename"] for r in listed.select("filename").distinct().collect()}
    there = [r["path"] for r in spark.read.format("binaryFile").load(folder).select("path").where(F.element_at(F.split("path", "/"), -1).isin(sorted(names))).collect()] if names else []
    read = spark.read.format("binaryFile").load(there) if there else spark.createDataFrame([], "path string, content binary")
    files = read.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.coalesce(F.lower("sha256") == F.col("actual"), F.lit(False)), "ok").otherwise("mismatch")
    return listed.join(files, "filename", "left").select("feed_name", "filename", state.alias("state"))


def checked_bundle(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of a bundle's feeds by name, once all of its files are as the manifest says; else ValueError, and nothing is to be imported."""
    rows = bundle_files(spark, folder).collect()  # one row a feed
    wrong = [f"{r.filename}: {r.state}" for r in rows if r.state != "ok"]
    if wrong or not rows:
        raise ValueError("; ".join(sorted(wrong)) or "the manifest lists no feeds")
    return {r.feed_name: f"{folder}/{r.filename}" for r in rows}
