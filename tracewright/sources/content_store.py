"""A store of contents by their BLAKE3 digest: objects lie at ab/cd/abcd..., are written once and never changed, and are verified by reading them again.

Objects and files live in a mounted folder. A file is copied and digested in one pass over pieces of PIECE bytes, whatever its size; verifying deals the
pieces of all objects over tasks and joins their values, which are 32 bytes each.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3
from . import files

#: Bytes of a piece, a power of two of chunks, and the most that a reader gets at once.
PIECE, LARGEST_SLICE = 16 << 20, 128 << 10
STORED = "name string, blake3 string, sha256 string, size long, path string, new boolean"


def place(root: str, digest: str) -> str:
    return os.path.join(root, digest[:2], digest[2:4], digest)


@dataclass
class Digester:
    """Both digests of a content that comes in pieces of PIECE bytes, the last of which may be shorter."""

    def __post_init__(self) -> None:
        self.sha, self.values, self.held, self.size = hashlib.sha256(), [], b"", 0

    def add(self, piece: bytes) -> None:
        # the only piece of a content is digested as a whole
        if self.size:
            if self.size == len(self.held):
                self.values.append(blake3.part_value(self.held, 0))
                self.held = b""
            self.values.append(blake3.part_value(piece, self.size // blake3.CHUNK))
        else:
            self.held = piece
        self.sha.update(piece)
        self.size += len(piece)

    def done(self) -> tuple[str, str]:
        return (blake3.joined(self.values) if self.values else blake3.digests([self.held])[0]), self.sha.hexdigest()


def pieces(path: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(start)
        left = None if end is None else end - start
        while (left is None or left > 0) and (piece := f.read(PIECE if left is None else min(PIECE, left))):
            left = None if left is None else left - len(piece)
            yield piece


def put(root: str, name: str, content: Iterator[bytes]) -> dict:
    """Writes a content beside the store and moves it to its place; one that is there already stays as it is, and of two writers at a time either wins."""
    os.makedirs(os.path.join(root, "tmp"), exist_ok=True)
    beside, digester = os.path.join(root, "tmp", uuid.uuid4().hex), Digester()
    try:
        with open(beside, "wb") as f:
            for piece in content:
                digester.add(piece)
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        digest, sha = digester.done()
        path = place(root, digest)
        new = not os.path.exists(path) or os.path.getsize(path) != digester.size
        if new:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.chmod(beside, 0o444)
            os.replace(beside, path)
        return {"name": name, "blake3": digest, "sha256": sha, "size": digester.size, "path": path, "new": new}
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def _stored(rows: Iterator[tuple[str, Iterator[bytes]]], root: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in STORED.split(", "))])
    for name, content in rows:
        yield pa.RecordBatch.from_pylist([put(root, name, content)], schema)


def store_rows(contents: DataFrame, name: str, data: str, root: str) -> DataFrame:
    """Stores the contents of rows; a row for each that isn't null, with its digests, size and place. Nothing is written before the rows are asked for, and a repeated task writes nothing twice."""
    plain = files.local(root)

    def work(batches):
        for b in batches:
            rows = ((n, iter([d[k : k + PIECE] for k in range(0, len(d), PIECE)])) for n, d in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), strict=True) if d is not None)
            yield from _stored(rows, plain)

    return contents.select(F.col(name).cast("string").alias("name"), F.col(data).cast("binary").alias("data")).mapInArrow(work, STORED)


def store_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Stores the files that a path names, each in one pass of bounded memory."""
    plain = files.local(root)
    names = list(files.listed(path))

    def work(batches):
        for b in batches:
            yield from _stored(((n, pieces(n)) for n in b.column("name").to_pylist()), plain)

    # a task for some files, and never all for one
    listed = spark.createDataFrame(names, "name string, size long").repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism))
    return listed.select("name").mapInArrow(work, STORED)


def verified(spark: SparkSession, root: str, piece: int = PIECE) -> DataFrame:
    """blake3, path, size and whole for each object: whether its bytes still have the digest that it lies under. Objects are read in pieces, in any tasks."""
    plain = files.local(root)
    there = [(p, s) for p, s in files.listed(plain) if len(os.path.basename(p)) == 64 and os.path.basename(os.path.dirname(p)) != "tmp"]
    if piece % blake3.CHUNK or (piece // blake3.CHUNK) & (piece // blake3.CHUNK - 1):
        raise ValueError("a piece has to be a power of two of chunks")

    def work(batches):
        for b in batches:
            out = []
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                data = b"".join(pieces(path, start, min(size, start + piece)))
                out.append(bytes.fromhex(blake3.digests([data])[0]) if size <= piece else blake3.part_value(data, start // blake3.CHUNK))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), b.column("start"), pa.array(out, pa.binary())], ["path", "size", "start", "value"])

    def joined(data: pa.Array) -> pa.Array:
        return pa.array([v[0].hex() if len(v) == 1 else blake3.joined(v) for v in data.to_pylist()], pa.string())

    joined.__annotations__ = {"data": pa.Array, "return": pa.Array}
    objects = spark.createDataFrame(there, "path string, size long").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("size") - 1), F.lit(piece).cast("long"))))
    values = objects.repartition(4 * spark.sparkContext.defaultParallelism, "path", "start").mapInArrow(work, "path string, size long, start long, value binary")
    # 32 bytes a piece
    whole = values.groupBy("path", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]).alias("values"))
    digest = F.element_at(F.split("path", "/"), -1)
    return whole.select(digest.alias("blake3"), "path", "size", (F.arrow_udf(joined, "string")("values") == digest).alias("whole"))


def read_slice(root: str, digest: str, offset: int, length: int) -> bytes:
    """Bytes of an object; what lies behind its end is left out. ValueError for more than LARGEST_SLICE bytes, FileNotFoundError for an object that isn't there."""
    if length > LARGEST_SLICE or min(offset, length) < 0:
        raise ValueError(f"a slice of {length} bytes from {offset} on")
    with open(place(files.local(root), digest), "rb") as f:
        f.seek(offset)
        return f.read(length)
