"""The first and last bytes of long outputs, and how many were dropped between: in a batch over chunks, or as the state of a stream of them.

What is kept of a stretch of chunks is its first bytes, its last bytes and its length. Two stretches that follow each other merge to one of the same size,
so ranges of a job's chunks are taken in different tasks, and it doesn't matter where a batch or a task ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bytes kept at the start, and of what follows these at the end.
HEAD, TAIL = 2 << 20, 8 << 20
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Stretch:
    """What is kept of the chunks of a stretch; last may hold bytes that first holds too."""

    first: bytes = b""
    last: bytes = b""
    total: int = 0

    def then(self, other: Stretch, head: int, tail: int) -> Stretch:
        first = self.first if len(self.first) == head else self.first + other.first[: head - len(self.first)]
        last = other.last if len(other.last) == tail else (self.last + other.last)[-tail:] if tail else b""
        return Stretch(first, last, self.total + other.total)

    def row(self, head: int, tail: int) -> tuple[bytes, bytes, int, int]:
        """Head, tail, bytes dropped between and in all."""
        behind = max(0, self.total - head)
        kept = min(tail, behind)
        return self.first, self.last[len(self.last) - kept :], behind - kept, self.total


def stretch(chunk: bytes, head: int, tail: int) -> Stretch:
    return Stretch(chunk[:head], chunk[-tail:] if tail else b"", len(chunk))


def bounded(chunks: DataFrame, key: str, order: str, data: str, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """key, head, tail, dropped_bytes and total_bytes of the chunks of each key, in their order.

    Ranges of (key, order) are merged within their tasks first; what is left of a key, one stretch a range, meets in one task, which holds two of them at a time. A null chunk
    is an empty one; chunks of one place in the order count in any order.
    """
    kind = chunks.schema[key].dataType.simpleString()
    parts = f"key {kind}, place long, first binary, last binary, total long"

    def merged(stretches: Iterator[tuple]) -> Iterator[tuple]:
        """(key, place, stretch) in order, those of a key merged."""
        now = None
        for own, place, one in stretches:
            if now is not None and now[0] == own:
                now = own, now[1], now[2].then(one, head, tail)
            else:
                if now is not None:
                    yield now
                now = own, place, one
        if now is not None:
            yield now

    def within(batches):
        rows = (
            (own, place, stretch(chunk or b"", head, tail))
            for b in batches
            for own, place, chunk in zip(b.column("key").to_pylist(), b.column("place").to_pylist(), b.column("data").to_pylist(), strict=True)
        )
        for own, place, one in merged(rows):
            yield pa.RecordBatch.from_pydict({"key": [own], "place": [place], "first": [one.first], "last": [one.last], "total": [one.total]}, _arrow(key_type, parts))

    def across(batches):
        rows = ((r["key"], r["place"], Stretch(r["first"], r["last"], r["total"])) for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for own, _, one in merged(rows):
            first, last, dropped, total = one.row(head, tail)
            yield pa.RecordBatch.from_pydict({"key": [own], "head": [first], "tail": [last], "dropped_bytes": [dropped], "total_bytes": [total]}, _arrow(key_type, out))

    out = f"key {kind}, head binary, tail binary, dropped_bytes long, total_bytes long"
    key_type = to_arrow_type(chunks.schema[key].dataType)
    own = chunks.select(F.col(key).alias("key"), F.col(order).cast("long").alias("place"), F.col(data).cast("binary").alias("data"))
    # a range may begin within a key; each stretch is that of chunks that follow one another
    local = own.repartitionByRange("key", "place").sortWithinPartitions("key", "place").mapInArrow(within, parts)
    return local.repartition("key").sortWithinPartitions("key", "place").mapInArrow(across, out).withColumnRenamed("key", key)


def _arrow(key_type: pa.DataType, fields: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    names = [x.split() for x in fields.split(", ")]
    return pa.schema([(n, key_type if n == "key" else kinds[k]) for n, k in names])


class BufferProcessor(StatefulProcessor):
    """The stretch of a key so far as state; a row of it whenever chunks came."""

    def __init__(self, key: str, head: int, tail: int) -> None:
        self.key, self.head, self.tail = key, head, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stretch", "first binary, last binary, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = Stretch(*self.state.get()) if self.state.exists() else Stretch()
        for _, chunk in sorted(((place, chunk) for part in rows for place, chunk in zip(part["place"], part["data"], strict=True)), key=lambda x: x[0]):
            now = now.then(stretch(bytes(chunk or b""), self.head, self.tail), self.head, self.tail)
        self.state.update((now.first, now.last, now.total))
        yield pd.DataFrame([(*key, *now.row(self.head, self.tail))], columns=[self.key, "head", "tail", "dropped_bytes", "total_bytes"])

    def close(self) -> None:
        pass


def followed(chunks: DataFrame, key: str, order: str, data: str, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """As bounded, over a stream whose chunks come in their order batch by batch: the row of a key after each batch that has some of its chunks."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = chunks.schema[key].dataType.simpleString()
    own = chunks.select(F.col(key), F.col(order).cast("long").alias("place"), F.col(data).cast("binary").alias("data"))
    out = f"{key} {kind}, head binary, tail binary, dropped_bytes long, total_bytes long"
    return own.groupBy(key).transformWithStateInPandas(BufferProcessor(key, head, tail), out, "Update", "None")
