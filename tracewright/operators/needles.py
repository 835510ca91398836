"""Which texts hold which of many needles, by a join on the rarest few bytes of each needle.

A text that holds a needle holds every run of bytes of it. So a needle is looked for among the texts that hold the one of its runs which the fewest texts have,
and each text so found is searched for the whole needle, unless that run is the whole needle. Texts are looked through in tasks, which know of the needles' runs by a filter of
PLACES bits alone: what leaves them are the few runs that some needle may have, and texts go on only with the needles that they may hold. No text is held against all needles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

#: Bytes of a run, a shorter needle being a run of its own, and the first bytes of a run that are looked for at every place of a text.
RUN, HEAD = 16, 4
#: Places of the filter (a power of two), and bytes of texts that are looked through at once.
PLACES, PART = 1 << 20, 1 << 20
#: An odd number whose multiples spread over all high bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def runs(data: Column) -> Column:
    """The different runs of a needle's bytes (binary, not empty)."""
    last = F.greatest(F.octet_length(data) - RUN, F.lit(0)) + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(data, k, RUN)))


def _cut(codes: np.ndarray, size: int) -> np.ndarray:
    """Numbers of eight bytes, the lowest first, of which only the first few count."""
    return codes & np.uint64((1 << 8 * max(0, min(size, 8))) - 1)


def _places(first: np.ndarray, second: np.ndarray | None, size: int) -> np.ndarray:
    """Places of runs of size bytes, given as their first eight and second eight, or of heads of size bytes, which have no second eight and other places than a run has."""
    out = (_cut(first, size) + np.uint64(size if second is not None else size + RUN)) * SPREAD
    if second is not None:
        out = ((out >> np.uint64(32)) ^ out ^ _cut(second, size - 8)) * SPREAD
    return out >> np.uint64(64 - PLACES.bit_length() + 1)


def _place(head: bool):
    def run(data: pa.Array) -> pa.Array:
        number = lambda x: np.array([int.from_bytes(x, "little")], np.uint64)
        own = (x[:HEAD] if head else x for x in data.to_pylist())
        return pa.array([int(_places(number(x[:8]), None if head else number(x[8:]), len(x))[0]) for x in own], pa.int64())

    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, LongType())


def filter_of(wanted: DataFrame) -> np.ndarray:
    """The filter of some runs (_run) and of their heads, packed: PLACES bits, however many runs there are."""
    # buckets of bits are numbered from 1, and so are the places in them
    places = wanted.select((_place(True)("_run") + 1).alias("p")).union(wanted.select((_place(False)("_run") + 1).alias("p")))
    # PLACES / 32,768 rows of 4 KB
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(PLACES // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hits(data: np.ndarray, ends: np.ndarray, sizes: list[int], table: np.ndarray):
    """For parts of texts that lie one after another and end at ends: numbers of texts, and runs of one size as binary that may be wanted, each once a text and part."""
    for at in range(0, len(data), PART):
        n = min(PART, len(data) - at)
        own = np.zeros(n + RUN, np.uint8)
        there = data[at : at + n + RUN]
        own[: len(there)] = there
        first, second = (np.ndarray((n,), "<u8", own, k, (1,)) for k in (0, 8))
        heads = np.ndarray((n,), "<u4", own, strides=(1,)).astype(np.uint64)
        for head in sorted({min(k, HEAD) for k in sizes}):
            place = np.flatnonzero(table[_places(heads, None, head)])
            text = np.searchsorted(ends, place + at, "right")
            left = ends[text] - place - at
            for k in (k for k in sizes if min(k, HEAD) == head):
                fits = left >= k
                found, here = text[fits], place[fits]
                low, high = first[here], second[here]
                good = table[_places(low, high, k)]
                found, low, high = found[good], _cut(low[good], k), _cut(high[good], k - 8)
                order = np.lexsort((high, low, found))
                found, low, high = found[order], low[order], high[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                found, letters = found[new], np.stack([low[new], high[new]], 1).astype("<u8").view(np.uint8)[:, :k]
                if len(found):
                    offsets = np.arange(len(found) + 1, dtype=np.int32) * np.int32(k)
                    yield found, pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _holds(case: bool):
    def run(texts: pa.Array, needles: pa.Array) -> pa.Array:
        # row by row, so that texts are widened one at a time
        return pa.array([n.as_buffer().to_pybytes() in (t if case else pc.utf8_lower(t)).as_buffer().to_pybytes() for t, n in zip(texts, needles, strict=True)], pa.bool_())

    run.__annotations__ = {"texts": pa.Array, "needles": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, BooleanType())


def held_runs(read: DataFrame, wanted: DataFrame, case: bool) -> DataFrame:
    """_t and _run of the texts (_text) that hold a wanted run, and of some more."""
    sizes, packed = sorted(r[0] for r in wanted.select(F.octet_length("_run")).distinct().collect()), filter_of(wanted)
    schema = StructType([read.schema["_t"], StructField("_run", BinaryType())])
    arrow = to_arrow_schema(schema)

    def work(batches):
        table = np.unpackbits(packed, bitorder="little").astype(bool)
        for batch in batches:
            texts = batch.column("_text") if case else pc.utf8_lower(batch.column("_text"))
            _, where, data = texts.buffers()
            offsets = np.frombuffer(where, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            octets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            for text, found in _hits(octets, offsets[1:] - offsets[0], sizes, table):
                yield pa.RecordBatch.from_arrays([batch.column("_t").take(pa.array(text)).cast(arrow.field("_t").type), found.cast(arrow.field("_run").type)], schema=arrow)

    return read.mapInArrow(work, schema)


def found(needles: DataFrame, needle_id: str, needle: str, texts: DataFrame, text_id: str, text: str, case: bool = False) -> DataFrame:
    """needle_id and text_id of each needle and text that holds it, each pair once. An empty or null needle is in no text; without case, both are compared in lower case, letter by letter."""
    low = F.arrow_udf(_lowered, "string")
    valid = (lambda c: c) if case else F.make_valid_utf8
    asked = needles.select(F.col(needle_id).alias("_n"), valid(F.col(needle)).alias("_needle")).where("_needle <> ''")
    asked = (asked if case else asked.withColumn("_needle", low("_needle"))).distinct()
    read = texts.select(F.col(text_id).alias("_t"), valid(F.col(text)).alias("_text")).where("_text <> ''")
    wanted = asked.select("_n", "_needle", F.explode(runs(F.col("_needle").cast("binary"))).alias("_run"))
    held = held_runs(read, wanted.select("_run").distinct(), case)
    counts = held.groupBy("_run").agg(F.count("*").alias("_c"))
    # a run that no text has rules its needle out
    rare = wanted.join(counts, "_run", "left").groupBy("_n", "_needle").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_run")).alias("m")).where("m.c > 0").select("_n", "_needle", "m._run")
    pairs = rare.join(held, "_run")
    whole = F.octet_length("_needle") <= RUN
    short = pairs.where(whole).select("_n", "_t")
    both = pairs.where(~whole).select("_n", "_needle", "_t").join(read, "_t").where(_holds(case)("_text", "_needle")).select("_n", "_t")
    return short.union(both).distinct().select(F.col("_n").alias(needle_id), F.col("_t").alias(text_id))
