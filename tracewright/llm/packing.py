"""Best-fit packing with certified bounds.

Documents become ids of a word-level BPE and pieces of at most SEQUENCE tokens. Full pieces are sequences of
their own; the others are dealt to partitions of bounded size and packed there by best-fit decreasing. Dual
feasible functions bound from below how many sequences a partition needs: where the packing meets the bound it
is certified, and gives away its emptiest sequence alone. Partitions with a gap keep their full sequences and exchange the others, whole, with
one another; best-fit decreasing runs again on what came together and its result is taken where it needs
fewer sequences than the ones that came. Where that has ended and there are still more sequences than the bound of all pieces together asks for, certified partitions
give away all sequences that aren't full, and the exchange goes on. It ends when the bound is met, one partition is left, or a round has closed less than GAIN of the gap.

Defined cases: a null or empty text is the one piece of the closing id; repeated rows and null doc_ids are
packed as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import MATCHES, UNITS, Remembered, model_ids
from .common import cut, map_batches, table, texts_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 2048
#: Pieces that one task packs, and the part of the gap to the bound that a round must close for another one to follow.
IN_TASK, GAIN = 50_000, 0.01
END = b"\0\0\0\0"


class WordIds:
    """Ids of a text, little-endian unsigned 32-bit, as tokenizers gives them; each distinct word is encoded once while it is remembered."""

    #: What all engines agree on: printable characters up to U+00FF, which are normal and lower-cased one by one.
    LATIN = re.compile("[!-~¡-ÿ]+")
    #: The pattern of the vocabulary's file (a fixed value).
    MATCHES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.matched = Remembered(lambda m: model_ids(self.model, m), MATCHES)
        self.words = Remembered(self.word, UNITS)

    def word(self, word: str) -> bytes:
        if self.LATIN.fullmatch(word) and not ("<|" in word and any(s in word for s in self.special)):
            low = word.lower()
            if low.isalpha():
                return self.matched[low]
            return b"".join(map(self.matched.__getitem__, self.MATCHES(low)))
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str = WORDS, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each text's pieces; no shuffle."""

    def work(batches):
        own, step = word_ids(path), 4 * sequence
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = own.encode(text) + END
                for k in range(-(-len(ids) // step)):
                    part = ids[k * step : (k + 1) * step]
                    for name, value in zip(rows, (doc, k, k * sequence, len(part) // 4, zlib.crc32(part)), strict=True):
                        rows[name].append(value)
            yield rows

    return map_batches(texts_of(docs), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """Sequences that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=room + 1), room)


def bound_of_counts(counts: np.ndarray, room: int) -> int:
    """Sequences that any packing of so many pieces of each length needs: the best of the threshold functions and of the rounding functions u(k)."""
    if not counts.any():
        return 0
    sizes = np.arange(room + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    cuts = np.arange(1, room // 2 + 1)
    # pieces over room - cut fill a sequence, those under cut count nothing
    best = np.max(-(-(room * (number[-1] - number[room - cuts]) + total[room - cuts] - total[cuts - 1]) // room))
    best = max(best, -(-total[-1] // room))
    for k in range(1, 33):
        scaled = np.where((k + 1) * sizes % room == 0, sizes * k, (k + 1) * sizes // room * room)
        best = max(best, -(-int((counts * scaled).sum()) // (room * k)))
    return int(best)


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of each piece by best-fit decreasing: into the fullest sequence that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    some, opened = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            left, b, opened = room, opened, opened + 1
        bins[i], places[i] = b, room - left
        left -= n
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins, places


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean, filled boolean"
KEPT = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(found: DataFrame, sequence: int = SEQUENCE, in_task: int = IN_TASK) -> DataFrame:
    """found (as pieces() gives it) with sequence_id and offset. Ids of full pieces are even, the others odd."""

    def packed(turn: int, certified_rest: bool):
        def work(batches):
            from pyspark import TaskContext

            held = [b for b in batches if b.num_rows]
            if not held:
                return
            own = {name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held]) for name in ("length", "sequence_id", "offset")}
            lengths = own["length"].astype(np.int64)
            least = lower_bound(lengths, sequence)
            came = len(np.unique(own["sequence_id"])) if turn else len(lengths) + 1
            bins, places, used = own["sequence_id"], own["offset"], came
            if came > least:
                again, at = best_fit(lengths, sequence)
                if (n := int(again.max()) + 1) < came:
                    bins, places, used = ((turn << 52) + (TaskContext.get().partitionId() << 26) + again) * 2 + 1, at, n
            _, where = np.unique(bins, return_inverse=True)
            filled = np.bincount(where, lengths)
            full = filled == sequence
            final = full.copy()
            if used <= least and certified_rest:
                final[:] = True
                final[filled.argmin()] = full.all()
            final, full = final[where], full[where]
            first = 0
            for b in held:
                rows = slice(first, first := first + b.num_rows)
                yield {name: b.column(name) for name in KEPT} | {"sequence_id": bins[rows], "offset": places[rows], "final": final[rows], "filled": full[rows]}

        return work

    # one row a length
    by_length = found.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(sequence + 1, np.int64)
    counts[[r["length"] for r in by_length]] = [r["n"] for r in by_length]
    zero = F.lit(0).cast("long")
    done = [found.where(F.col("length") == sequence).select(*KEPT, (F.monotonically_increasing_id() * 2).alias("sequence_id"), zero.alias("offset"))]
    rest = found.where(F.col("length") < sequence).select(*KEPT, zero.alias("sequence_id"), zero.alias("offset"))
    # sequences that are needed and there, besides those of full pieces
    least, used, turn = bound_of_counts(counts, sequence) - int(counts[sequence]), None, 0
    left, settled = int(counts[:sequence].sum()), 0
    for certified_rest in (True, False):
        while left:
            # what is left after a turn is dealt to fewer tasks where it fits, and otherwise each time, so that other sequences meet
            tasks = -(-left // in_task)
            dealt = rest.repartition(tasks) if not turn else rest.repartition(tasks, F.xxhash64("sequence_id", F.lit(turn)))
            out = cut(map_batches(dealt, packed(turn, certified_rest), COLUMNS), f"packed{turn}")
            # each sequence has one piece at its start
            starts = F.col("offset") == 0
            now = out.agg(F.count_if(~F.col("final")).alias("left"), F.count_if(starts & F.col("final")).alias("final"), F.count_if(starts & ~F.col("final")).alias("open")).first()
            done.append(out.where("final").drop("final"))
            rest, left, turn, settled = out.where(~F.col("final")).drop("final"), now["left"], turn + 1, settled + now["final"]
            before, used = used, settled + now["open"]
            if tasks == 1 or used <= least or (before is not None and before - used <= GAIN * (before - least)):
                break
        if used is None or used <= least or turn == 1 and tasks == 1:
            break
        if certified_rest:
            # sequences of certified partitions that aren't full
            opened = [d.where(~F.col("filled")) for d in done[1:]]
            for d in opened:
                rest = rest.unionByName(d)
            done = [done[0], *(d.where("filled") for d in done[1:])]
            counted = rest.agg(F.count("*").alias("left"), F.count_if(F.col("offset") == 0).alias("open")).first()
            left, settled = counted["left"], used - counted["open"]
    done.append(rest)
    columns = [*KEPT, "sequence_id", "offset"]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more.select(*columns))
    return result


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(cut(pieces(docs), "pieces"))


def op10_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_certified_packing": op10_certified_packing}
ORACLE_SQL: dict[str, str] = {}
