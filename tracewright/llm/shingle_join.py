"""N-gram Jaccard self-join by grouped prefixes.

A document's set is that of its distinct word shingles, as 64-bit hashes. Equal sets are one set from the first pass on.
Under one order of all shingles (frequent ones last, else by hash), two sets that reach the
threshold share some shingles among the first of each: their prefixes. Sets with the same prefix and
size are one group, and the index of prefix shingles holds groups; those that share too few entries with others leave it. What shares an index entry is compared in
two steps, neither of which makes all pairs of a group of copies:

1. stars: each group against a few groups of each of its entries, each member of a group against one of its
   members; verified pairs give components. Later rounds compare with more, where an entry still holds several components.
2. the rest: entries whose sets lie in more than one component are expanded to members, and the pairs of different
   components that pass the filters of size and common shingles are verified. Pairs inside a component add nothing.

Every link of different texts is thus found or lies inside a component already. The order of shingles only steers the
work: it comes from counts over all documents, of which a bounded number of the largest is passed on.

Shingles are compared by their hashes. Of n different shingles, some two have the same 64-bit hash with a probability of n * n / 2 ** 65:
a chance of 3 in 100 for 10 ** 9 of them, and a wrong one changes a result only where it tips a similarity over the threshold. Keys of sets have 128 bits.

Defined cases: texts without words, or null, have an empty set and stand alone; a component's id is its smallest non-null
doc_id (null if it has none); repeated rows come back as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import change_batches, cut, discard, map_batches, table, texts_of

#: Frequent shingles that are passed on to the tasks (16 bytes each), the least count in a task that is reported, and the least and most bits of the filter of wanted texts.
FREQUENT, REPORTED, FILTER_BITS = 1 << 16, 8, (1 << 20, 1 << 28)
#: Bytes of text that are hashed at once, and shingles that are counted at once.
CHUNK, COUNTED = 1 << 20, 1 << 21
#: Sets of an entry that the others are compared with, in each round of stars.
CENTRES = (8, 64)
#: Sets of an entry from which on a pair is made once, at its first such entry, and not at each.
CROWDED = 64
#: Members of an entry that are compared with one another in one task: larger entries are dealt into blocks of about so many, and pairs of blocks compared.
BLOCK = 4096
#: Components that move in a round up to which they are broadcast (32 bytes each).
MOVED = 500_000
#: Shingles that prefixes are longer than they must be, so that sets with a link share at least so many.
EXTRA = 16
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LETTER = mix(np.arange(1, 257, dtype=U))
STEP = 0x9E3779B97F4A7C15


@cache
def powers(base: int) -> np.ndarray:
    """The first TABLE powers of base, modulo 2 ** 64."""
    p = np.full(TABLE, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


TABLE = 1 << 16


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base to the powers at, modulo 2 ** 64, from tables of a fixed size."""
    low = powers(base)[at & (TABLE - 1)]
    high = at >> 16
    if not len(at) or not high.any():
        return low
    steps = np.full(int(high.max()) + 1, pow(base, TABLE, 1 << 64), U)
    steps[0] = 1
    return low * np.multiply.accumulate(steps)[high]


INVERSE = pow(STEP, -1, 1 << 64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of raw, and where they start."""
    data = np.frombuffer(raw, np.uint8)
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # LETTER times STEP ** place, summed up
    total = np.zeros(len(data) + 1, U)
    for at in range(0, len(data), TABLE):
        part = data[at : at + TABLE]
        total[at + 1 : at + 1 + len(part)] = LETTER[part] * powers(STEP)[: len(part)] * U(pow(STEP, at, 1 << 64))
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * power(INVERSE, start) + (end - start).astype(U)), start


def pieces(raw: bytes):
    """raw in parts of about CHUNK bytes, cut at white space."""
    at = 0
    while len(raw) - at > 2 * CHUNK:
        cuts = [raw.find(c, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
        end = min((c for c in cuts if c >= 0), default=-1)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, or of the whole sequence where there are fewer words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, U(width), U)
    for j in range(width):
        total = mix(total + words[j : n - width + 1 + j] * U(2 * j + 3))
    return np.unique(total)


def sets_of(texts: list[str], k: int):
    """The set of each text, in order."""
    raws = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    at = 0
    while at < len(raws):
        if len(raws[at]) > CHUNK:
            yield shingles(np.concatenate([word_hashes(p)[0] for p in pieces(raws[at])]), k)
            at += 1
            continue
        end, held = at, 0
        while end < len(raws) and held + len(raws[end]) <= CHUNK:
            held += len(raws[end]) + 1
            end += 1
        words, start = word_hashes(b" ".join(raws[at:end]))
        bounds = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws[at:end]]))
        first = 0
        for last in bounds.tolist():
            yield shingles(words[first:last], k)
            first = last
        at = end


def key_of(own: np.ndarray) -> bytes | None:
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


class Counts:
    """Counts of shingles in one task, of which those that stay small are forgotten now and then."""

    def __init__(self) -> None:
        self.shingles, self.counts, self.new, self.held = np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def add(self, own: np.ndarray) -> None:
        self.new.append(own)
        self.held += len(own)
        if self.held >= COUNTED:
            self.merge(2)

    def merge(self, least: int) -> None:
        both = np.concatenate((self.shingles, *self.new))
        weight = np.concatenate((self.counts, np.ones(self.held, np.int64)))
        self.shingles, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, weight, len(self.shingles)).astype(np.int64)
        keep = self.counts >= least
        self.shingles, self.counts, self.new, self.held = self.shingles[keep], self.counts[keep], [], 0


def _prefix_length(n: int, num: int, den: int) -> int:
    return min(n, n - -(-num * n // den) + EXTRA)


def classes(own: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The class of each shingle: 0, or more for more frequent ones."""
    if not len(frequent):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    return np.where(frequent[at] == own, level[at], 0)


def components(edges: DataFrame) -> DataFrame:
    """key and root, the smallest key of its component, for each end of edges (a, b) but the roots themselves."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # each node's larger neighbours hang on its smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.toDF("key", "root")
        before = now


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, as components gives them, with further links. Only the links between components are followed, root to root."""
    at = [roots.toDF(end, f"root_{end}") for end in ("a", "b")]
    between = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    between = cut(between.distinct(), "between")
    if between.isEmpty():
        return roots
    moved = components(between)
    to = moved.toDF("root", "to")
    # a root may hold a third of all keys: where few roots move, its keys needn't meet in one task
    over = roots.join(F.broadcast(to) if moved.count() <= MOVED else to, "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    return cut(over.union(moved), "roots")


def _sets(k: int):
    def work(batches):
        counts, seen = Counts(), set()
        for batch in batches:
            keys, sizes = [], []
            for own in sets_of(batch.column("text").to_pylist(), k):
                keys.append(key := key_of(own))
                sizes.append(len(own))
                if key is not None and key not in seen:
                    seen.add(key)
                    counts.add(own)
            n = len(keys)
            yield {"doc_id": batch.column("doc_id"), "key": keys, "n": sizes, "shingle": [None] * n}
        counts.merge(REPORTED)
        n = len(counts.shingles)
        yield {"doc_id": [None] * n, "key": [None] * n, "n": counts.counts, "shingle": counts.shingles.view(np.int64)}

    return work


def _index(k: int, num: int, den: int, frequent: np.ndarray, level: np.ndarray):
    def work(batches):
        seen, groups = set(), set()
        for batch in batches:
            rows: dict[str, list] = {"shingle": [], "n": [], "g": [], "key": []}
            for own in sets_of(batch.column("text").to_pylist(), k):
                key = key_of(own)
                if key is None or key in seen:
                    continue
                seen.add(key)
                n = len(own)
                prefix = own[np.lexsort((own, classes(own, frequent, level)))[: _prefix_length(n, num, den)]]
                g = int.from_bytes(blake2b(prefix.tobytes() + n.to_bytes(8), digest_size=8).digest(), signed=True)
                new = [prefix.view(np.int64).tolist()] if g not in groups else [[]]
                groups.add(g)
                p = len(new[0])
                rows["shingle"] += [*new[0], None]
                rows["n"] += [n] * (p + 1)
                rows["g"] += [g] * (p + 1)
                rows["key"] += [None] * p + [key]
            yield rows

    return work


def slot(doc_ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(doc_ids.astype(np.int64).view(U)) % U(size)).astype(np.int64)


def _wanted(k: int, bits: bytes, size: int):
    def work(batches):
        have = np.frombuffer(zstandard.decompress(bits), np.uint8)
        seen, squeeze = set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            at = slot(ids.fill_null(0).to_numpy(), size)
            chosen = np.flatnonzero(missing | ((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            texts = batch.column("text").take(chosen).to_pylist()
            keys, packed = [], []
            for text, own in zip(texts, sets_of(texts, k), strict=True):
                key = key_of(own)
                if key is not None and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(squeeze.compress(text.encode("utf-8", "surrogatepass")))
            yield {"key": keys, "packed": packed}

    return work


def _once(batches):
    seen = set()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        new = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
        yield {"key": [keys[i] for i in new], "packed": batch.column("packed").take(new)}


def _verify(k: int, num: int, den: int):
    def work(batches):
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # a text that is in many pairs of a batch is hashed once
            packed = dict(zip(a, batch.column("packed_a").to_pylist(), strict=True)) | dict(zip(b, batch.column("packed_b").to_pylist(), strict=True))
            own = dict(zip(packed, sets_of([open_up.decompress(x).decode("utf-8", "surrogatepass") for x in packed.values()], k), strict=True))
            linked = []
            for x, y in zip(a, b, strict=True):
                small, large = (own[x], own[y]) if len(own[x]) <= len(own[y]) else (own[y], own[x])
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                linked.append(den * both >= num * (len(small) + len(large) - both))
            yield {"a": a, "b": b, "linked": linked}

    return work


class Join:
    """The join of docs: k-word shingles, Jaccard similarity of num / den or more."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int) -> None:
        self.texts, self.k, self.num, self.den, self.spark = texts_of(docs), k, num, den, docs.sparkSession

    def roots(self) -> DataFrame:
        """key, smallest doc_id and root, the smallest key of the component, of each different set."""
        k, num, den = self.k, self.num, self.den
        first = cut(map_batches(self.texts, _sets(k), "doc_id long, key binary, n long, shingle long"), "sets")
        self.rows = first.where("shingle IS NULL").select("doc_id", "key", "n")
        self.reps = self.rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        # a fixed number of rows, whatever the input
        top = first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("c")).where(F.col("c") >= 2 * REPORTED).orderBy(F.desc("c"), "shingle").limit(FREQUENT).toArrow()
        frequent, count = top["shingle"].to_numpy().view(U), top["c"].to_numpy()
        by = np.argsort(frequent)
        frequent, level = frequent[by], np.log2(count[by] / REPORTED).astype(np.int64)
        index = map_batches(self.texts.select("text"), _index(k, num, den, frequent, level), "shingle long, n int, g long, key binary")
        index = cut(index, "index")
        entries = index.where("shingle IS NOT NULL").select("shingle", "n", "g")
        members = index.where("key IS NOT NULL").select("g", "n", "key").distinct()
        shared = entries.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("shingle")
        shared = cut(entries.join(shared, "shingle").distinct(), "shared")
        # a set with a link has EXTRA shingles of its prefix in common with another, or as many as the threshold asks for
        able = shared.groupBy("g", "n").agg(F.count("*").alias("c")).where(F.col("c") >= F.least(F.lit(EXTRA), F.expr(f"(n * {num}L + {den - 1}) div {den}"))).select("g", "n")
        self.shared = cut(shared.join(able, ["g", "n"]), "able")
        self.members = cut(members, "members")
        heads = self.members.groupBy("g", "n").agg(F.min("key").alias("head"))
        inside = self.members.join(heads, ["g", "n"]).where("key <> head").select(F.greatest("key", "head").alias("a"), F.least("key", "head").alias("b"))
        own = self.shared.join(heads, ["g", "n"]).select(F.col("shingle").alias("e"), F.lit(0).alias("kind"), "n", F.col("head").alias("key"), F.xxhash64("head").alias("r"))
        pairs = cut(inside.union(self.stars(own, CENTRES[0])).distinct(), "pairs")
        roots, checked = components(self.verify(pairs)), pairs
        for centres in (*CENTRES[1:], None):
            self.done: list[str] = []
            own = self.mixed(roots)
            met = self.rest(own) if centres is None else self.stars(own, centres)
            pairs = cut(met.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
            roots, checked = merged(roots, self.verify(pairs)), checked.union(pairs)
            discard(*self.done, spark=self.spark)
        return self.reps.join(roots, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))

    def run(self) -> DataFrame:
        """doc_id, n_shingles and component_id for each row of docs."""
        ids = self.roots()
        smallest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_key = ids.join(smallest, "root").select("key", "component_id")
        return self.rows.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def firsts(self) -> DataFrame:
        """key and doc_id of one set of each component: that with the smallest doc_id that isn't null, if any is, and then the smallest key."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")
        return self.roots().groupBy("root").agg(first).select("r.key", "r.doc_id")

    def mixed(self, roots: DataFrame) -> DataFrame:
        """Members of the entries, and of the groups (kind 1), that lie in more than one component r."""
        place = self.members.join(roots, "key", "left").select("g", "n", "key", F.xxhash64(F.coalesce("root", "key")).alias("r"))
        by_entry = self.shared.join(place, ["g", "n"]).select(F.col("shingle").alias("e"), F.lit(0).alias("kind"), "n", "key", "r")
        by_group = place.select(F.col("g").alias("e"), F.lit(1).alias("kind"), "n", "key", "r")
        own = cut(by_entry.union(by_group), "placed", self.done)
        several = own.groupBy("e", "kind").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("crowd")).where("lo < hi").select("e", "kind", "crowd")
        return cut(own.join(several, ["e", "kind"]), "mixed", self.done)

    def stars(self, own: DataFrame, centres: int) -> DataFrame:
        """Pairs of each set with some sets of its entries, and of other components, that pass the filters."""
        centre = own.groupBy("e", "kind", F.pmod(F.xxhash64("key", F.lit(centres)), F.lit(centres)).alias("part")).agg(F.min(F.struct("key", "n", "r")).alias("c"))
        centre = centre.select("e", "kind", F.col("c.key").alias("b"), F.col("c.n").alias("n2"), F.col("c.r").alias("r2"))
        met = own.withColumnRenamed("key", "a").join(centre, ["e", "kind"]).where((F.col("r") != F.col("r2")) & self.enough("n", "n2"))
        return self.common(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def rest(self, own: DataFrame) -> DataFrame:
        """All pairs of different components that an entry holds together and that pass the filters.

        Pairs without a crowded entry in common are counted entry by entry. Others are made once, at the smallest crowded
        entry that they share, where the lists of both sets give the count.
        """
        apart = (F.col("r") != F.col("r2")) & (F.col("a") > F.col("b")) & self.enough("n", "n2")
        few = self.dealt(own.where((F.col("crowd") <= CROWDED) | (F.col("kind") == 1)))
        met = few.toDF("e", "kind", "n", "a", "r", "pair").join(few.toDF("e", "kind", "n2", "b", "r2", "pair"), ["e", "kind", "pair"]).where(apart)
        by_count = self.common(met).select("a", "b")
        entries = own.where("kind = 0")
        crowded = F.col("crowd") > CROWDED
        # as long as a set's prefix at most
        lists = entries.groupBy("key").agg(F.collect_list("e").alias("all"), F.collect_list(F.when(crowded, F.col("e"))).alias("many")).where(F.size("many") > 0)
        rows = cut(self.dealt(entries.where(crowded).join(lists, "key").select("e", "n", "key", "r", "all", "many", "crowd")), "crowded", self.done)
        x, y = rows.toDF("e", "n", "a", "r", "all", "many", "pair"), rows.toDF("e", "n2", "b", "r2", "all2", "many2", "pair")
        count = F.size(F.array_intersect("all", "all2"))
        first = F.array_min(F.array_intersect("many", "many2")) == F.col("e")
        by_list = x.join(y, ["e", "pair"]).where(apart & first & self.reached("n", "n2", count)).select("a", "b")
        return by_count.union(by_list)

    def dealt(self, own: DataFrame) -> DataFrame:
        """own with the pairs of blocks that a row is compared in; two rows of an entry meet in exactly one. Entries of up to BLOCK rows are one block."""
        blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
        mine, other = F.pmod(F.xxhash64("key", F.lit(7)), blocks).cast("int"), F.col("_o")
        spread = own.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return spread.withColumn("pair", F.least(mine, other).cast("long") * (1 << 32) + F.greatest(mine, other)).drop("_o", "crowd")

    def common(self, met: DataFrame) -> DataFrame:
        # a group's own entry stands for all of its prefix
        both = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(1)).alias("common")
        return met.groupBy("a", "b", "n", "n2").agg(both).where(self.enough("n", "n2", "common"))

    def enough(self, n: str, n2: str, common: str | None = None) -> Column:
        """Whether sizes n and n2 can reach the threshold, and with so many shingles common to both prefixes."""
        sizes = F.least(n, n2) >= self.least(n, n2)
        return sizes if common is None else sizes & self.reached(n, n2, F.col(common))

    def least(self, n: str, n2: str) -> Column:
        return F.expr(f"((cast({n} as long) + {n2}) * {self.num}L + {self.num + self.den - 1}) div {self.num + self.den}")

    def reached(self, n: str, n2: str, common: Column) -> Column:
        """Of sets that overlap in `least` shingles, the first n - least + l and n2 - least + l have l in common."""
        # shingles that a prefix leaves out
        out = [F.expr(f"({c} * {self.num}L + {self.den - 1}) div {self.den}") - EXTRA for c in (n, n2)]
        return common >= self.least(n, n2) - F.greatest(F.lit(0), *out)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        need = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        texts = cut(self.texts_for(need), "texts")
        with_a = pairs.join(texts.toDF("a", "packed_a"), "a")
        both = with_a.join(texts.toDF("b", "packed_b"), "b").select("a", "b", "packed_a", "packed_b")
        return cut(map_batches(both, _verify(self.k, self.num, self.den), "a binary, b binary, linked boolean").where("linked").select("a", "b"), "linked")

    def texts_for(self, need: DataFrame) -> DataFrame:
        """key and packed text of the keys needed. A filter of some bits a key passes over most other texts; the join after it is exact."""
        need = cut(need, "need")
        size = min(max(FILTER_BITS[0], 1 << (64 * need.count()).bit_length()), FILTER_BITS[1])
        ids = need.join(self.reps, "key").where("doc_id IS NOT NULL").select("doc_id")

        def slots(batches):
            for batch in batches:
                at = np.unique(slot(batch.column("doc_id").to_numpy(), size))
                yield {"word": at >> 5, "bit": np.left_shift(1, at & 31)}

        words = map_batches(ids, slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        have = np.zeros(size, np.uint8)
        word, bits = words["word"].to_numpy(), words["bits"].to_numpy()
        for j in range(32):
            have[(word[(bits >> j) & 1 == 1] << 5) + j] = 1
        packed = zstandard.compress(np.packbits(have).tobytes(), 3)
        texts = map_batches(self.texts, _wanted(self.k, packed, size), "key binary, packed binary").join(need, "key", "left_semi")
        return map_batches(texts.repartition("key"), _once, "key binary, packed binary")


def linked_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: near-duplicate groups of whole texts."""
    return Join(docs, k, num, den).run()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, its columns as they were: of the smallest doc_id that isn't null, of rows that repeat it the one with the smallest set and then text.

    Rows belong together by their texts alone: two of one doc_id with different texts are two documents. Rows without words stay, each.
    """
    own, doc, nameless = (free(name, docs.columns) for name in ("_set", "_doc", "_nameless"))
    at, names, number = docs.columns.index("text"), [f"`{c.replace('`', '``')}`" for c in docs.columns], F.col("doc_id").cast("long")

    def with_key(batch):
        keys = [key_of(x) for x in sets_of([t or "" for t in batch.column(at).to_pylist()], k)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, own])

    keyed = change_batches(docs, with_key, StructType().add(own, "binary"))
    firsts = Join(docs, k, num, den).firsts().select(F.col("key").alias(own), F.coalesce("doc_id", F.lit(-1)).alias(doc), F.col("doc_id").isNull().alias(nameless))
    there = keyed.withColumn(doc, F.coalesce(number, F.lit(-1))).withColumn(nameless, number.isNull())
    # by the doc_id too, so that copies of one text don't meet in one task
    kept = there.join(firsts, [own, doc, nameless], "left_semi")
    # maps and variants have no order
    sortable = [n for n, f in zip(names, docs.schema.fields, strict=True) if not {"map<", "variant"} & set(re.findall("map<|variant", f.dataType.simpleString()))]
    row = F.min_by(F.struct(*names), F.struct("text", F.xxhash64(*sortable)))
    kept = kept.groupBy(own, doc, nameless).agg(row.alias("_row")).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
    return kept.union(keyed.where(F.col(own).isNull()).select(*names))


def free(name: str, columns: list[str]) -> str:
    """name, made longer until it is none of columns."""
    while name in columns:
        name += "_"
    return name


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), 3, 90, 100)


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, CAST(max(n.n) AS BIGINT) AS n_shingles, min(b) AS component_id FROM r JOIN n ON n.doc_id = a GROUP BY a"""


QUERIES = {"op4_grouped_prefix_join": op4_grouped_prefix_join}
ORACLE_SQL = {"op4_grouped_prefix_join": SQL}
