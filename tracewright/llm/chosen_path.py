"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Each different set of word shingles has COORDINATES minwise tokens: its smallest shingle under as many hashes. A tree starts
with all sets and branches by chosen tokens: a node picks CHILDREN coordinates by its own number, and sets with the same token
there meet in a child. Sets that have little in common part after a level or two; small nodes are compared exhaustively.
Two sets of similarity s agree in a coordinate with probability s, so a pair at the threshold of 0.8 loses its way in one tree
with a probability of ((1 - s) / s) ** 2 = 1 / 16 however deep the tree grows, and TREES independent trees miss it with 1 / 16 ** 8,
about 2 in 10 ** 10; less likely than a wrong estimate (below). The target recall is 1 - 10 ** -5 of the pairs at the very threshold.

A comparison first looks at how many tokens agree: a pair at the threshold has fewer than 79 of 128, five deviations less than it
should, with a probability below 10 ** -5, and is then lost; sets that pass are alike. What a node tells is only which of its sets hang together by
being alike: a pair that does already isn't looked at, and no group of copies is made into its pairs. Sets that hang together by the
nodes of all trees are a cluster; every link lies within one, and clusters are far smaller than what shares a node.

Each cluster is then confirmed on the full sets of shingles: its members meet in a task, pairs alike are intersected, and linked ones
joined, so that its components come out; again without looking at pairs that are joined already.

Large nodes: up to NODE sets are branched within a task. Larger ones are dealt into parts that share some sets first, and where a node
then holds several clusters it is branched by a shuffle a level. A node whose children would hold more than half of its pairs is a crowd of sets
alike: it isn't branched, and blocks of the sets outside its largest cluster meet those inside it and each other. Clusters of more than WEIGHT shingles are
confirmed in the same way, by parts first and then by blocks of what isn't in the largest component.

Equal sets are one set from the first pass on. The first pass writes 0.3 kB for each different text; after it only numbers and
tokens of sets that meet another travel, and the packed texts of clusters, which are read once.

Defined cases: as in the grouped prefix join. Texts without words, or null, have an empty set and stand alone; a component's id
is its smallest non-null doc_id (null if it has none), and a row is kept if its doc_id is that, null with null; repeated rows come back
as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, table
from .shingle_join import Join, U, components, key_of, merged, mix, sets_of

#: Minwise tokens of a set (one byte each), trees, and children that a node's sets are dealt to.
COORDINATES, TREES, CHILDREN = 128, 8, 2
#: The least threshold, at which a tree loses a pair with a probability of 0.18, and deviations that the agreement of candidates may stay below what is expected.
LOWEST, DEVIATIONS = 0.7, 5
#: Sets of a node that is compared exhaustively, and of one that a task branches; shingles of a cluster that a task confirms; sets that the parts of a larger node or cluster share.
LEAF, NODE, WEIGHT, SHARED = 64, 4096, 1 << 21, 16
#: Shingles whose tokens are taken at once, and rows of nodes that are compared at once.
SHINGLES, ROWS = 1 << 16, 1 << 16

ODD = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of each set, none of them empty, under each of the hashes."""
    every, start = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), U)
    for i, a in enumerate(ODD):
        out[:, i] = np.minimum.reduceat(every * a, start)
    return out


def tokens_and_paths(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte of each minwise token, and the first nodes of all trees, which take whole tokens."""
    mixed = mix(least + np.arange(COORDINATES, dtype=U))
    return (mixed & U(0xFF)).astype(np.uint8), mix(mixed[:, : TREES * CHILDREN] + U(1)).view(np.int64)


def children(node: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """The child of each row in each of the coordinates that its node picks."""
    node = node.view(U)
    first = (mix(node) % U(COORDINATES)).astype(np.int64)
    other = (first + 1 + (mix(node + U(1)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    rows = np.arange(len(node))
    return [mix(node * U(3) + mix(at.astype(U) * U(256) + tokens[rows, at] + U(1))).view(np.int64) for at in (first, other)]


def groups(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of stretches of equal nodes."""
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(node)), bool), node[1:] != node[:-1])))
    return start, np.diff(np.append(start, len(node)))


def least_alike(num: int, den: int) -> int:
    """Tokens that two sets at the threshold agree in, but for a probability that is small enough."""
    p = num / den
    if not LOWEST <= p <= 1:
        raise ValueError(f"a threshold of {num} / {den} is outside {LOWEST} to 1")
    return int(COORDINATES * p - DEVIATIONS * (COORDINATES * p * (1 - p)) ** 0.5)


class Labels:
    """Which rows hang together, by the same label; rows of the same given number do from the start."""

    def __init__(self, given: np.ndarray) -> None:
        _, first, at = np.unique(given, return_index=True, return_inverse=True)
        self.of = first[at]

    def top(self, i: int) -> int:
        while self.of[i] != i:
            i = self.of[i] = self.of[self.of[i]]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.of[max(x, y)] = min(x, y)
        while not np.array_equal(up := self.of[self.of], self.of):
            self.of = up


def compared(node: np.ndarray, row: np.ndarray, own: Read, labels: Labels) -> None:
    """Joins rows of one node that are alike; node is in order. Each is compared with the next, the one after and so on."""
    i, k = np.arange(len(node)), 1
    while len(i):
        i = i[i + k < len(node)]
        i = i[node[i + k] == node[i]]
        x, y = row[i], row[i + k]
        apart = labels.of[x] != labels.of[y]
        x, y = x[apart], y[apart]
        x, y = own.alike(x, y)
        if len(x):
            labels.join(x, y)
        k += 1


def descend(node: np.ndarray, own: Read, labels: Labels, leaf: int) -> None:
    """Joins rows below whole nodes, which are branched until they are small, hang together, or are crowds of sets alike."""
    row = np.argsort(node, kind="stable")
    node = node[row]
    while len(row):
        start, size = groups(node)
        parent, after, below = np.repeat(np.arange(len(start)), size), np.zeros(len(start)), []
        for child in children(node, own.tokens[row]):
            order = np.argsort(child, kind="stable")
            first, held = groups(child[order])
            # pairs that the children of each node would hold
            after += np.bincount(parent[order[first]], held * (held - 1.0), len(start))
            below.append((order, child[order]))
        stop = np.repeat((size <= leaf) | (after > size * (size - 1.0) / 2), size)
        compared(node[stop], row[stop], own, labels)
        rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for order, child in below:
            go = ~stop[order]
            r, child = row[order][go], child[go]
            first, held = groups(child)
            if len(first):
                several = np.minimum.reduceat(labels.of[r], first) < np.maximum.reduceat(labels.of[r], first)
                keep = np.repeat(several, held)
                rows.append(r[keep])
                nodes.append(child[keep])
        row, node = np.concatenate(rows), np.concatenate(nodes)
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]


def by_cell(own: Read) -> np.ndarray:
    """The given numbers of rows, which count within their cells alone, as numbers of the whole part."""
    return mix(own.cell.view(U)) ^ own.given.view(U)


def stars(own: Read, labels: Labels) -> dict:
    """Of each label with several given numbers, an edge from one row of each to the smallest key."""
    # a label lies within a cell
    one = np.unique(mix(labels.of.astype(U)) ^ own.given.view(U), return_index=True)[1]
    first: dict[int, bytes] = {}
    for i in one.tolist():
        label = int(labels.of[i])
        first[label] = min(own.keys[i], first.get(label, own.keys[i]))
    ends = [(own.keys[i], first[int(labels.of[i])]) for i in one.tolist()]
    return {"a": [a for a, b in ends if a != b], "b": [b for a, b in ends if a != b]}


def roots_of(own: Read, labels: Labels) -> dict:
    """Each row with the smallest key of its label."""
    first: dict[int, bytes] = {}
    for label, key in zip(labels.of.tolist(), own.keys, strict=True):
        first[label] = min(key, first.get(label, key))
    return {"a": own.keys, "b": [first[label] for label in labels.of.tolist()]}


def linked(sets: list[np.ndarray], own: Read, labels: Labels) -> None:
    """Joins rows whose sets are as similar as the threshold asks for."""
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum([0, *map(len, sets)])
    mark = np.zeros(int(dense.max(initial=-1)) + 1, np.int64)
    for i in range(len(sets) - 1):
        j = np.flatnonzero(labels.of[i + 1 :] != labels.of[i]) + i + 1
        _, j = own.alike(np.full(len(j), i), j)
        if not len(j):
            continue
        mine = dense[start[i] : start[i + 1]]
        mark[mine] = 1
        both = np.array([int(mark[dense[start[x] : start[x + 1]]].sum()) for x in j.tolist()])
        mark[mine] = 0
        yes = own.den * both >= own.num * (own.n[i] + own.n[j] - both)
        if yes.any():
            labels.join(np.full(int(yes.sum()), i), j[yes])


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def whole_nodes(batches, most: int = ROWS) -> Iterator[pa.Table]:
    """The rows of ordered batches in parts of about so many that cut no cell; the order is that of their cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            both = pa.Table.from_batches(held)
            start, _ = groups(both["cell"].to_numpy())
            if start[-1]:
                yield both.slice(0, int(start[-1]))
            held = both.slice(int(start[-1])).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


class Read:
    """Columns of a part of the rows of cells, and which of them are alike."""

    def __init__(self, part: pa.Table, num: int, den: int) -> None:
        part = part.combine_chunks()
        self.cell, self.keys, self.tokens = part["cell"].to_numpy(), part["key"].to_pylist(), fixed(part["tokens"], COORDINATES)
        self.n, self.given = part["n"].to_numpy().astype(np.int64), part["r"].to_numpy()
        self.num, self.den, self.least = num, den, least_alike(num, den)

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of rows whose sizes and tokens allow a link."""
        a, b = self.n[i], self.n[j]
        yes = self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)
        i, j = i[yes], j[yes]
        yes = (self.tokens[i] == self.tokens[j]).sum(axis=1) >= self.least
        return i[yes], j[yes]


def _signed(k: int):
    def work(batches):
        seen = set()
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text").to_pylist(), k), strict=True))
            out = {"doc_id": [i for i, _ in rows], "key": [key_of(own) for _, own in rows], "n": [len(own) for _, own in rows]}
            tokens, paths = [None] * len(rows), [None] * len(rows)
            new = [j for j, key in enumerate(out["key"]) if key is not None and key not in seen and not seen.add(key)]
            while new:
                ends = np.cumsum([out["n"][j] for j in new])
                now, new = np.split(new, [max(1, int(np.searchsorted(ends, SHINGLES, "right")))])
                for j, own, path in zip(now.tolist(), *tokens_and_paths(minwise([rows[j][1] for j in now])), strict=True):
                    tokens[j], paths[j] = own.tobytes(), path
                new = new.tolist()
            yield out | {"tokens": tokens, "paths": paths}

    return work


def _hang(num: int, den: int, leaf: int):
    """What hangs together below whole nodes."""

    def work(batches):
        for part in whole_nodes(batches):
            own = Read(part, num, den)
            labels = Labels(by_cell(own))
            descend(own.cell, own, labels, leaf)
            yield stars(own, labels)

    return work


def _across(num: int, den: int):
    """What hangs together in cells that aren't branched."""

    def work(batches):
        for part in whole_nodes(batches):
            own = Read(part, num, den)
            labels = Labels(by_cell(own))
            compared(own.cell, np.arange(len(own.cell)), own, labels)
            yield stars(own, labels)

    return work


def _exact(k: int, num: int, den: int, everyone: bool):
    """What is linked in each cell, by full sets."""

    def work(batches):
        open_up = zstandard.ZstdDecompressor()
        for several in whole_nodes(batches, 1):
            start, size = groups(several["cell"].to_numpy())
            for at, rows in zip(start.tolist(), size.tolist(), strict=True):
                part = several.slice(at, rows)
                own = Read(part, num, den)
                sets = list(sets_of([open_up.decompress(x).decode("utf-8", "surrogatepass") for x in part["packed"].to_pylist()], k))
                labels = Labels(own.given)
                linked(sets, own, labels)
                yield roots_of(own, labels) if everyone else stars(own, labels)

    return work


def _branch(batches):
    for batch in batches:
        node, ident, r = (batch.column(c).to_numpy() for c in ("node", "id", "r"))
        for child in children(node, fixed(batch.column("tokens"), COORDINATES)) if len(node) else ():
            yield {"parent": node, "node": child, "id": ident, "r": r}


EDGES = "a binary, b binary"


class PathJoin(Join):
    """The join of docs: k-word shingles, Jaccard similarity of num / den or more. Sets of a small node, of one that a task branches, and shingles of a cluster that one task confirms are parameters for tests."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, leaf: int = LEAF, node: int = NODE, weight: int = WEIGHT) -> None:
        super().__init__(docs, k, num, den)
        least_alike(num, den)
        self.leaf, self.node, self.weight = leaf, node, weight

    def roots(self) -> DataFrame:
        first = cut(map_batches(self.texts, _signed(self.k), "doc_id long, key binary, n long, tokens binary, paths array<long>"), "sets")
        self.rows = first.select("doc_id", "key", "n")
        self.reps = self.rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        signed = first.where("tokens IS NOT NULL")
        ident = F.xxhash64("key").alias("id")
        entries = signed.select(F.explode("paths").alias("node"), ident)
        # a set that several tasks saw counts more than once, which only makes a node look larger
        live = entries.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("node", "size")
        placed = cut(entries.join(live, "node").distinct(), "placed")
        # only sets that meet another, each once
        self.signed = cut(signed.select(ident, "key", "n", "tokens").dropDuplicates(["id"]).join(placed.select("id").distinct(), "id", "left_semi"), "signed")
        cells = self.by_parts(placed.withColumn("parts", F.ceil(F.col("size") / self.node).cast("int")), "node", F.col("size"))
        hanging = self.in_cells(cells.withColumn("r", F.col("id")), _hang(self.num, self.den, self.leaf))
        clusters = components(hanging)
        large = placed.where(F.col("size") > self.node)
        if not large.isEmpty():
            clusters = merged(clusters, self.below(large, clusters))
        return self.confirmed(clusters)

    def by_parts(self, rows: DataFrame, group: str, size: Column) -> DataFrame:
        """rows with the cell of their group; a group of several parts has some rows in all of them, about SHARED, and each other in one."""
        shared = (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(9)), size) < SHARED)
        own = F.array(F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
        return rows.withColumn("_part", F.explode(F.when(shared, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))).withColumn("cell", F.xxhash64(group, "_part")).drop("_part")

    def in_cells(self, cells: DataFrame, work) -> DataFrame:
        """What work makes of the sets (id, r) of each cell, alike ones next to each other."""
        rows = cells.select("cell", "id", "r").join(self.signed, "id").drop("id")
        return map_batches(rows.repartition("cell").sortWithinPartitions("cell", "tokens"), work, EDGES)

    def below(self, placed: DataFrame, clusters: DataFrame) -> DataFrame:
        """What hangs together below nodes too large for a task, of different clusters."""
        r = self.signed.join(clusters, "key", "left").select("id", F.xxhash64(F.coalesce("root", "key")).alias("r"))
        rows = placed.select("node", "id").join(r, "id")
        stat = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        rows = cut(rows.join(stat.where("lo < hi").select("node", "size"), "node"), "mixed")
        found = []
        while True:
            few = rows.where(F.col("size") <= self.node)
            found.append(self.in_cells(few.withColumnRenamed("node", "cell"), _hang(self.num, self.den, self.leaf)))
            big = rows.where(F.col("size") > self.node)
            if big.isEmpty():
                break
            below = cut(map_batches(big.join(self.signed.select("id", "tokens"), "id").select("node", "id", "r", "tokens"), _branch, "parent long, node long, id long, r long"), "below")
            stat = below.groupBy("parent", "node").agg(F.count("*").alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"))
            after = stat.groupBy("parent").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1)).alias("after"))
            parents = big.select(F.col("node").alias("parent"), "size").distinct()
            dense = parents.join(after, "parent").where(F.col("after") > F.col("size").cast("double") * (F.col("size") - 1) / 2).select("parent")
            crowd = big.join(dense.withColumnRenamed("parent", "node"), "node", "left_semi")
            found.append(self.in_cells(self.blocks(crowd, "node", F.lit(1), self.node), _across(self.num, self.den)))
            go = stat.where("lo < hi").join(dense, "parent", "left_anti").select("parent", "node", F.col("c").alias("size"))
            rows = cut(below.join(go, ["parent", "node"]).select("node", "id", "r", "size"), "rows")
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return cut(out.distinct(), "hanging")

    def blocks(self, rows: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
        """Cells of up to about twice most for the rows (id, r) of large groups: blocks of those with another r than most have against blocks of those with it, and against each other."""
        largest = rows.groupBy(group, "r").agg(F.sum(weight).alias("w")).groupBy(group).agg(F.max(F.struct("w", "r")).alias("m"), F.sum("w").alias("all"))
        rows = cut(rows.join(largest, group).withColumn("other", F.col("r") != F.col("m.r")), "blocks")
        of_main, of_other = (F.greatest(F.lit(1), F.ceil(x / most)).cast("int") for x in (F.col("m.w"), F.col("all") - F.col("m.w")))
        block = lambda of: F.pmod(F.xxhash64("id", F.lit(7)), of).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
        cell = lambda kind, x, y: F.xxhash64(group, F.lit(kind), x, y).alias("cell")
        main, other = rows.where("NOT other"), rows.where("other")
        one = main.select(group, "id", "r", block(of_main).alias("x"), each(of_other).alias("y"))
        two = other.select(group, "id", "r", each(of_main).alias("x"), block(of_other).alias("y"))
        three = other.select(group, "id", "r", block(of_other).alias("x"), each(of_other).alias("y"))
        return one.union(two).select(cell(1, F.col("x"), F.col("y")), "id", "r").union(three.select(cell(2, F.least("x", "y"), F.greatest("x", "y")), "id", "r"))

    def confirmed(self, clusters: DataFrame) -> DataFrame:
        """key, smallest doc_id and root of each different set: the components of linked sets within clusters."""
        every = clusters.union(clusters.select("root", "root")).distinct()
        rows = cut(every.join(self.signed.select("id", "key", "n"), "key"), "clustered")
        self.packed = cut(rows.select("key", "id", "n").join(self.texts_for(rows.select("key")), "key").join(self.signed.select("id", "tokens"), "id"), "packed")
        heavy = rows.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("size")).where(F.col("weight") > self.weight)
        light = rows.join(heavy.select("root"), "root", "left_anti").select(F.xxhash64("root").alias("cell"), "id", F.col("id").alias("r"))
        found = self.exactly(light, everyone=True).toDF("key", "root")
        heavy = rows.join(heavy, "root")
        if not heavy.isEmpty():
            parts = heavy.withColumn("parts", F.ceil(F.col("weight") / self.weight).cast("int"))
            own = components(self.exactly(self.by_parts(parts, "root", F.col("size")).withColumn("r", F.col("id"))))
            r = heavy.withColumnRenamed("root", "cluster").join(own, "key", "left").select("cluster", "id", "n", F.xxhash64(F.coalesce("root", "key")).alias("r"))
            mixed = r.groupBy("cluster").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("cluster")
            found = found.union(merged(own, cut(self.exactly(self.blocks(r.join(mixed, "cluster"), "cluster", F.col("n"), self.weight)).distinct(), "links")))
        return self.reps.join(cut(found, "found"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))

    def exactly(self, cells: DataFrame, everyone: bool = False) -> DataFrame:
        """Links within cells (id, r): a star of each component with several r, or everyone with the smallest key of its component."""
        rows = cells.select("cell", "id", "r").join(self.packed, "id").drop("id")
        return map_batches(rows.repartition("cell").sortWithinPartitions("cell", "tokens"), _exact(self.k, self.num, self.den, everyone), EDGES)


def linked_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: near-duplicate groups of whole texts."""
    return PathJoin(docs, k, num, den).run()


def kept_or_not(found: DataFrame) -> DataFrame:
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_or_not(linked_components(table(spark, sf_dir, "documents"), 2, 80, 100))


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, CAST(max(n.n) AS BIGINT) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM r JOIN n ON n.doc_id = a GROUP BY a"""

QUERIES = {"op13_chosen_path": op13_chosen_path}
ORACLE_SQL = {"op13_chosen_path": SQL}
