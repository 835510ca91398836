"""Nearest neighbours by additive quantisation.

Vectors are scaled to length 1 and coded as a sum of full-dimensional codewords, one from each codebook. Codebooks are
k-means centres of the residuals of a bounded sample; a beam search finds each vector's codewords, and the squared length of
their sum is stored with them. A query scores a code by the sum of looked-up inner products over that
length; the best are ranked again by exact cosines of the original vectors. Queries and codes meet in blocks.

Every query is held against every code: the work grows with queries times rows, the shuffle of codes with the blocks of queries. Blocks of queries grow with
their number up to the memory of a task. Lists of codes by a first codeword would leave out too much: with these
vectors, 64 of 256 such lists hold 0.8 of the five nearest, and 128 hold 0.94.

Defined cases: components may have any finite magnitude; vectors that are null, zero, not finite, hold nulls or have another number of components than most
take no part; rows with a null vec_id take no part; equal nearness goes to the smaller vec_id. Of rows that repeat the vec_id of a query, the one with the
smallest vector asks, and the others are candidates as any row is; a repeated vec_id may thus stand several times in a result. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hashed_sample, map_batches, table

#: Codebooks, codewords in each, hypotheses kept by the beam search, vectors that codebooks are fitted on.
BOOKS, WORDS, BEAM, FIT_ROWS, ROUNDS = 16, 256, 4, 8_000, 6
#: Candidates of a query in each lane of codes that are ranked again, and rows of a block of codes.
RERANK, CODE_BLOCK = 300, 8192
#: Rows of a block of queries, the least and the most, blocks that there are between these, and rows that are scored at once.
QUERY_BLOCK, QUERY_BLOCKS, SCORED = (512, 8192), 16, 512
#: Codes are dealt into lanes, whose blocks one task holds against a block of queries, keeping the best of all of them: the fewest lanes, and the most blocks of one.
LANES, LANE_BLOCKS = 2, 64


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, 1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres.astype(np.float32)


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks x codewords x dimensions; x has unit rows."""
    left, books = x.copy(), []
    for k in range(BOOKS):
        book = kmeans(left, WORDS, k)
        books.append(book)
        left -= book[np.argmax(left @ book.T - (book**2).sum(1) / 2, 1)]
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the squared lengths of what they stand for."""
    n, d = x.shape
    left, error = x[:, None].copy(), np.zeros((n, 1), np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        length = (book**2).sum(1)
        cost = error[:, :, None] + length - 2 * (left @ book.T)
        width = cost.shape[1]
        flat = cost.reshape(n, width * WORDS)
        best = np.argpartition(flat, BEAM - 1, 1)[:, :BEAM]
        row = np.arange(n)[:, None]
        parent, word = best // WORDS, best % WORDS
        error = flat[row, best]
        left = left[row, parent] - book[word]
        codes = np.concatenate((codes[row, parent], word[:, :, None].astype(np.uint8)), 2)
    chosen = codes[np.arange(n), error.argmin(1)]
    made = sum(books[k][chosen[:, k]] for k in range(len(books)))
    return chosen, (made**2).sum(1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to 0.5 or more and below 1: squares neither vanish nor overflow, and no other digit changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    own = own.where(finite)
    size = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    return own.where(F.size("v") == (size[0]["d"] if size else 0))


def matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def search(embeddings: DataFrame, step: int = 50, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose vec_id is divisible by step."""
    spark = embeddings.sparkSession
    own = cut(clean(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = hashed_sample(own, ["vec_id", "v"], FIT_ROWS).select("v").toArrow()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], empty)
    books = fit(unit(matrix(sample["v"].combine_chunks())).astype(np.float32))
    blocks = max(1, -(-own.count() // CODE_BLOCK))

    def code(batches):
        for batch in batches:
            codes, length = encode(unit(matrix(batch.column("v"))).astype(np.float32), books)
            yield {"vec_id": batch.column("vec_id"), "row": batch.column("row"), "code": [c.tobytes() for c in codes], "length": length, "block": batch.column("block")}

    # by the hash of a row, so that equal vectors and ids are dealt out too
    dealt = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    codes = map_batches(dealt, code, "vec_id long, row long, code binary, length float, block int").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "code", "length"))).alias("codes"))
    queries = own.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min(F.struct("v", "row")).alias("r")).select("vec_id", "r.v", "r.row")
    asked_rows = queries.count()
    query_blocks = max(1, -(-asked_rows // min(max(QUERY_BLOCK[0], asked_rows // QUERY_BLOCKS), QUERY_BLOCK[1])))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).groupBy("q").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("row").alias("rows"), F.flatten(F.collect_list("v")).alias("v"))
    # codes are shorter than the candidates that a block of them would give, so they travel to the queries
    lanes = max(LANES, -(-blocks // LANE_BLOCKS))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    codes = codes.withColumn("lane", F.col("block") % lanes).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def score(batches):
        # rows of a block of queries and lane come one after the other; if they don't, only more candidates come out
        now, ids, best = None, None, []

        def kept():
            for i, (vec, row, near) in enumerate(best):
                yield {"query_id": np.full(len(row), ids[i]), "vec_id": vec, "row": row, "near": near}

        for batch in batches:
            key = (batch.column("q")[0].as_py(), batch.column("lane")[0].as_py())
            if key != now:
                yield from kept()
                now, ids, rows = key, batch.column("ids")[0].values.to_numpy(), batch.column("rows")[0].values.to_numpy()
                x = unit(batch.column("v")[0].values.to_numpy().reshape(len(ids), -1)).astype(np.float32)
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(ids)
            held = batch.column("codes")[0].values
            vec, row, length = (held.field(c).to_numpy() for c in ("vec_id", "row", "length"))
            code = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(vec), -1)
            for first in range(0, len(ids), SCORED):
                part = x[first : first + SCORED]
                near = np.zeros((len(part), len(vec)), np.float32)
                for b in range(code.shape[1]):
                    near += (part @ books[b].T)[:, code[:, b]]
                near /= np.sqrt(np.maximum(length, 1e-12))
                for i, scores in enumerate(near, first):
                    scores[row == rows[i]] = -np.inf
                    most = min(len(vec), rerank)
                    good = np.flatnonzero(scores >= -np.partition(-scores, most - 1)[most - 1])
                    columns = [np.concatenate((old, new[good])) for old, new in zip(best[i], (vec, row, scores), strict=True)]
                    order = np.lexsort((columns[1], columns[0], -columns[2]))[:rerank]
                    best[i] = tuple(c[order] for c in columns)
        yield from kept()

    met = asked.hint("merge").join(codes, ["q", "lane"])
    found = _one_by_one(met.select("q", "lane", "ids", "rows", "v", "codes"), score, "query_id long, vec_id long, row long, near float").where("near > float('-Infinity')")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "row")
    best = found.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= rerank).select("query_id", "row").distinct()
    with_v = best.join(own, "row").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "query_id")

    def exact(batches):
        for batch in batches:
            x, y = scaled(matrix(batch.column("v"))), scaled(matrix(batch.column("w")))
            s = (x * y).sum(1) / (np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1)))
            yield {"query_id": batch.column("query_id"), "vec_id": batch.column("vec_id"), "row": batch.column("row"), "score": s}

    scored = map_batches(with_v.select("query_id", "vec_id", "row", "v", "w"), exact, "query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_by_one(df: DataFrame, work, schema: str) -> DataFrame:
    """As map_batches, with one row of blocks to an Arrow batch."""
    return map_batches(df, lambda batches: work(one for b in batches for one in (b.slice(i, 1) for i in range(b.num_rows))), schema)


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_additive_quantisation": op9_additive_quantisation}
ORACLE_SQL: dict[str, str] = {}
