"""Severity of toxicity by cumulative-link ordinal regression.

Features are a text's distinct words and their beginnings of 4 to 8 letters, sparse and binary. A first look at the
labelled documents, counted by Spark, keeps the features that stand out in toxic ones beyond chance, with a group of near copies counting once.
One vector of weights serves all ordered thresholds: P(grade > k) = sigmoid(w x - t_k). The
result is the expected severity; a document is toxic where it reaches CUT.

Grades are those of the labels, 0 for clean. Labels that only say 0 or 1 hold no order: then grades 1 to GRADES - 1 of toxic documents
follow from how many words with such features they hold.

The model is fitted on at most FIT_ROWS labelled documents, chosen by the hash of doc_id, in the folds in which crc32
of doc_id as text, modulo 5, is not 0; the others measure it. Nothing but the text is an input of a score.

Defined cases: a null text is an empty one, which is clean; a doc_id whose label rows disagree counts as its largest
label, and of rows of documents that repeat a doc_id one is learned from; grades above GRADES - 1 count as that; without toxic or without clean labels, or where no feature stands out, every severity is 0; repeated rows and null doc_ids come back as they came; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_labels, cut, keep_batches, map_batches, table, texts_of

FIT_ROWS, GRADES, CUT = 8_000, 4, 0.5
#: A feature's share of toxic documents among those that hold it, the chance of any wrong feature, and the most features.
PURE, CHANCE, MOST = 0.9, 0.05, 5_000
BEGINNINGS = (4, 5, 6, 7, 8)
RIDGE, STEPS = 1e-4, 500
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


def near(text: str) -> int:
    """The least hashes, by two functions, of a text's three-word shingles: near copies mostly share them."""
    words = text.lower().split()
    own = [" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))]
    return (min(map(zlib.crc32, own)) << 31) ^ min(zlib.crc32(b"2" + x) for x in own)


class Severity:
    """Weights of features and ordered thresholds."""

    def __init__(self, features: list[str]) -> None:
        self.chosen = features
        self.weights = dict.fromkeys(features, 1.0)
        self.thresholds = np.full(GRADES - 1, 50.0)

    def features(self, words: set[str]) -> set[str]:
        known = self.weights.keys()
        return (words & known) | (beginnings(words) & known)

    def marked(self, words: set[str]) -> int:
        """How many words are features or begin with one."""
        known = self.weights
        return sum(w in known or any(w[:n] + "*" in known for n in BEGINNINGS if len(w) >= n) for w in words)

    def fit(self, rows: list[tuple[tuple[int, ...], int]]) -> Severity:
        """Learns from places of features and grades: gradient steps, each feature at a rate of its own, on the mean loss of all thresholds."""
        size = len(self.chosen)
        tally = Counter(rows)  # equal rows count together
        kinds = sorted(tally)
        number = np.array([tally[k] for k in kinds], float) / len(rows)
        owner = np.repeat(np.arange(len(kinds)), [len(x) for x, _ in kinds])
        index = np.array([i for x, _ in kinds for i in x], np.int64)
        above = np.array([[g > k for k in range(GRADES - 1)] for _, g in kinds], float)
        share = above.T @ number
        w, t = np.zeros(size), -np.log((share + 1e-4) / (1 - share + 1e-4))
        seen_w, seen_t = np.full(size, 1e-8), np.full(GRADES - 1, 1e-8)
        for _ in range(STEPS):
            s = np.bincount(owner, w[index], len(kinds))
            miss = (1 / (1 + np.exp(np.clip(t[None] - s[:, None], -50, 50))) - above) * number[:, None]
            by_w = np.bincount(index, miss.sum(1)[owner], size) + RIDGE * w / max(1, size) ** 0.5 * 0.1
            by_t = -miss.sum(0)
            seen_w, seen_t = seen_w * 0.9 + by_w**2 * 0.1, seen_t * 0.9 + by_t**2 * 0.1
            w = np.maximum(w - 0.05 * by_w / np.sqrt(seen_w), 0)
            t = np.sort(t - 0.05 * by_t / np.sqrt(seen_t))
        self.weights, self.thresholds = dict(zip(self.chosen, w.tolist(), strict=True)), t
        return self

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        known = self.weights
        s = np.array([sum(known[f] for f in sorted(self.features(words_of(t)))) for t in texts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - s.reshape(-1, 1), -50, 50)))


def _looks(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "near": [near(t) for t in texts], "words": [" ".join(sorted(words_of(t))) for t in texts]}


def _counts(batches):
    """Documents of a task that hold each feature, clean and toxic ones; given out now and then, so that they stay few."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def rows(one: int) -> dict:
        found = held[one]
        return {"feature": list(found), "toxic": [one] * len(found), "n": list(found.values())}

    for batch in batches:
        for words, label in zip(batch.column("words").to_pylist(), batch.column("label").to_pylist(), strict=True):
            own = set(words.split())
            held[int(label > 0)].update(own | beginnings(own))
        for one in (0, 1):
            if len(held[one]) > 200_000:
                yield rows(one)
                held[one].clear()
    yield rows(0)
    yield rows(1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, column: str = "toxic") -> Severity:
    """The model of a bounded sample of labelled documents in the training folds; the driver gets at most MOST features, and for each document its places among them."""
    inside = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = bounded_labels(inside, column, rows)
    # at most `rows` rows of 12 bytes
    own = texts_of(docs).join(F.broadcast(chosen), "doc_id")
    looks = map_batches(own.select("doc_id", "label", "text"), _looks, "doc_id long, label int, near long, words string")
    looks = cut(looks.groupBy("doc_id").agg(F.min(F.struct("label", "near", "words")).alias("r")).select("r.*"), "looks")
    # near copies count once
    once = looks.groupBy("near", (F.col("label") > 0).alias("toxic")).agg(F.min("words").alias("words"), F.max("label").alias("label"))
    found = map_batches(once.select("label", "words"), _counts, "feature string, toxic int, n long")
    found = cut(found.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all")).where("bad > 0"), "features")
    sizes = once.agg(F.count("*").alias("n"), F.count_if("toxic").alias("bad"), F.max("label").alias("top")).first()
    if not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return Severity([])
    chance = np.log(max(1.0, found.count() / CHANCE)) / np.log(sizes["n"] / sizes["bad"])
    best = found.where((F.col("bad") >= float(max(3.0, chance))) & (F.col("bad") >= PURE * F.col("all"))).orderBy(F.desc("bad"), "feature").limit(MOST)
    model = Severity(best.toArrow()["feature"].to_pylist())
    if not model.chosen:
        return model
    place, ordered = {f: k for k, f in enumerate(model.chosen)}, sizes["top"] > 1

    def places(batches):
        for batch in batches:
            at, grades = [], []
            for words, label in zip(batch.column("words").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = set(words.split())
                at.append(sorted(place[f] for f in model.features(own)))
                grades.append(min(max(label, 0), GRADES - 1) if ordered or label <= 0 else max(1, min(GRADES - 1, model.marked(own))))
            yield {"at": at, "grade": grades}

    got = map_batches(looks.select("label", "words"), places, "at array<int>, grade int").toArrow()
    return model.fit([(tuple(x), g) for x, g in zip(got["at"].to_pylist(), got["grade"].to_pylist(), strict=True)])


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, held_out, expected_severity, grade (the likeliest) and toxic for each row of docs; no shuffle."""

    def work(batches):
        for batch in batches:
            above = model.above(batch.column("text").to_pylist())
            each = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), 1), axis=1)
            yield {"doc_id": batch.column("doc_id"), "expected_severity": above.sum(1), "grade": each.argmax(1).astype(np.int32), "toxic": (above.sum(1) >= CUT).astype(np.int32)}

    out = map_batches(texts_of(docs), work, "doc_id long, expected_severity double, grade int, toxic int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "expected_severity", "grade", "toxic")


def keep(docs: DataFrame, model: Severity) -> DataFrame:
    """The rows of docs that aren't toxic, with their columns; a null text is clean."""
    return keep_batches(docs, lambda texts: model.above(texts).sum(1) < CUT)


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_ordinal_toxicity": op8_ordinal_toxicity}
ORACLE_SQL: dict[str, str] = {}
