"""Quality by Bradley-Terry pairwise ranking.

Preference pairs set a document of label 1 over one of label 0; logistic loss on the differences of their
features gives the weights of a ranking score. A quantile of the training scores is the threshold, and the score is
mapped to 0 to 1 so that the threshold comes to lie at CUT.

The model is fitted on at most FIT_ROWS labelled documents, chosen by the hash of doc_id, out of those in the training
folds (crc32 of doc_id as text, modulo 5, is not 0). Features come from the text alone.

Defined cases: a null text is an empty one and gets a score; a doc_id whose label rows disagree counts as its largest
label; without labels of both kinds every score is 1 (keep all); a null doc_id is not held out; repeated rows
come back as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_labels, keep_batches, map_batches, table, texts_of

FIT_ROWS, PAIRS, RIDGE, STEPS, CUT = 20_000, 60_000, 1e-3, 40, 0.3
NAMES = (
    "upper", "digit", "space", "newline", "stop", "comma", "bar", "shout", "marks", "brackets", "quotes", "control", "high", "log_bytes", "log_words", "word_bytes", "long_words", "short_words",
    "distinct", "again", "common_word", "repeated_lines", "line_words", "marked_words", "upper_words", "title_words", "empty",
)


def _classes() -> np.ndarray:
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "|", "!?", "#$%&*@^~+=<>", "()[]{}", "\"'`"]
    out = np.zeros((256, 13))
    for k, chars in enumerate(groups):
        out[list(chars.encode()), k] = 1
    out[:32, 11], out[10, 11], out[128:, 12] = 1, 0, 1
    return out


CLASSES = _classes()


def features(texts: list[str]) -> np.ndarray:
    """A row of NAMES for each text."""
    counts, more = np.zeros((len(texts), 256)), np.zeros((len(texts), len(NAMES) - 13))
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        counts[k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = text.split()
        n = max(1, len(words))
        tally = Counter(words)
        lines = text.split("\n")
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        more[k] = (
            np.log1p(len(raw)), np.log1p(len(words)), min(lengths.mean(), 30), (lengths > 15).mean(), (lengths < 3).mean(), len(tally) / n,
            sum(map(str.__eq__, words, words[1:])) / n, max(tally.values(), default=0) / n if len(words) > 19 else 0, 1 - len(set(lines)) / len(lines), min(len(words) / len(lines), 100) / 100,
            sum(c for w, c in tally.items() if not w[-1].isalnum() and w[-1] not in ".,") / n, sum(c for w, c in tally.items() if w.isupper()) / n, sum(c for w, c in tally.items() if w.istitle()) / n, not words,
        )
    share = counts @ CLASSES / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.concatenate((share, more), 1)


class Ranking:
    """Weights, scale and threshold; learned from features and labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0) if len(x) else np.zeros(len(NAMES)), np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(NAMES))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights, self.at, self.slope = np.zeros(len(NAMES)), -1e9, 1.0
        if not len(good) or not len(bad):
            return
        z = self.standard(x)
        rng = np.random.default_rng(7)
        n = max(PAIRS, len(bad))
        d = z[rng.permutation(np.resize(good, n))] - z[np.resize(bad, n)]
        w = self.weights
        for _ in range(STEPS):  # Newton on the mean logistic loss of differences
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w)), d.T @ p / n - RIDGE * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        s = z @ w
        levels = np.unique(np.quantile(s, np.linspace(0, 1, 2001), method="midpoint"))
        ordered_good, ordered_bad = np.sort(s[good]), np.sort(s[bad])
        wrong = np.searchsorted(ordered_good, levels) + len(bad) - np.searchsorted(ordered_bad, levels)
        best = np.flatnonzero(wrong == wrong.min())
        self.at = float(levels[best[len(best) // 2]])
        self.slope = 1.5 / max(float(np.quantile(np.abs(s - self.at), 0.25)), 1e-6)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        away = np.clip(self.slope * (self.standard(x) @ self.weights - self.at), -50, 50)
        # rounded, since sums of a text's features may differ in their last digits from batch to batch
        return np.round(1 / (1 + np.exp(-away) * (1 - CUT) / CUT), 12)


def _rows(batches):
    for batch in batches:
        yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": list(features(batch.column("text").to_pylist()))}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ranking:
    """The model of a bounded sample of labelled documents in the training folds; of rows that repeat a doc_id one counts, that with the smallest features."""
    inside = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = bounded_labels(inside, "quality", rows)
    # at most `rows` rows of 12 bytes
    own = texts_of(docs).join(F.broadcast(chosen), "doc_id")
    one = map_batches(own.select("doc_id", "label", "text"), _rows, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"))
    got = one.toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(NAMES))
    y = got["label"].to_numpy()
    by = np.lexsort((*x.T, y))
    return Ranking(x[by], y[by])


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; no shuffle."""

    def work(batches):
        for batch in batches:
            s = model.score(features(batch.column("text").to_pylist()))
            yield {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    out = map_batches(texts_of(docs), work, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns; a null text is rejected as an empty one."""
    return keep_batches(docs, lambda texts: model.score(features(texts)) >= CUT)


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_pairwise_quality": op2_pairwise_quality}
ORACLE_SQL: dict[str, str] = {}
