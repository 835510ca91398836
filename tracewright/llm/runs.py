"""Runs of repeating words by heavy/light lag counting.

A run is a longest stretch of consecutive words whose smallest period q fits into it at least REPEATS times, and that has
LEAST words or more. A stretch of period q holds length - q places whose word is that q words later, so a lag q can only have
a run if at least max(LEAST - q, (REPEATS - 1) * q) places of the text match at it. Matches of all lags are counted at once:

- light words: the differences of all pairs of their places, up to the longest lag that can have a run;
- heavy words, for which these pairs would cost more than a transform: the exact autocorrelation of their places by FFT,
  power spectra summed up before one transform back. Counts are whole numbers far below 2 ** 53, so rounding gives them exactly.

Only lags with enough matches get a scan for islands of matches. Short lags are scanned in full. A longer lag q is scanned
block by block of q places: an island that is long enough holds a whole block, most blocks fall at their first few places, and
a block inside a run whose period divides q is left out, since the periodicity lemma makes both stretches the same. So a
text of one word a million times has one run and no scan that costs its square.

The documents of a batch are counted together; a long one is a batch of its own. All is map only.

Defined cases: a null text is an empty one, without words or runs; a null doc_id is spelled as an empty string; repeated
rows come back as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of

#: Least words of a run, and how often its period fits into it.
LEAST, REPEATS = 6, 4
#: Words whose lags are counted together.
TOGETHER = 1 << 17
#: A word is heavy if its pairs outnumber so many times size * log2(size) of its document's transform.
TRANSFORM = 0.15
#: Lags up to which the whole text is scanned at once.
SHORT = 16

Run = tuple[int, int, int]


def words_of(text: str) -> list[bytes]:
    """Words between the white space of ASCII, as UTF-8; bytes know no other."""
    return text.encode("utf-8", "surrogatepass").split()


def needed(lags: np.ndarray) -> np.ndarray:
    """Consecutive matches that a run of each lag has at least."""
    return np.maximum(LEAST - lags, (REPEATS - 1) * lags)


def lag_counts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of every lag from 0 to size // REPEATS of each document, in a row, and where those of each document start.

    ids are the words of the documents one after another.
    """
    most = sizes // REPEATS
    at = np.concatenate(([0], np.cumsum(most + 1)))
    counts = np.zeros(at[-1], np.int64)
    if not len(ids):
        return counts, at
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    key, place, doc = key[order], place[order], doc[order]
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    often = np.diff(np.append(edge, len(key)))
    width = 1 << np.ceil(np.log2(np.maximum(2, sizes + most + 1))).astype(np.int64)
    cost = TRANSFORM * width * np.log2(width)
    heavy = often * (often - 1.0) / 2 > cost[doc[edge]]
    # light words: each place against the next, the one after and so on, as long as word and reach allow
    i, k = np.flatnonzero(np.repeat(~heavy, often)), 1
    while len(i):
        i = i[i + k < len(key)]
        lag = place[i + k] - place[i]
        near = (key[i + k] == key[i]) & (lag <= most[doc[i]])
        i = i[near]
        np.add.at(counts, at[doc[i]] + lag[near], 1)
        k += 1
    spectra: dict[int, np.ndarray] = {}
    for start, n in zip(edge[heavy].tolist(), often[heavy].tolist(), strict=True):
        d = int(doc[start])
        there = np.zeros(width[d])
        there[place[start : start + n]] = 1
        power = np.abs(np.fft.rfft(there)) ** 2
        spectra[d] = spectra[d] + power if d in spectra else power
    for d, power in spectra.items():
        counts[at[d] : at[d + 1]] += np.rint(np.fft.irfft(power, width[d])[: most[d] + 1]).astype(np.int64)
    return counts, at


def stretches(match: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Starts and ends of the islands of matches of so many or more."""
    edge = np.flatnonzero(np.diff(match.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def same(w: np.ndarray, q: int, start: int, end: int) -> np.ndarray:
    """Which places from start to end match at lag q."""
    return w[start:end] == w[start + q : end + q]


def true_first(match: np.ndarray) -> int:
    """How many of the first are true."""
    return len(match) if match.all() else int(np.argmin(match))


def islands(w: np.ndarray, q: int, known: np.ndarray) -> list[tuple[int, int]]:
    """The islands of lag q that a run needs, but those inside runs (start, end, period) whose period divides q."""
    least, n = int(needed(np.array(q))), len(w) - q
    if q <= SHORT:
        return stretches(w[:n] == w[q:], least)
    first = np.arange(0, n - q + 1, q)
    for start, end, _ in known[(q % known[:, 2] == 0) & (known[:, 1] - known[:, 0] >= 2 * q)].tolist():
        first = first[(first < start) | (first + 2 * q > end)]
    step = 1
    while len(first) and step < q:
        spots = first[:, None] + np.arange(step) * q // step
        first = first[(w[spots] == w[spots + q]).all(axis=1)]
        step *= 4
    found, reached = [], -1
    for s in first.tolist():
        if s < reached or not same(w, q, s, s + q).all():
            continue
        left, right = s, s + q
        while left:
            k = true_first(same(w, q, left - min(q, left), left)[::-1])
            left -= k
            if k < q:
                break
        while right < n:
            k = true_first(same(w, q, right, min(n, right + q)))
            right += k
            if k < q:
                break
        reached = right
        if right - left >= least:
            found.append((left, right))
    return found


def runs_of(w: np.ndarray, lags: list[int]) -> list[Run]:
    """The runs (start, length, period) of a text, by start and period; lags are those with enough matches, in order."""
    known, seen = np.zeros((0, 3), np.int64), set()
    for q in lags:
        new = [(s, e + q, q) for s, e in islands(w, q, known) if (s, e + q) not in seen]
        seen.update((s, e) for s, e, _ in new)
        if new:
            known = np.concatenate((known, np.array(new, np.int64)))
    return sorted((s, e - s, q) for s, e, q in known.tolist())


def lags_of(ids: np.ndarray, sizes: np.ndarray) -> Iterator[list[int]]:
    """The lags of each document that have matches enough for a run."""
    counts, at = lag_counts(ids, sizes)
    lag = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    enough = np.flatnonzero((lag > 0) & (counts >= needed(lag)))
    cut = np.searchsorted(enough, at)
    for d in range(len(sizes)):
        yield lag[enough[cut[d] : cut[d + 1]]].tolist()


def read(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, list[Run]]]:
    """Word numbers and runs of each text, given as its words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    lags = lags_of(np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(x) for x in ids]))
    for own, found in zip(ids, lags, strict=True):
        yield own, runs_of(own, found) if found else []


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays: those after the first period of a run go."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run whose length is the largest multiple of its period; then the first, then that of the smallest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def grouped(rows: list[tuple[object, list[bytes]]]) -> Iterator[list[tuple[object, list[bytes]]]]:
    """rows in parts of up to TOGETHER words; a longer text is a part of its own."""
    part, held = [], 0
    for row in rows:
        if part and held + len(row[1]) > TOGETHER:
            yield part
            part, held = [], 0
        part.append(row)
        held += len(row[1])
    if part:
        yield part


def find(docs: DataFrame) -> DataFrame:
    """doc_id, starts, lengths and periods of the runs of each document, and its text without their repetitions, words joined by spaces."""

    def work(batches):
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), map(words_of, batch.column("text").to_pylist()), strict=True))
            for part in grouped(rows):
                out: dict[str, list] = {"doc_id": [], "starts": [], "lengths": [], "periods": [], "collapsed": []}
                for (doc_id, words), (_, runs) in zip(part, read([w for _, w in part]), strict=True):
                    out["doc_id"].append(doc_id)
                    for name, k in (("starts", 0), ("lengths", 1), ("periods", 2)):
                        out[name].append([r[k] for r in runs])
                    stay = kept(len(words), runs)
                    out["collapsed"].append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(stay).tolist()]).decode("utf-8", "surrogatepass"))
                yield out

    return map_batches(texts_of(docs), work, "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """words, in every tenth document with a tail that repeats some of its words; which follows from the checksum of its number."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // p))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """Runs of each document with its planted repetitions: their number, the strongest, and digests of all and of the text without them."""
    names = ("start", "length", "period")

    def work(batches):
        for batch in batches:
            rows = [(i, planted(i, words_of(t))) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            for part in grouped(rows):
                out: dict[str, list] = {c: [] for c in ("doc_id", "n_runs", *names, "exponent_milli", "runs_sha256", "collapsed_sha256")}
                for (doc_id, words), (_, runs) in zip(part, read([w for _, w in part]), strict=True):
                    best = strongest(runs)
                    stay = words if not runs else [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]
                    out["doc_id"].append(doc_id)
                    out["n_runs"].append(len(runs))
                    for k, name in enumerate(names):
                        out[name].append(None if best is None else best[k])
                    out["exponent_milli"].append(None if best is None else 1000 * best[1] // best[2])
                    out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                    out["collapsed_sha256"].append(hashlib.sha256(b" ".join(stay)).hexdigest())
                yield out

    return map_batches(texts_of(docs), work, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Every pair of equal words within reach, and islands by row numbers; checksums bit by bit.
SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295)) AS h FROM w),
g AS (SELECT doc_id, w, n, h, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM g),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i AS i FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
e AS (SELECT doc_id, q, i FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, q) >= greatest(6 - q, 3 * q)),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
f AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM k GROUP BY doc_id, q, island HAVING count(*) >= greatest(6 - q, 3 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM f GROUP BY doc_id, s, len),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs, arg_min({'start': s, 'length': len, 'period': q}, (-(len * 1000000000000 // q), s, q)) AS top FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
t AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL = {"op12_periodic_runs": SQL}
