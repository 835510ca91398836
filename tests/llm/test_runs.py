"""Runs against a plain version that tries every lag, on odd rows, and in time."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np

from tracewright.llm import runs

SCHEMA = "doc_id long, text string, starts string, period string, g long"


def plain(words):
    """All runs (start, length, period): every lag, every island, the smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def texts():
    rng = random.Random(11)
    for size in (0, 1, 5, 6, 7, 30, 90, 250):
        for letters in ("a", "ab", "abc", "abcdefghij"):
            for _ in range(6):
                yield [rng.choice(letters) for _ in range(size)]
    for _ in range(150):
        words = []
        while len(words) < rng.choice((40, 120, 400)):
            unit = [rng.choice("abcd") for _ in range(rng.choice((1, 2, 3, 6, 12, 17, 20, 34, 51)))]
            words += (unit * rng.choice((1, 1, 3, 4, 5, 9)))[: rng.randint(1, 300)]
            words += [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]
        yield words
    # a run of runs: a period that itself holds runs of a shorter one
    yield (["a"] * 20 + ["b"] + ["c", "d"] * 10) * 5
    yield ["a"] * 100 + ["b"] + (["a"] * 40 + ["b"]) * 4 + ["a"] * 100


def test_runs_equal_those_of_every_lag(monkeypatch):
    given = list(texts())
    raw = [[x.encode() for x in t] for t in given]
    want = [plain(t) for t in given]
    assert sum(map(len, want)) > 250
    for cost in (0.0, 0.15, 1e9):
        # all words heavy, some, and none
        monkeypatch.setattr(runs, "TRANSFORM", cost)
        assert [found for _, found in runs.read(raw)] == want


def test_counts_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 3, 4, 50, 700, 5])
    ids = rng.integers(0, 6, sizes.sum())
    want = []
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        want += [0, *(int((own[:-q] == own[q:]).sum()) for q in range(1, len(own) // 4 + 1))]
    for cost in (0.0, 0.15, 1e9):
        monkeypatch.setattr(runs, "TRANSFORM", cost)
        counts, at = runs.lag_counts(ids, sizes)
        counts[at[:-1]] = 0
        assert counts.tolist() == want


def test_odd_rows(spark):
    rows = [(i, " ".join(t)) for i, t in enumerate(list(texts())[::7])]
    rows += [(900, None), (901, ""), (None, "a b " * 5), (None, None), (902, "é  é\té\né é é"), (902, "é  é\té\né é é"), (903, "a a a a " * 9), (904, "\x1c \x1c " * 9)]
    rows += [(i, " ".join(f"w{(i * k) % 41}" for k in range(60))) for i in range(1000, 1200)]
    docs = spark.createDataFrame([(i, t, "s", "p", 1) for i, t in rows], SCHEMA)
    out = runs.digests(docs)
    names = [c for c in out.columns if c != "doc_id"]
    assert sorted((str(r["doc_id"]), *map(str, (r[c] for c in names))) for r in out.collect()) == sorted((str(i), *map(str, plain_row(i, t))) for i, t in rows)
    assert runs.digests(spark.createDataFrame([], SCHEMA)).count() == runs.find(spark.createDataFrame([], SCHEMA)).count() == 0
    found = {r["doc_id"]: r for r in runs.find(docs.where("doc_id IS NOT NULL")).collect()}
    assert found[902]["collapsed"] == "é" and (found[902]["starts"], found[902]["lengths"], found[902]["periods"]) == ([0], [6], [1])


def test_table_equals_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r["text"] or "") < 8000]
    out = runs.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    names = [c for c in out.columns if c != "doc_id"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in out.collect()}
    assert got == {i: plain_row(i, t) for i, t in rows} and len(got) > 100


def test_long_texts_take_no_square():
    rng = random.Random(2)
    for words in ([b"a"] * 400_000, [b"a", b"b", b"c"] * 120_000, [rng.choice((b"a", b"b")) for _ in range(200_000)], [rng.choice((b"a", b"b", b"c")) for _ in range(60_000)] * 4):
        began = time.time()
        ((_, found),) = runs.read([words])
        assert time.time() - began < 60
        if len(words) in (400_000, 360_000):
            assert found == [(0, len(words), 1 if len(words) == 400_000 else 3)]
        if len(words) == 240_000:
            assert (0, 240_000, 60_000) in found


def test_sql_equals_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    out = runs.op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.sql(runs.SQL).select(", ".join(out.columns)).fetchall()))
