"""The chosen-path join against all pairs, on odd rows, and its parts against plain versions."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import chosen_path

SCHEMA = "doc_id long, text string, node long, id string, key string, r int"


def plain(rows, k=2, num=80, den=100):
    """doc_id, size and component by all pairs."""
    white = " \t\n\r\x0b\x0c"
    sets = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in white:
            lower = lower.replace(c, " ")
        words = [w for w in lower.split(" ") if w]
        sets.append({tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, **small):
    docs = spark.createDataFrame([(i, t, 1, "i", "k", 2) for i, t in rows], SCHEMA)
    out = chosen_path.kept_or_not(chosen_path.PathJoin(docs, 2, 80, 100, **small).run())
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=str)


def rows_of():
    rng = random.Random(8)
    rows, number = [], 0
    for group in range(14):
        base = [rng.choice(("the", "of", "and", "a")) if rng.random() < 0.2 else f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((3, 12, 40, 120)))]
        for _ in range(rng.choice((1, 2, 5, 25, 60))):
            own = list(base)
            # around the threshold: each changed word costs two shingles
            for at in rng.sample(range(len(own)), rng.choice((0, 0, len(own) // 40, len(own) // 20, len(own) // 12, len(own) // 8))):
                own[at] = f"v{group}x{rng.randint(0, 10**6)}"
            rows.append(((number := number + 1), " ".join(own)))
    # one text in many documents, and sets that share much without a link
    rows += [(500 + i, "the same text in all of these documents, word by word") for i in range(30)]
    common = [f"c{i}" for i in range(60)]
    rows += [(600 + i, " ".join(common[:45] + [f"own{i}x{j}" for j in range(15)])) for i in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [{}, {"leaf": 3, "node": 8}, {"leaf": 2, "node": 5, "weight": 300}])
def test_join_equals_all_pairs(spark, small):
    rows = rows_of()
    assert found(spark, rows, **small) == plain(rows)


def test_join_on_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, None), (4, "One"), (5, "one"), (6, "one two"), (6, "one two"), (None, "one  TWO"), (None, "unnumbered text here"), (7, long), (8, long + " more"), (9, "é é 🙂"), (9, "other text of nine")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_branching_keeps_together_what_is_alike():
    rng = np.random.default_rng(4)
    noise = lambda rows: rng.integers(0, 256, (rows, chosen_path.COORDINATES), dtype=np.uint8)
    base = noise(300)
    # each row has a partner that differs in a fifth of the tokens or so; a hundred rows are alike in nine tenths
    other = np.where(rng.random(base.shape) < 0.2, noise(300), base)
    crowd = np.where(rng.random((100, base.shape[1])) < 0.1, noise(100), base[0])
    tokens = np.concatenate((base, other, crowd))
    n = len(tokens)
    part = pa.table({"cell": [0] * n, "key": [i.to_bytes(16) for i in range(n)], "tokens": [x.tobytes() for x in tokens], "n": [100] * n, "r": list(range(n))})
    own = chosen_path.Read(part, 80, 100)
    whole = chosen_path.Labels(own.given)
    for tree in range(8):
        chosen_path.descend(np.full(n, tree, np.int64), own, whole, 10)
    every = chosen_path.Labels(own.given)
    chosen_path.compared(own.cell, np.arange(n), own, every)
    assert (whole.of == every.of).mean() > 0.99 and len(set(every.of.tolist())) < 320
    # rows that hang together from the start give no edge by that alone
    own.given = every.of
    assert chosen_path.stars(own, chosen_path.Labels(own.given)) == {"a": [], "b": []}
    for bad in ((60, 100), (101, 100)):
        with pytest.raises(ValueError):
            chosen_path.least_alike(*bad)


def test_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    a, b = np.sort(x[:1800]), np.sort(x[200:])
    agree = (chosen_path.minwise([a]) == chosen_path.minwise([b])).mean()
    assert abs(agree - 0.8) < 0.12
    together = chosen_path.minwise([a, b, a[:1]])
    assert (together[0] == chosen_path.minwise([a])[0]).all() and (together[2] == a[0] * chosen_path.ODD).all()


def test_sql_equals_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    out = chosen_path.op13_chosen_path(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.sql(chosen_path.SQL).select(", ".join(out.columns)).fetchall()))
