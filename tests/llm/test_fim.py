"""Fill-in-the-middle against a plain version, on odd rows and by round trips."""

import hashlib
import random

import duckdb
import pytest

from tracewright.llm import fim

SCHEMA = "doc_id long, text string, form string, batch string, h long, n long"
LONG = "".join(chr(97 + i % 26) + "é🙂\n"[i % 4 : i % 4 + 1] for i in range(300_000))


def plain(doc_id, text, seed=1, markers=("<P>", "<S>", "<M>"), rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r, n = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)], len(text)
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    if not text or any(m in text for m in markers) or r[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, s, m = markers
    if r[3] % 100 < spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def given(spark, rows):
    return spark.createDataFrame([(i, t, "f", "b", 1, 2) for i, t in rows], SCHEMA)


def rows_of():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab <P>é🙂\n\x00") for _ in range(rng.choice((1, 2, 63, 64, 65, 127, 128, 129, 500))))) for i in range(400)]
    return rows + [(1000, None), (1001, ""), (None, "no number"), (None, None), (1002, LONG), (1002, LONG), (1003, "has <S> in it"), (1004, "<" * 200), (-7, "negative number"), (1005, "x<P")]


def test_all_forms_by_value(spark):
    rows = rows_of()
    out = fim.transform(given(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert [str(x) for x in got] == [str(x) for x in sorted((str(i), *plain(i, t)) for i, t in rows)]
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_round_trip_and_digests(spark):
    rows = rows_of()
    back = fim.restore(fim.transform(given(spark, rows), seed=3, fim=100, spm=50)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in fim.digests(given(spark, rows)).collect())
    assert got == sorted((str(i), sha(plain(i, t)[4]), sha(t or "")) for i, t in rows)


def test_other_markers_and_refused_ones(spark):
    rows, markers = [(i, f"text {i} of <P> and words") for i in range(50)], ("«pre»", "«suf»", "«mid»")
    got = sorted((r["doc_id"], r["output"]) for r in fim.transform(given(spark, rows), 2, markers, 100, 30).collect())
    assert got == [(i, plain(i, t, 2, markers, 100, 30)[4]) for i, t in rows]
    for bad in (("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("xay", "a", "z"), ("m", "m", "k")):
        with pytest.raises(ValueError):
            fim.checked(bad)


def test_empty_table_and_sql(spark):
    assert fim.digests(given(spark, [])).count() == fim.transform(given(spark, [])).count() == 0
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(fim.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = fim.op11_fill_in_middle(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[list(want.columns)].astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()
