"""The stages of the pipeline by value, and together."""

import json

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from tracewright.llm import packing, pii, quality, toxicity  # noqa: E402

A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
NEAR = A.replace("a59", "changed")


def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key.x` string, _set string, m map<string,int>"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", "x", {"a": 1}) for i, t in rows], schema)


def ids(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_document_of_each_group(spark):
    rows = [(7, A), (7, B), (8, A), (9, NEAR), (9, NEAR), (None, B), (None, "only this one has no number"), (1, None), (2, ""), (2, " \t"), (3, "short one"), (3, "short one"), (4, "SHORT one")]
    out = corpus_pipeline.one_of_each(spark, docs(spark, rows), "")
    # two texts of doc_id 7 are two documents; of near copies the one with the smallest doc_id stays
    assert ids(out) == sorted([(7, A), (7, B), (None, "only this one has no number"), (1, None), (2, ""), (2, " \t"), (3, "short one")], key=str)
    assert out.columns == docs(spark, []).columns and out.where("m['a'] = 1 AND `key.x` = 'k' AND _set = 'x'").count() == 7
    assert corpus_pipeline.one_of_each(spark, docs(spark, []), "").count() == 0


def test_kept_rows_are_those_that_the_scores_say(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(given, labels)
    want = ids(given.join(quality.score(given, model).where("predicted = 1").select("doc_id"), "doc_id", "left_semi"))
    assert ids(corpus_pipeline.good_quality(spark, given, "/root/testdata/sf0.001")) == want and 0 < len(want) < given.count()
    severity = toxicity.fit(given, labels)
    want = ids(given.join(toxicity.score(given, severity).where("toxic = 0").select("doc_id"), "doc_id", "left_semi"))
    assert ids(corpus_pipeline.not_toxic(spark, given, "/root/testdata/sf0.001")) == want


def test_odd_rows_are_kept_by_the_filters(spark):
    rows = [(1, None), (None, None), (2, ""), (3, "Some words."), (3, "Some words."), (4, "word " * 50_000)]
    given, none = docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    # without labels nothing is rejected
    for kept in (quality.keep(given, quality.fit(given, none)), toxicity.keep(given, toxicity.fit(given, none))):
        assert ids(kept) == sorted(rows, key=str) and kept.columns == given.columns


def test_masked_texts(spark):
    rows = [(1, None), (2, ""), (None, "mail x@y.org now"), (3, "mail x@y.org now"), (3, "mail x@y.org now"), (4, "clean")]
    out = pii.mask(docs(spark, rows))
    assert ids(out) == sorted([(1, None), (2, ""), (None, "mail <EMAIL> now"), (3, "mail <EMAIL> now"), (3, "mail <EMAIL> now"), (4, "clean")], key=str)
    assert out.where("n_chars <> length(text)").count() == 0 and out.where("n_chars IS NULL").count() == 1


def test_all_stages_together(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs_ = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs_ = docs_, stage(spark, docs_, "/root/testdata/sf0.001")
        assert docs_.columns == given.columns, name
        docs_.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        assert docs_.count() <= before.count()
    packed = packing.pack_documents(docs_)
    got, want = corpus_pipeline.run(spark, "/root/testdata/sf0.001"), packed
    digest = lambda df: sorted(json.dumps([r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]]) for r in df.collect())
    assert digest(got) == digest(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
