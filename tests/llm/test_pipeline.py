"""Stages of the corpus pipeline on the smallest driver tables and on odd rows."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm.personal_data import redact
from tickloom.llm.simhash import fingerprint

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


def test_stages_keep_the_columns_and_act(spark, tmp_path):
    docs, sizes = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, docs, SF_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if n == 1:  # no two that stay are near-duplicates
            prints = [fingerprint(r.text) for r in docs.collect()]
            assert all(bin((a ^ b) & (1 << 64) - 1).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
        if n == 2:
            assert docs.filter("text like '%[PHONE]%'").count() > 0 and sizes[2] == sizes[1]
        if n == 3:
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert docs.select("length").groupBy().sum().first()[0] > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


LONG = " ".join(f"w{i % 977}x" for i in range(20_000))
ODD = [(1, "alpha beta gamma delta one", "en", "a"), (1, "alpha beta gamma delta one", "en", "a"), (None, "alpha beta gamma delta one", None, None), (2, None, "de", "b"),
       (3, "", None, "b"), (4, " \n\t", "fr", None), (5, LONG, "en", "a"), (6, LONG, "en", "c"), (7, "call +1 202 555 0143 or a@b.co now", "en", "c"),
       (8, "quite another text with words of its own", "en", "d"), (9, "the last of these few small texts", None, "d")]


@pytest.fixture(params=["file", "rows"])
def odd(request, spark, tmp_path):
    """Nulls, repeats, ties, a long text and a further column called like an inner one."""
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 5, "x") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, _row int, kept string").repartition(3)
    if request.param == "rows":
        return docs
    docs.write.parquet(str(tmp_path / "odd"))
    return spark.read.parquet(str(tmp_path / "odd"))


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_dedup_keeps_one_row_of_each_class(spark, odd):
    out = rows(corpus_pipeline.simhash_dedup(spark, odd, SF_DIR))
    prints = [fingerprint(t) for _, t, _, _ in ODD]
    close = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    want = Counter()
    for n, r in enumerate(ODD):  # links are classes here: no chains
        same = [ODD[m] for m in range(len(ODD)) if close(prints[n], prints[m])]
        first = min(same, key=lambda s: (s[0] is None, s[0] or 0))
        want[first] = 1
    assert out == want and out[ODD[0]] == 1 and (6, LONG, "en", "c") not in out


def test_personal_data_and_classifier_on_odd_rows(spark, odd):
    out = corpus_pipeline.personal_data(spark, odd, SF_DIR)
    assert rows(out) == rows(redact(odd.select(*corpus_pipeline.COLUMNS), text="text")) and out.count() == len(ODD)
    assert all(r.n_chars == len(r.text or "") for r in out.collect()) and out.filter("text like '%[EMAIL]%'").count() == 1
    kept = rows(corpus_pipeline.quality_classifier(spark, odd, SF_DIR))
    assert not kept - Counter(ODD)
    assert all(n == Counter(ODD)[r] for r, n in kept.items())  # repeated rows stay or go together


def test_mix_copies_rows_near_the_targets(spark, odd):
    out = corpus_pipeline.mix_sources(spark, odd, SF_DIR)
    assert out.columns == corpus_pipeline.COLUMNS
    got = rows(out)
    assert set(got) <= set(ODD) and all(len((r[1] or "").split()) > 0 for r in got)
    assert all(n <= 3 * Counter(ODD)[r] for r, n in got.items())


def test_packing_takes_odd_rows(spark, odd):
    out = corpus_pipeline.best_fit_packing(spark, odd, SF_DIR)
    whole = out.groupBy("doc_id", "piece").count().filter("piece = 0").agg(F.sum("count")).first()[0]
    assert whole == len(ODD)


def test_a_stage_leaves_other_queries_tables(spark, odd):
    from tickloom.llm.common import store
    other = store(spark.range(5).toDF("n"), "other")
    corpus_pipeline.simhash_dedup(spark, odd, SF_DIR).count()
    corpus_pipeline.personal_data(spark, odd, SF_DIR).count()
    assert other.count() == 5
