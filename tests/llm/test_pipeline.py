"""Each stage of the pipeline on what the one before left, against brute force."""

import re

import pytest
from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked
from test_mixing import sized, waterfill, words
from test_pii import brute as personal

import corpus_pipeline
from newsmood.llm import quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """Nulls in every column, empty and repeated rows, equal ids, and columns that clash, all the way."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    good = [r for r in real.collect()][:12]
    rows_ = [tuple(r) for r in good] + [tuple(good[0]), tuple(good[0]), (good[1][0], "another text of the same id " * 5, *good[1][2:])]
    rows_ += [(None, "a text without an id, " * 6, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, None, None), (900_003, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows_, real.schema).withColumns({"_nth": F.lit(1), "_pii_id": F.lit("x"), "mix_shard": F.lit("old"), "n_words": F.lit(0)})
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("odd") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_odd_rows_go_through(spark, sf_dir, odd):
    assert all(s.columns == odd[0].columns for s in odd[:-1]) and set(odd[-1].columns) == set(odd[0].columns)
    for before, after in zip(odd, odd[1:], strict=False):
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    joined = odd[2].collect()
    assert len({(r.doc_id, r.text) for r in joined}) == len(joined)  # of repeated rows one
    assert {r["_nth"] for r in odd[-1].collect()} <= {1} and {r["_pii_id"] for r in odd[-1].collect()} <= {"x"}
    assert not [r for r in odd[-1].collect() if not words(r.text)]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [] and set(docs.columns) <= set(out.columns)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "mix_shard"]


def test_quality(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.classify(stages[0], labels).collect() if r.predicted}
    assert set(rows(stages[1])) == good


def test_one_of_each_group(stages):
    from fractions import Fraction

    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {str(i) for i in rows(stages[2])} == {c for _, _, c in linked(docs, 5, Fraction(4, 5))}


def test_benchmark(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    for i, r in before.items():
        n, hit, _ = contaminated(r.text, items, 10)
        if not hit:
            assert after[i].text == r.text
        elif len(hit) == n:
            assert i not in after
        else:
            assert not contaminated(after[i].text, items, 10)[1] and after[i].n_chars == len(after[i].text)


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in before.items():
        if personal(r.text):
            assert not personal(after[i].text) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i].text)
        else:
            assert after[i].text == r.text


def test_mix(stages):
    docs = [(r.doc_id, r.text, r.source) for r in stages[4].collect()]
    target, drawn = waterfill(sized(docs)), dict.fromkeys({s for *_, s in docs}, 0)
    for r in stages[5].collect():
        drawn[r.source] += len(words(r.text))
    assert all(abs(drawn[s] - target[s]) <= 1 for s in target)
