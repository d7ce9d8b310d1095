from __future__ import annotations

import datetime as dt

import pytest
from helpers import WHEN, articles
from pyspark.sql import functions as F

from newsmood.plans import runs
from newsmood.session import work_path
from newsmood.sources import registry

GOOD, BAD = "a wonderful and great success", "a terrible and awful crisis"


def day(n):
    return F.lit(f"2024-03-0{n} 00:00:00").cast("timestamp")


def found(spark, *rows):
    return articles(spark, [{"url": u, "source": s, "content": t} for u, s, t in rows])


def log_of(df):
    one = df.select("source", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_message"))
    return registry.ingest_log(one, F.lit(WHEN), articles=F.lit(1))


def save(spark, root, run_id, n, *rows):
    df = found(spark, *rows)
    return runs.run(df, log_of(df), root, run_id, day(n))


def store(spark, root):
    return {r.url: (r.sentiment_label, r.created_at.day, r.updated_at.day) for r in runs.current_store(spark, root).collect()}


def logged(spark, root):
    return sorted((r.run_id, r.source, r.article_count) for r in runs.run_log(spark, root).collect())


def test_runs_build_on_each_other_and_replace_themselves(spark):
    root = work_path(spark, "runs")
    assert runs.history(spark, root) == []
    with pytest.raises(ValueError):
        runs.current_store(spark, root)
    one = save(spark, root, "one", 1, ("a", "s", GOOD), ("b", "s", BAD), ("b", "s", GOOD))
    assert (one.saved, one.urls, one.inserted, one.updated, one.total, one.exported, one.base) == (2, 2, 2, 0, 2, 2, None)
    two = save(spark, root, "two", 2, ("b", "t", GOOD), ("c", "t", BAD))
    assert (two.saved, two.inserted, two.updated, two.total, two.exported) == (2, 1, 1, 3, 3)
    assert store(spark, root) == {"a": ("positive", 1, 1), "b": ("positive", 1, 2), "c": ("negative", 2, 2)}
    again = save(spark, root, "two", 3, ("c", "u", GOOD))
    assert again.base == two.base and [r.run_id for r in runs.history(spark, root)] == ["one", "two"]
    assert store(spark, root) == {"a": ("positive", 1, 1), "b": ("negative", 1, 1), "c": ("positive", 3, 3)}
    assert logged(spark, root) == [("one", "s", 3), ("two", "u", 1)]
    with pytest.raises(ValueError):
        save(spark, root, "one", 4, ("a", "s", GOOD))
    three = save(spark, root, "three", 4)
    assert (three.saved, three.total) == (0, 3) and store(spark, root)["c"] == ("positive", 3, 3)


def test_an_attempt_that_dies_is_not_read(spark, monkeypatch):
    root = work_path(spark, "runs")
    save(spark, root, "one", 1, ("a", "s", GOOD))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "dump", dies)  # the last step before the record
        with pytest.raises(RuntimeError):
            save(spark, root, "two", 2, ("b", "s", BAD))
    assert set(store(spark, root)) == {"a"} and logged(spark, root) == [("one", "s", 1)]
    save(spark, root, "two", 2, ("b", "s", BAD))
    assert set(store(spark, root)) == {"a", "b"} and logged(spark, root) == [("one", "s", 1), ("two", "s", 1)]


def test_dump_has_sources_and_their_articles(spark):
    root = work_path(spark, "runs")
    run = save(spark, root, "one", 1, ("a", "s", GOOD), ("b", "t", BAD), ("c", "t", "plain"))
    log, lines = runs.read_dump(spark, run.path("dump"))
    assert sorted((r.source, r.success, r.article_count) for r in log.collect()) == [("s", True, 1), ("t", True, 2)]
    assert log.first().timestamp == WHEN and isinstance(WHEN, dt.datetime)
    assert sorted((r.source, '"url":"b"' in r.json) for r in lines.collect()) == [("s", False), ("t", False), ("t", True)]


def test_pages_without_an_article_are_logged_as_failed(spark):
    html = f"<h1>A headline that is long</h1><article>{'words ' * 40}</article>"
    df = spark.createDataFrame([("s", html), ("s", None), ("t", html)], "source string, html string")
    responses = registry.page_responses(df)
    log = registry.ingest_log(responses, F.lit(WHEN), source_type=F.lit("website"), articles=F.col("n_articles"))
    assert sorted((r.source, r.success, r.error_message, r.article_count) for r in log.collect()) == [("s", False, "Page error: no article", 1), ("t", True, None, 1)]


def test_what_every_attempt_writes_is_packed(spark, tmp_path):
    rows = [(f"u{i}", "a", f"{GOOD} {i} " * 40) for i in range(3)]
    first = save(spark, f"{tmp_path}/runs", "one", 1, *rows)
    names = lambda part, end: [f.name for f in (tmp_path / first.path(part).split(str(tmp_path))[1].lstrip("/")).glob(f"part-*{end}")]
    assert names("articles", ".zstd.parquet") and names("store", ".zstd.parquet") and names("dump/articles", ".gz")
    log, lines = runs.read_dump(spark, first.path("dump"))
    assert log.count() == 1 and lines.count() == 3
