"""What the physical plans may and may not contain, and the driver contract."""

from __future__ import annotations

import pytest
from helpers import articles, as_of
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from checks import adapters, catalog
from newsmood.operators import articles as R
from newsmood.operators import stats
from newsmood.operators import store as U
from newsmood.operators.articles import to_stored
from newsmood.plans import jobs
from newsmood.session import work_path
from newsmood.sources import files

PYTHON = {"model_sentiment", "model_batches"}
WRITES = {"article_by_url", "full_pipeline", "run_dump", "report_tables", "migrate_counts", "migrated_store", "keyword_semi_join", "keyword_semi_join_items", "json_envelope_import", "import_quarantine", "json_roundtrip", "csv_roundtrip", "stream_ingest", "stream_dedup", "stream_upsert", "stream_sentiment_counts"}
PLANNED = sorted(set(catalog.QUERIES) - PYTHON - WRITES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_native_and_no_pairing(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    for node in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


NARROW = ["lexicon_sentiment", "polarity_sentiment", "ensemble_vote", "summarize", "keywords_tfidf", "keywords_frequency",
          "extract_entities", "readability", "extract_articles_html", "extract_links", "chunk_combine", "stored_rows",
          "report_projection", "keyword_filter_ci"]


@pytest.mark.parametrize("name", NARROW)
def test_row_work_does_not_shuffle(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    # The only exchange is the one that deals a one-file test table out to the cores.
    assert text.count("Exchange") <= text.count("RoundRobinPartitioning")


def test_dedup_keeps_one_row_per_task_and_url(spark, sf_dir):
    text = plan(catalog.QUERIES["clean_articles"](spark, sf_dir))
    below = text[text.index("hashpartitioning(url"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_cap_is_limited_before_and_after_the_salt(spark, sf_dir):
    text = plan(R.cap_per_source(adapters.articles(spark, sf_dir), 20))
    assert text.count("WindowGroupLimit") >= 3 and "_salt" in text


def test_flagship_shuffles_no_text(spark, sf_dir):
    text = plan(spark_entry.queries()["sentiment_by_source"](spark, sf_dir))
    for line in text.splitlines():
        if "hashpartitioning" in line:
            assert "content" not in line
    dedup = text[: text.index("hashpartitioning(url")]
    assert "content" not in dedup.split("Project")[0]


def test_stats_scan_once(spark):
    path = work_path(spark, "store")
    to_stored(articles(spark, [{}, {"url": "b"}]), as_of()).write.parquet(path)
    df = spark.read.parquet(path)
    for frame in (stats.sentiment_stats(df), stats.report_summary(df), stats.sentiment_by_source(df)):
        text = plan(frame)
        assert text.count("FileScan") == 1 and "content" not in text[text.index("ReadSchema"):]


def test_filters_reach_the_scan(spark):
    path = work_path(spark, "store")
    U.save_partitioned(to_stored(articles(spark, [{}, {"url": "b", "source_type": "rss"}]), as_of()), path)
    df = spark.read.parquet(path)
    text = plan(R.query_articles(df, source="Test Source", start="2024-01-01 00:00:00", limit=5))
    assert "EqualTo(source,Test Source)" in text and "TakeOrderedAndProject" in text
    assert "EqualTo(url,b)" in plan(R.article_by_url(df, "b"))
    pruned = plan(df.where("source_type = 'rss'"))
    assert "PartitionFilters: [isnotnull(source_type" in pruned
    assert df.count() == 2


def test_bucketed_store_is_not_shuffled_by_an_upsert(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = to_stored(articles(spark, [{"url": f"u{i}"} for i in range(20)]), as_of()).drop("seq")
        U.save_bucketed(rows, "store_by_url", work_path(spark, "bucketed"), 4)
        store = spark.table("store_by_url")
        fresh = to_stored(articles(spark, [{"url": "u3"}, {"url": "new"}]), as_of())
        merged = U.upsert(store, fresh)
        text = plan(merged)
        assert "Bucketed: true" in text
        # One exchange in the incoming branch (its dedup by URL), none on the store.
        assert text.count("Exchange hashpartitioning") <= 2
        scan = text[: text.index("Bucketed: true")]
        assert "Exchange hashpartitioning" not in scan[scan.rindex("FileScan") - 400 : ]
        assert merged.count() == 21
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS store_by_url")


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns[:2] == ["source", "total"] and df.count() > 0


def test_every_oracle_has_a_query():
    queries, oracle = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(catalog.QUERIES) <= set(oracle)


def test_composed_jobs(spark, sf_dir):
    df = adapters.articles(spark, sf_dir)
    payloads = {"rss": adapters.rss_payloads(df), "gnews": adapters.feed_item_payloads(df).drop("source")}
    found = jobs.ingest(payloads, as_of(), keywords=["the", "la"], max_per_source=3)
    per_source = {(r.source_type, r.source): r["count"] for r in found.groupBy("source_type", "source").count().collect()}
    assert per_source and max(per_source.values()) <= 3
    result = jobs.ingest_to_summary(found, as_of(), ["lexicon", "polarity"], order=("source_type", "published_date", "url"))
    store, export = work_path(spark, "run-store"), work_path(spark, "run-export")
    n = jobs.save_run(result, store, export, "json")
    assert n == result.articles.count() == spark.read.parquet(store).count()
    assert files.read_articles(spark, f"{export}/articles", as_of(), "json").count() == n
    assert sum(r.n for r in result.summary.collect()) == n
    counts, sources = jobs.system_stats(spark.read.parquet(store), adapters.source_registry(df))
    assert counts.first().total_articles == n and sources.count() == 4


def test_hot_source_and_url(spark):
    """A third of the rows share one source and URL; results stay whole."""
    n = 3000
    df = spark.range(n).select(
        F.lit("Good title").alias("title"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("content"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"),
        F.col("id").alias("seq"),
    )
    df = df.repartition(16)
    first = R.clean_articles(df)
    assert first.count() == n - n // 3 + 1 and first.where("url = 'hot'").first().seq == 0
    capped = R.cap_per_source(df, 100).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("m"))
    hot = capped.where("source = 'hot'").first()
    assert (hot.n, hot.m) == (100, 297)
    wide = R.cap_per_source(df, 1500).groupBy("source").count()  # beyond the limit Spark pushes down
    assert wide.where("source = 'hot'").first()["count"] == n // 3 and wide.count() == 51
    few = R.top_n_per_group(df, ["source"], [F.col("seq")], 1200, salts=2).where("source = 'hot'")
    assert few.count() == n // 3
    assert stats.articles_by_source(df).where("source = 'hot'").first().n_articles == n // 3


def test_texts_are_split_twice_for_any_number_of_term_lists(spark, sf_dir):
    df = catalog.QUERIES["lexicon_table"](spark, sf_dir)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # Once for each of the two methods, as one exchange; no condition of the lists on every word.
    assert text.count("Generate posexplode") == 2 and text.count("Generate explode") == 0 and "md5" not in text


def test_import_scans_the_lines_once_after_the_state_pass(spark, tmp_path):
    (tmp_path / "a.json").write_text('[ {"title": "x"},\n {"title": "y"} ]')
    df = files.import_records(spark, str(tmp_path), F.lit("2024-01-01").cast("timestamp"), "json")
    assert "MapInArrow" not in plan(df) and df.count() == 2
