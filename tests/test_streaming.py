from __future__ import annotations

import datetime as dt

import pytest
from helpers import WHEN, articles, as_of
from pyspark.sql import functions as F

from checks import adapters
from newsmood.operators.articles import to_stored
from newsmood.operators.store import upsert
from newsmood.session import work_path
from newsmood.sources.registry import parse
from newsmood.streaming import jobs, segments


def land(df, path, mode="append"):
    df.coalesce(1).write.mode(mode).parquet(path)


def test_ingest_continues_from_its_checkpoint(spark, sf_dir):
    payloads = adapters.rss_payloads(adapters.articles(spark, sf_dir))
    first, rest = payloads.where("source < 'src15'"), payloads.where("source >= 'src15'")
    path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))

    def poll():
        found = jobs.ingest(jobs.read_landed(spark, path, payloads.schema), "rss", as_of())
        jobs.run(jobs.append(found, out, mark))

    land(first, path)
    poll()
    n = spark.read.parquet(out).count()
    poll()
    assert spark.read.parquet(out).count() == n > 0
    land(rest, path)
    poll()
    batch = parse("rss", payloads, as_of())
    key = lambda df: sorted((r.url, r.title, r.source) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch)


def test_dedup_over_batches(spark):
    path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
    rows = [{"url": f"u{i % 4}", "scraped_date": WHEN + dt.timedelta(hours=i)} for i in range(12)]
    df = articles(spark, rows).select("url", "scraped_date")
    for part in range(3):
        land(df.where((F.hour("scraped_date") / 4).cast("int") == part), path)
    seen = jobs.dedup(jobs.read_landed(spark, path, df.schema, files_per_batch=1), "30 days")
    jobs.run(jobs.append(seen.select("url"), out, mark))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u0", "u1", "u2", "u3"]


def test_dedup_state_is_bounded_by_the_delay(spark):
    path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
    rows = [{"url": f"u{i}", "scraped_date": WHEN + dt.timedelta(days=i)} for i in range(40)]
    df = articles(spark, rows).select("url", "scraped_date")
    held = []
    for part in range(4):
        land(df.where(F.dayofyear("scraped_date") / 10.01 >= part).where(F.dayofyear("scraped_date") / 10.01 < part + 1), path)
        query = jobs.append(jobs.dedup(jobs.read_landed(spark, path, df.schema), "3 days"), out, mark)
        jobs.run(query)
        held.append(max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"][-1:]))
    assert spark.read.parquet(out).count() == 40 and max(held) < 20


def arrivals(spark, n=60, parts=4):
    """Repeats near and far, late rows, copies within a batch."""
    rows = []
    for i in range(n):
        part = i * parts // n
        day = (i * 37) % 300 if i % 5 else 0  # in no order of time
        rows.append({"url": f"u{(i * i) % 23}", "title": f"t{i}", "scraped_date": WHEN + dt.timedelta(days=day), "category": str(part)})
    return articles(spark, rows)


def test_unique_batches_equal_batch_dedup(spark):
    df = arrivals(spark).select("url", "title", "scraped_date", "category", "seq")
    for buckets in (1, 64):
        path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
        for part in range(4):
            land(df.where(F.col("category") == str(part)), path)
            jobs.run(jobs.unique_batches(jobs.read_landed(spark, path, df.schema), out, mark, ("seq",), buckets))
        got = sorted((r.url, r.seq) for r in jobs.unique_rows(spark, out).collect())
        first = {}
        for r in df.orderBy("seq").collect():
            first.setdefault(r.url, r.seq)
        assert got == sorted(first.items())
        filters = spark.read.parquet(f"{out}/filters").where("batch_id = 3").collect()
        assert 0 < len(filters) <= buckets and {len(r.bits) for r in filters} == {jobs.BLOOM_BITS // 8}


def test_filter_knows_what_it_holds(spark):
    urls = spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), (F.col("id") % 2 == 0).alias("held"))
    bloom = jobs._bloom_of(urls.where("held"), 4).withColumnRenamed("bucket", "b")
    tested = urls.withColumn("b", jobs._bloom_bucket(4)).join(bloom, "b").withColumn("may", jobs._may_hold(F.col("bits")))
    n = {(r.held, r.may): r["count"] for r in tested.groupBy("held", "may").count().collect()}
    assert n.get((True, False), 0) == 0 and n.get((False, True), 0) < 150


def state(df):
    return {r.url: (r.title, r.created_at, r.updated_at, r.seq) for r in df.collect()}


def test_upsert_log_equals_batch_upsert(spark):
    path, log, mark = (work_path(spark, n) for n in ("in", "log", "mark"))
    batches = []
    for part in range(5):
        when = F.lit(f"2024-01-0{part + 1} 00:00:00").cast("timestamp")
        batches.append(to_stored(arrivals(spark, parts=5).where(F.col("category") == str(part)), when))
    want, read = batches[0].where("false"), []
    for part, df in enumerate(batches):
        land(df, path)
        jobs.run(jobs.log_batches(jobs.read_landed(spark, path, df.schema), log, mark, compact_every=2, buckets=4))
        want = upsert(want, df)
        current = jobs.current_articles(spark, log)
        assert state(current) == state(want), part
        read.append(segments.manifest(spark, log).upto)
    assert read == [-1, 1, 1, 3, 3]
    # Reading costs the store, unshuffled, and the one segment behind it.
    assert segments.open_segments(spark, log, 3).select("batch_id").distinct().count() == 1
    text = current._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in text and "Bucketed: true" in text
    segments.drop_merged(spark, log)
    assert state(jobs.current_articles(spark, log)) == state(want)
    # A session that does not know the store's table enters it again.
    store = segments.manifest(spark, log).store
    spark.sql(f"DROP TABLE {jobs._table_of(store)}")
    assert state(jobs.current_articles(spark, log)) == state(want)
    jobs.compact_log(spark, log, 3)
    assert state(jobs.current_articles(spark, log)) == state(want) and segments.manifest(spark, log).upto == 4
    assert jobs.compact_log(spark, log, 3) == segments.manifest(spark, log)  # nothing to merge


def test_a_merge_that_dies_changes_nothing(spark):
    log = work_path(spark, "log")
    rows = to_stored(arrivals(spark), as_of())
    segments.put(rows, log, 0)

    def dies(df, path):
        df.limit(1).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        segments.compact(spark, log, jobs._upserted, jobs._bucketed, dies)
    assert segments.manifest(spark, log) == segments.Manifest()
    assert jobs.current_articles(spark, log).count() == len({i * i % 23 for i in range(60)})


def test_running_counts_hold_open_windows_and_late_rows(spark):
    path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
    stamps = [[1, 2, 30, 100], [3, 29, 101, 2000], [1, 1, 5], [100]]
    for i, hours in enumerate(stamps):
        df = spark.createDataFrame([(WHEN + dt.timedelta(hours=h), "neutral" if h % 2 else "positive") for h in hours], "published_date timestamp, sentiment_label string")
        land(df, path)
        jobs.run(jobs.count_batches(jobs.read_landed(spark, path, df.schema), out, mark, "1 day", compact_every=2))
        if i == 2:  # a batch that runs again replaces its own counts
            again = segments.open_segments(spark, out, 1).drop("batch_id")
            rows = spark.createDataFrame(again.collect(), again.schema)
            segments.put(rows, out, 2)
    every = [h for hours in stamps for h in hours]
    want = sorted({(h // 24, h % 2): sum(1 for x in every if x // 24 == h // 24 and x % 2 == h % 2) for h in every}.items())
    got = sorted((((r.window_start - WHEN).days, r.label == "neutral"), r.n) for r in jobs.running_counts(spark, out).collect())
    assert [(a, int(b), n) for (a, b), n in got] == [(a, b, n) for (a, b), n in want]


def test_window_counts_close_with_the_watermark(spark):
    path, out, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
    stamps = [(WHEN + dt.timedelta(hours=h), "neutral") for h in (1, 2, 30, 100)]
    df = spark.createDataFrame(stamps, "published_date timestamp, sentiment_label string")
    land(df, path)
    counts = jobs.label_counts(jobs.read_landed(spark, path, df.schema), "1 day", "1 day")
    jobs.run(jobs.append(counts, out, mark))
    got = sorted((r.window_start.day, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2), (2, 1)]
