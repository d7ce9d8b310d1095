"""The stored article table: upsert by URL, retention, migration.

A stored table has one row per URL. Built-in file tables have no MERGE, so an
upsert is a set-based rewrite into a new place; the caller then switches readers
to it. ``save_bucketed`` lays the table out by URL so that an upsert shuffles the
incoming batch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsmood.operators.articles import from_stored, query_articles, to_stored, top_n_per_group
from newsmood.operators.sentiment import analyze


def last_by_url(df: DataFrame, *order: str) -> DataFrame:
    """One row per URL: the last in the given order (``seq`` by default)."""
    return top_n_per_group(df, ["url"], [F.desc(c) for c in order or ("seq",)], 1)


def _merged(store: DataFrame, incoming: DataFrame, *order: str) -> DataFrame:
    """Store and batch side by side: the merged columns, and whether either has the URL."""
    fresh = last_by_url(incoming, *order)
    columns = list(dict.fromkeys(store.columns))
    missing = set(columns) - set(fresh.columns)
    if missing:
        raise ValueError(f"incoming rows lack columns: {sorted(missing)}")
    old, new = store.alias("old"), fresh.alias("new")
    is_new = F.col("new.url").isNotNull()

    def value(c: str) -> Column:
        if c in ("url", "created_at"):
            return F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
        return F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return old.join(new, F.col("old.url") == F.col("new.url"), "full_outer").select(
        *[value(c) for c in columns], F.col("old.url").isNotNull().alias("_old"), is_new.alias("_new")
    )


def upsert(store: DataFrame, incoming: DataFrame, *order: str) -> DataFrame:
    """Store after saving ``incoming`` (stored rows) in order.

    A known URL gets every incoming value but keeps ``created_at``; the last record
    of a URL wins. The batch is reduced to one row per URL before the join, so no
    URL is hot in it.
    """
    return _merged(store, incoming, *order).drop("_old", "_new")


def save_upsert(store: DataFrame, incoming: DataFrame, path: str, *order: str) -> dict[str, int]:
    """Write the store after saving ``incoming`` to a new place and return the counts of the save.

    The join that is written is the join that is counted; its tasks observe the URLs of the batch,
    the new and the known ones, and the store's size. Saved records are counted over the batch
    alone, as a stage that is run again would count them twice.
    """
    seen = Observation()
    old, new = F.col("_old"), F.col("_new")
    counts = [
        F.count_if(new).alias("urls"),
        F.count_if(new & ~old).alias("inserted"),
        F.count_if(new & old).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    ]
    _merged(store, incoming, *order).observe(seen, *counts).drop("_old", "_new").write.mode("error").option("compression", "zstd").parquet(path)
    return {"saved": incoming.count(), **seen.get}


def upsert_counts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row, before anything is saved: the records of a batch, their distinct URLs, new and
    known ones, and the store's size after it. ``save_upsert`` counts while it saves."""
    urls = incoming.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    known = store.select("url", F.lit(True).alias("known"))
    is_new, is_known = F.col("n").isNotNull(), F.col("known").isNotNull()
    return urls.join(known, "url", "full_outer").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("saved"),
        F.count_if(is_new).alias("urls"),
        F.count_if(is_new & ~is_known).alias("inserted"),
        F.count_if(is_new & is_known).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def expired(as_of: Column, days: int = 30) -> Column:
    """Scraped strictly before ``as_of`` minus ``days``; unknown scrape dates stay."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return F.coalesce(F.col("scraped_date") < cutoff, F.lit(False))


def purge(store: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return store.where(~expired(as_of, days))


def purge_counts(store: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    gone = expired(as_of, days)
    return store.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def migrate(source: DataFrame, target: DataFrame, path: str) -> dict[str, int]:
    """Upsert all of one store into another, written to a new place; the counts of the save."""
    return save_upsert(target, source, path, "updated_at")


def reanalyze(
    store: DataFrame,
    as_of: Column,
    analyzer: str = "lexicon",
    keywords: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Score stored rows again and upsert them.

    Without a limit every chosen row is rewritten where it is: no join is needed,
    because the rows to update are rows of the store itself.
    """
    if limit:
        chosen = query_articles(store, keywords=keywords, limit=limit)
        fresh = to_stored(analyze(from_stored(chosen), analyzer), as_of)
        return upsert(store, fresh, "updated_at")
    hit = F.lit(True)
    if keywords:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.col("content").like(f"%{k}%") | F.col("title").like(f"%{k}%")
    # Rows that are not chosen are scored as blank texts, which costs nothing.
    texts = ("title", "content")
    kept = {f"_{c}": F.col(c) for c in texts} | {"_hit": F.coalesce(hit, F.lit(False))}
    blank = {c: F.when(F.col("_hit"), F.col(c)).otherwise("") for c in texts}
    scored = analyze(store.withColumns(kept).withColumns(blank), analyzer)
    scored = scored.withColumns({c: F.col(f"_{c}") for c in texts})
    new = {
        "sentiment_label": F.col("sentiment.label"),
        "sentiment_confidence": F.col("sentiment.confidence"),
        "sentiment_scores": F.col("sentiment.scores"),
        "sentiment_model": F.col("sentiment.model_used"),
        "updated_at": as_of,
    }
    return scored.withColumns(
        {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}
    ).select(*store.columns)


def save_partitioned(df: DataFrame, path: str) -> None:
    """Write stored rows by source type and publication day, sorted by URL within files.

    Rows are spread by URL as well as by day, so a busy day is written by many tasks.
    """
    day = F.to_date("published_date")
    (
        df.withColumn("published_day", day)
        .repartition("source_type", "published_day", F.pmod(F.xxhash64("url"), F.lit(16)))
        .sortWithinPartitions("source_type", "published_day", "url")
        .write.mode("overwrite")
        .partitionBy("source_type", "published_day")
        .option("parquet.bloom.filter.enabled#url", "true")
        .parquet(path)
    )


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write the store bucketed by URL, so upserts and URL joins do not shuffle it."""
    (
        df.repartition(buckets, "url")
        .write.mode("overwrite")
        .bucketBy(buckets, "url")
        .sortBy("url")
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
