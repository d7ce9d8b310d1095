"""Structured Streaming jobs over landed payload files.

All of them run once over what has arrived (``availableNow``) by default and
continue from their checkpoint next time, which is the polling loop of an
incremental ingest. Pass ``trigger`` to keep a query running.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsmood.operators.articles import COPY_SALTS, top_n_per_group
from newsmood.operators.store import last_by_url, save_bucketed, upsert
from newsmood.sources.registry import parse
from newsmood.streaming import segments

ONCE = {"availableNow": True}


def read_landed(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append rows to a Parquet table, exactly once per input file."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start(path)
    )


def ingest(payloads: DataFrame, kind: str, as_of: Column) -> DataFrame:
    """Landed payloads of one kind to ARTICLE rows: the batch parser, on a stream."""
    return parse(kind, payloads, as_of)


def dedup(df: DataFrame, delay: str, time: str = "scraped_date", salts: int = COPY_SALTS) -> DataFrame:
    """First sight of each URL; a URL is remembered for ``delay`` of event time.

    A first round per (URL, salt) lets a URL that fills the stream be handled by
    ``salts`` tasks; the second sees at most one row per salt. The delay bounds the
    state. Rows later than it are dropped and repeats from farther apart pass:
    ``unique_batches`` is exact for any distance.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    first = salted.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "_salt"])
    return first.dropDuplicatesWithinWatermark(["url"]).drop("_salt")


#: Bits of one bucket of the filter of seen URLs, the size of Spark's bitmaps.
BLOOM_BITS = 32768
BLOOM_HASHES = 4


def _bloom_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")


def _bloom_places() -> Column:
    """Bits of a URL within its bucket."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(j), F.col("url")), F.lit(BLOOM_BITS)) for j in range(BLOOM_HASHES)])


def _bloom_of(urls: DataFrame, buckets: int) -> DataFrame:
    """``bucket, bits`` of some URLs."""
    places = urls.select(_bloom_bucket(buckets).alias("bucket"), F.explode(_bloom_places()).alias("place"))
    return places.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def _may_hold(bits: Column) -> Column:
    """Whether the filter of a URL's bucket has all its bits."""
    byte = lambda p: F.conv(F.hex(F.substr(bits, (p / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.forall(_bloom_places(), lambda p: F.getbit(byte(p), (p % 8).cast("int")) == 1), F.lit(False))


def unique_batches(
    df: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ("scraped_date",), buckets: int = 256, trigger: dict | None = None
) -> StreamingQuery:
    """First sight of each URL, whatever the distance and lateness, read by ``unique_rows``.

    A batch is reduced to its first row per URL in the given order and held against a Bloom filter
    of the URLs seen before, ``BLOOM_BITS`` for each bucket of URLs: rows it does not know are new,
    and only the others are looked up in the seen URLs of their parts. The filter is all that goes
    from batch to batch and has a fixed size; one that has filled up costs look-ups, never rows.
    Every step of a batch replaces its own folder, so a batch may run again.
    """
    parts = 16

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{path}/staged/batch_id={batch_id}"
        top_n_per_group(batch, ["url"], [F.col(c) for c in order], 1).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        known = _latest(spark, f"{path}/filters", batch_id)
        if known is not None:
            filters = known.select(F.col("bucket").alias("_bucket"), "bits")
            tested = rows.withColumn("_bucket", _bloom_bucket(buckets)).join(filters, "_bucket", "left")
            tested = tested.withColumn("_maybe", F.coalesce(_may_hold(F.col("bits")), F.lit(False))).drop("bits")
            maybe = tested.where("_maybe")
            asked = [r[0] for r in maybe.select(F.col("_bucket") % parts).distinct().collect()]
            seen = spark.read.parquet(f"{path}/unique").where((F.col("batch_id") < batch_id) & F.col("part").isin(asked))
            new = maybe.join(seen.select("url"), "url", "left_anti")
            rows = tested.where("NOT _maybe").unionByName(new).drop("_maybe", "_bucket")
        out = f"{path}/unique/batch_id={batch_id}"
        rows.withColumn("part", _bloom_bucket(buckets) % parts).write.mode("overwrite").partitionBy("part").parquet(out)
        fresh = _bloom_of(spark.read.schema(rows.schema).parquet(out), buckets)
        both = fresh if known is None else fresh.unionByName(known.select("bucket", "bits"))
        merged = both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        merged.write.mode("overwrite").parquet(f"{path}/filters/batch_id={batch_id}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def _latest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The newest batch's rows before a batch."""
    if not segments.exists(spark, path):
        return None
    rows = spark.read.parquet(path).where(F.col("batch_id") < before)
    last = rows.agg(F.max("batch_id")).first()[0]
    return None if last is None else rows.where(F.col("batch_id") == last)


def unique_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``unique_batches`` kept."""
    return spark.read.parquet(f"{path}/unique").drop("batch_id", "part")


def log_batches(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int | None = None, buckets: int = 16
) -> StreamingQuery:
    """Upsert as a log: each micro-batch replaces its own segment.

    A batch that is run again overwrites the same folder, so the sink is idempotent,
    and a batch costs its own size rather than a rewrite of the store. The URL is
    reduced to its last record within the batch before writing. With ``compact_every``
    the log is merged into its store after every so many batches.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        segments.put(last_by_url(batch), path, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_log(batch.sparkSession, path, buckets)

    return (
        df.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def _reduced(log: DataFrame) -> DataFrame:
    """Segments as one batch: per URL the last record, created at its first one."""
    last = top_n_per_group(log, ["url"], [F.desc("batch_id"), F.desc("seq")], 1)
    first = log.groupBy("url").agg(F.min_by("created_at", "batch_id").alias("_created"))
    return (
        last.join(first, "url")
        .withColumn("created_at", F.col("_created"))
        .drop("_created", "batch_id")
    )


def _upserted(store: DataFrame | None, fresh: DataFrame) -> DataFrame:
    rows = _reduced(fresh)
    return rows if store is None else upsert(store, rows)


def _bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The store in a folder with its buckets, so that joins by URL do not shuffle it.

    Buckets are known to the catalog only; a session that has not met the store enters it.
    """
    table = _table_of(path)
    if not spark.catalog.tableExists(table):
        buckets = path.rsplit("-", 1)[1]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _table_of(path: str) -> str:
    return "upsert_store_" + path.rsplit("/", 1)[1].replace("-", "_")


def compact_log(spark: SparkSession, path: str, buckets: int = 16, upto: int | None = None) -> segments.Manifest:
    """Merge the segments of an upsert log, up to a batch, into its store, bucketed by URL."""
    return segments.compact(spark, path, _upserted, _bucketed, lambda rows, at: save_bucketed(rows, _table_of(at), at, buckets), upto, str(buckets))


def current_articles(spark: SparkSession, path: str) -> DataFrame:
    """The table behind an upsert log: per URL the last record, created at its first one.

    The newest batch wins; batch ids grow with time. Costs the store, which is not shuffled, and
    the segments behind it.
    """
    return segments.read(spark, path, _upserted, _bucketed)


def count_batches(
    df: DataFrame,
    path: str,
    checkpoint: str,
    window: str,
    label: str = "sentiment_label",
    time: str = "published_date",
    trigger: dict | None = None,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Running counts per event-time window and label, read by ``running_counts``.

    Each micro-batch adds its own counts under its id, and replaces them when it runs again. So
    windows are there while they are open, rows of any lateness correct the counts they belong to,
    and nothing is kept as state.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = batch.where(F.col(time).isNotNull()).groupBy(F.window(time, window), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        segments.put(counts.select(F.col("window.start").alias("window_start"), "label", "n"), path, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_counts(batch.sparkSession, path)

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def _summed(store: DataFrame | None, fresh: DataFrame) -> DataFrame:
    rows = fresh.select("window_start", "label", "n")
    rows = rows if store is None else store.select("window_start", "label", "n").unionByName(rows)
    return rows.groupBy("window_start", "label").agg(F.sum("n").alias("n"))


def _plain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact_counts(spark: SparkSession, path: str, upto: int | None = None) -> segments.Manifest:
    """Merge the counts of all batches, up to one, into one count per window and label."""
    return segments.compact(spark, path, _summed, _plain, lambda rows, at: rows.write.parquet(at), upto)


def running_counts(spark: SparkSession, path: str) -> DataFrame:
    """``window_start, label, n`` of everything counted so far, open windows included."""
    return segments.read(spark, path, _summed, _plain)


def label_counts(
    df: DataFrame, window: str, delay: str, label: str = "sentiment_label", time: str = "published_date"
) -> DataFrame:
    """Counts per closed event-time window and label, for sinks that can only append.

    Open windows and rows later than ``delay`` are not in them; ``count_batches`` has both.
    """
    return (
        df.withWatermark(time, delay)
        .groupBy(F.window(time, window), F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "label", "n")
    )


def run(query: StreamingQuery) -> None:
    """Wait for a run-once query; its failure is raised here."""
    query.awaitTermination()
