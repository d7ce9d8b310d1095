"""A run as a unit: store, export, dump and log of one ingest, committed together.

Under one folder every attempt of a run writes into a folder of its own: the articles it scored, the
stored table after it, the export and dump made from what was written, and its log. Then one record,
the next version of the manifest, names the attempt; it appears as a whole or not at all, so an
attempt that dies is never read. A run builds on the store of the newest run before it. The newest
run may be repeated: it builds on the same store again and its new attempt takes the old one's
place, in the store and in the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.operators.articles import from_stored, to_stored
from newsmood.operators.store import save_upsert
from newsmood.plans.jobs import ingest_to_summary
from newsmood.schema import INGEST_LOG
from newsmood.sources.files import article_json, write_articles
from newsmood.streaming.segments import exists

#: One record of the manifest.
RECORD = "run_id string, attempt string, base string, saved long, urls long, inserted long, updated long, total long, exported long, version long"


@dataclass(frozen=True)
class Run:
    """A committed run: its folder, that of the run it builds on, and its counts."""

    run_id: str
    attempt: str
    base: str | None
    saved: int
    urls: int
    inserted: int
    updated: int
    total: int
    exported: int
    version: int

    def path(self, part: str) -> str:
        return f"{self.attempt}/{part}"


def history(spark: SparkSession, root: str) -> list[Run]:
    """The committed runs in order, a repeated one by its last attempt; one small record a run."""
    if not exists(spark, f"{root}/manifest"):
        return []
    rows = spark.read.schema(RECORD).option("basePath", f"{root}/manifest").json(f"{root}/manifest")
    newest = {r.run_id: Run(**r.asDict()) for r in rows.orderBy("version").collect()}
    return sorted(newest.values(), key=lambda r: r.version)


def run(
    found: DataFrame,
    log: DataFrame,
    root: str,
    run_id: str,
    as_of: Column,
    analyzer: str | Sequence[str] = "lexicon",
    fmt: str = "json",
    order: Sequence[str] = ("seq",),
) -> Run:
    """Clean, score and save ingested articles as run ``run_id``, with the log of their sources.

    ``log`` has a row per source (``registry.ingest_log``). Only the newest run can be repeated.
    """
    spark = found.sparkSession
    done = history(spark, root)
    if any(r.run_id == run_id for r in done[:-1]):
        raise ValueError(f"later runs build on run {run_id!r}")
    base = done[-1].base if done and done[-1].run_id == run_id else (done[-1].path("store") if done else None)
    attempt = f"{root}/attempts/{run_id}-{uuid.uuid4().hex}"
    scored = ingest_to_summary(found, as_of, analyzer, order=order)
    # Scores are computed once; what follows reads what is written here.
    scored.articles.write.option("compression", "zstd").parquet(f"{attempt}/articles")
    articles = spark.read.parquet(f"{attempt}/articles")
    fresh = to_stored(articles, as_of)
    store = spark.read.parquet(base) if base else fresh.where("false")
    counts = save_upsert(store, fresh, f"{attempt}/store", "updated_at")
    exported = write_articles(from_stored(spark.read.parquet(f"{attempt}/store")), f"{attempt}/export", fmt)
    log.select(*INGEST_LOG.names).write.parquet(f"{attempt}/log")
    dump(articles, spark.read.parquet(f"{attempt}/log"), f"{attempt}/dump")
    version = max((r.version for r in done), default=0) + 1
    record = spark.createDataFrame([(run_id, attempt, base, *counts.values(), exported)], ", ".join(RECORD.split(", ")[:-1]))
    record.coalesce(1).write.mode("error").option("ignoreNullFields", "false").json(f"{root}/manifest/version={version}")
    return Run(run_id, attempt, base, *counts.values(), exported, version)


def dump(articles: DataFrame, log: DataFrame, path: str) -> None:
    """What a run found, as JSON: ``sources`` has a line per source, ``articles`` one per article with
    its source, so that a source of any size splits in part files. Those are compressed: a dump is as large as its texts."""
    log.write.json(f"{path}/sources")
    articles.select(F.to_json(F.struct("source", article_json(articles).alias("article"))).alias("value")).write.text(f"{path}/articles", compression="gzip")


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log rows and ``(source, json)`` of a dump."""
    lines = spark.read.text(f"{path}/articles").select(F.from_json("value", "source string, article string").alias("r"))
    return spark.read.schema(INGEST_LOG).json(f"{path}/sources"), lines.select("r.source", F.col("r.article").alias("json"))


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """``run_id`` and log rows of all committed runs: attempts that died or were repeated do not count."""
    rows = spark.createDataFrame([], f"run_id string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in INGEST_LOG.fields)}")
    for r in history(spark, root):
        rows = rows.unionByName(spark.read.schema(INGEST_LOG).parquet(r.path("log")).withColumn("run_id", F.lit(r.run_id)))
    return rows


def current_store(spark: SparkSession, root: str) -> DataFrame:
    """The stored table after the newest run."""
    done = history(spark, root)
    if not done:
        raise ValueError(f"no run is committed in {root}")
    return spark.read.parquet(done[-1].path("store"))
