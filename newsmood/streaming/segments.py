"""A log of micro-batches that is merged into a store from time to time.

Under one folder lie ``segments/batch_id=N`` (what batch N adds; a batch that is run again replaces
its own), stores merged from all segments up to a batch, each in a folder of its own, and
``manifest/version=N``, which names a store and the last batch in it. A merge writes its store
first and then the next version of the manifest, which appears as a whole or not at all, so a merge
that dies leaves nothing that is read. Readers take the newest manifest: they see that store and the
segments behind it, whatever is merged meanwhile. Of two merges at once, one fails to write its
version and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Manifest:
    """The newest merge: ``store`` holds all batches up to ``upto`` (none yet: None and -1)."""

    version: int = 0
    store: str | None = None
    upto: int = -1


_SCHEMA = "store string, upto long, version long"


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path: the folder may be in any store Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store Spark knows."""
    fs, at = _folder(spark, path)
    return fs.exists(at)


def put(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's segment; a batch that is run again replaces its own."""
    batch.write.mode("overwrite").parquet(f"{path}/segments/batch_id={batch_id}")


def manifest(spark: SparkSession, path: str) -> Manifest:
    if not exists(spark, f"{path}/manifest"):
        return Manifest()
    rows = spark.read.schema(_SCHEMA).option("basePath", f"{path}/manifest").json(f"{path}/manifest")
    newest = rows.orderBy(F.desc("version")).first()
    return Manifest(newest.version, newest.store, newest.upto) if newest else Manifest()


def open_segments(spark: SparkSession, path: str, after: int) -> DataFrame | None:
    """Rows of the batches behind the store, with their ``batch_id``."""
    if not exists(spark, f"{path}/segments"):
        return None
    return spark.read.parquet(f"{path}/segments").where(F.col("batch_id") > after)


#: Rows of a store (None before the first merge) and of open segments to the rows of both.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def read(spark: SparkSession, path: str, merge: Merge, load: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What store and open segments hold together; costs both, and no merged segment."""
    now = manifest(spark, path)
    store = load(spark, now.store) if now.store else None
    fresh = open_segments(spark, path, now.upto)
    if fresh is None:
        if store is None:
            raise ValueError(f"no batch was ever written to {path}")
        return store
    return merge(store, fresh)


def compact(
    spark: SparkSession,
    path: str,
    merge: Merge,
    load: Callable[[SparkSession, str], DataFrame],
    save: Callable[[DataFrame, str], None],
    upto: int | None = None,
    suffix: str = "0",
) -> Manifest:
    """Merge the store and the open segments up to a batch (all of them) into a new store, whose
    folder's name ends in ``-suffix``."""
    now = manifest(spark, path)
    fresh = open_segments(spark, path, now.upto)
    last = fresh.agg(F.max("batch_id")).first()[0] if fresh is not None else None
    last = last if upto is None or last is None else min(last, upto)
    if last is None or last <= now.upto:
        return now
    store = f"{path}/stores/{now.version + 1}-{uuid.uuid4().hex}-{suffix}"
    save(merge(load(spark, now.store) if now.store else None, fresh.where(F.col("batch_id") <= last)), store)
    new = Manifest(now.version + 1, store, last)
    row = spark.createDataFrame([(new.store, new.upto)], "store string, upto long")
    row.coalesce(1).write.mode("error").json(f"{path}/manifest/version={new.version}")
    return new


def drop_merged(spark: SparkSession, path: str) -> None:
    """Delete segments and stores that the newest manifest does not need.

    Readers that began with an older manifest may still use them: call it when there are none.
    """
    now = manifest(spark, path)
    for kind, needed in (
        ("segments", lambda name: not name.startswith("batch_id=") or int(name.split("=")[1]) > now.upto),
        ("stores", lambda name: now.store is None or name == now.store.rsplit("/", 1)[1]),
    ):
        fs, at = _folder(spark, f"{path}/{kind}")
        if fs.exists(at):
            for entry in fs.listStatus(at):
                if not needed(entry.getPath().getName()):
                    fs.delete(entry.getPath(), True)
