"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "newsmood", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on: timestamps are read and shown as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_BUILT: dict[tuple, Column] = {}


def built_once(df: DataFrame, key: tuple, make: Callable[[], Column]) -> Column:
    """A large expression that is always the same, built once per application.

    Every node of an expression costs a call into the JVM, so building one of a few
    thousand nodes takes longer than planning it.
    """
    full = (df.sparkSession.sparkContext.applicationId, *key)
    if full not in _BUILT:
        _BUILT[full] = make()
    return _BUILT[full]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for files one job writes and another reads.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a local
    session without that setting falls back to the machine's temporary folder;
    on a cluster executors would not see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="newsmood-")
    return f"{root.rstrip('/')}/newsmood/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores.

    Text work costs far more CPU than I/O, and a file with a single row group
    would keep one core busy. Inputs that already split into as many partitions
    as there are cores, as any large table does, come back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
