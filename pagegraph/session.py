"""Session builder and session-level helpers used by every module."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "pagegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; `conf` keys use __ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a private folder only where that is unset and all runs in one process (tests). On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagegraph-"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def taken(df: DataFrame, folder: str) -> DataFrame:
    """A result checkpointed, so that the folder it was read from can go."""
    out = df.checkpoint()
    remove_folder(df.sparkSession, folder)
    return out


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files behind."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path beside the checkpoints that nothing uses yet."""
    ready_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A result written once and read again, like a checkpoint, but with no shuffle files left behind."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _bytes(size: str) -> int:
    """A size as settings have it (67108864b, 64m, 1gb)."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 64) -> None:
    """Keeps Arrow batches small enough for long texts on small executors: so many rows at most, and so many MB or one row more."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > mb << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
