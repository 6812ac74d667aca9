"""Helpers that the operators share: reading tables, cutting lineage, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that ``written`` made in a local session.
_PATHS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alone(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a temporary
    folder is set for the session; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _alone(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='varve-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs only the tasks that ran on it, and rows that
    follow from a shuffle's order are fixed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if _alone(spark):
        _PATHS.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._varve_path = path
    return out


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in this process; results that
    read them must have been used by then."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _PATHS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _at_exit() -> None:
    """What a local session wrote to this machine's disk goes with the process."""
    for path in _PATHS:
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_varve_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    """The text column, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
