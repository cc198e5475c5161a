"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a temporary folder; on a cluster it must be set, as a
    folder of one machine would not do.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="cadenza-")
    context.setCheckpointDir(told)
    return told


_kept: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet. Shuffle files of the write go as soon as it ends, not when the driver happens to collect its garbage.

    The session's setting is put back. (A query that another thread begins meanwhile drops its own shuffle files
    too, and Spark makes them again if they are asked for.)
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and executors may be lost afterwards."""
    path = f"{ensure_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    _kept.append(path)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def let_go(*tables: DataFrame) -> None:
    """Deletes tables of :func:`kept` that nothing will read any more."""
    for table in tables:
        drop(table.sparkSession, table._kept_at)
        if table._kept_at in _kept:
            _kept.remove(table._kept_at)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_kept(spark: SparkSession) -> None:
    """Deletes all tables of :func:`kept` so far: for callers who have written what was derived from them."""
    while _kept:
        drop(spark, _kept.pop())
