"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, below the one named by spark.checkpoint.dir.

    Where none is named, a local session (tests) gets one of its own; on a cluster that is an error, as
    executors would each write to their own disks.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from its files: cuts lineage, survives executor loss.

    Unlike a checkpoint of rows, the table is computed once, compressed, and read by columns.  It is deleted
    when the session ends, or by ``drop``.  The shuffle files it was made of go as soon as it is written, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # a query made under the setting
    finally:
        spark.conf.set(CLEANUP, before)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``; what was made of it must be written already."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(path).startswith("table-"):
            fs, at = _hadoop(df.sparkSession, path)
            fs.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; what else goes wrong with it isn't hidden."""
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they don't have it installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
