"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where the session names none, a local master (one machine, as in tests) gets
    a temporary folder; on a cluster that would be another folder on every
    machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="matchgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made, or that were derived from one of its tables, and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path_of = context._jvm.org.apache.hadoop.fs.Path
        folder = path_of(table.stored_at) if hasattr(table, "stored_at") else path_of(table.inputFiles()[0]).getParent()
        shared = path_of(shared_dir(table.sparkSession))
        fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
        if fs.makeQualified(folder.getParent()).equals(fs.makeQualified(shared)):
            fs.delete(folder, True)
