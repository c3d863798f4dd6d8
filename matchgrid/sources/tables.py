"""Scans of delimited files that keep what they cannot read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REJECT = "_rejected"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever store it lies; a path with wildcards is if something matches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def scan_csv(spark: SparkSession, path: str, types: dict[str, str], required: tuple[str, ...] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header.

    Columns are found by name: a column of the files that ``types`` does not name is text, one that the files do not have is null.
    A line goes to the rejects (file, reason, line) if it has too many or too few cells or a cell that is not of its type (``malformed``), or if
    a ``required`` cell is blank (``blank``); all columns are parsed for that, whichever are read later. A path that does not exist is an empty table. ``limit`` takes
    so many good rows at most, in no fixed order.
    """
    if not exists(spark, path):
        rows = spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in types.items())))
        return rows, spark.createDataFrame([], "file string, reason string, line string")
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    # Cells are read as text and cast here: a typed scan checks only the columns that a plan needs, so its rejects would depend on the plan.
    fields = [T.StructField(n, T.StringType()) for n in [*header, REJECT]]
    reader = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
    raw = reader.option("columnPruning", False).csv(path).withColumn("_file", F.input_file_name())
    cell = {n: F.col(f"`{n}`").try_cast(types.get(n, "string")).alias(n) for n in header}
    bad, blank = F.col(REJECT).isNotNull(), F.lit(False)
    for name in header:
        bad = bad | ((F.trim(F.col(f"`{name}`")) != "") & cell[name].isNull())
    for name in required:
        blank = blank | (cell[name].isNull() if name in header else F.lit(True))
    bad = F.coalesce(bad, F.lit(False))
    missing = [F.lit(None).cast(t).alias(n) for n, t in types.items() if n not in header]
    rows = raw.filter(~bad & ~blank).select(*cell.values(), *missing)
    line = F.coalesce(REJECT, F.to_csv(F.struct(*(F.col(f"`{n}`").alias(n) for n in header))))
    rejects = raw.filter(bad | blank).select(F.col("_file").alias("file"), F.when(bad, "malformed").otherwise("blank").alias("reason"), line.alias("line"))
    return rows if limit is None else rows.limit(limit), rejects
