"""Sinks: fixed-field CSV, JSON lines, versioned tables, segments and a report."""

from __future__ import annotations

import html
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named fields as text: missing ones and nulls are empty, others are left out."""
    have = set(df.columns)
    return df.select(*((F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")).alias(n) for n in names))


def write_csv(df: DataFrame, names: list[str], path: str) -> None:
    fields(df, names).write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def versioned(df: DataFrame, root: str, name: str) -> str:
    """Write a new version of a table beside the older ones; the path is the version.

    A table is never overwritten while a plan may still read it; going back
    is reading an older version.
    """
    path = f"{root}/{name}/v={time.time_ns()}"
    df.write.parquet(path)
    return path


def versions(df_spark, root: str, name: str) -> list[str]:
    """All versions of a table, oldest first."""
    jvm, conf = df_spark.sparkContext._jvm, df_spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = folder.getFileSystem(conf)
    return sorted(str(s.getPath()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def write_segments(df: DataFrame, path: str) -> None:
    """Partitioned by segment, so that readers prune to the ones they ask for."""
    df.write.partitionBy("segment").parquet(path)


def polylines(tracks: DataFrame) -> DataFrame:
    """(player_id, points): each player's pixel points in time order, for drawing."""
    from matchgrid.functions import geometry as G

    point = F.struct("frame", G.to_pixel(F.col("x_pitch"), G.LENGTH, 1050, 40).alias("x"), G.to_pixel(F.col("y_pitch"), G.WIDTH, 680, 40).alias("y"))
    return tracks.groupBy("player_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def dashboard(cards: dict[str, object], tables: dict[str, DataFrame], rows: int = 30) -> str:
    """An HTML report of metric cards and the first rows of small tables."""
    parts = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>"]
    parts += [f"<div class='card'><b>{html.escape(str(k))}</b> {html.escape(str(v))}</div>" for k, v in cards.items()]
    for title, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])
