"""Queries that write files to the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A
from matchgrid.sources import labels, tables
from matchgrid.sources.store import shared_dir

TYPES = {"frame": "int", "event_id": "bigint", "x1": "double", "confidence": "double", "note": "string"}


def damaged_files(spark, d):
    """Detections as CSV files, some lines of which have a word for a number, a cell too many or a blank."""
    i = F.col("event_id")
    rows = A.detections(spark, d).select(
        i.cast("string").alias("event_id"), F.col("frame").cast("string").alias("frame"), F.when(i % 97 == 5, "n/a").otherwise(F.col("x1").cast("string")).alias("x1"),
        F.when(i % 89 == 4, "").otherwise(F.col("confidence").cast("string")).alias("confidence"), F.when(i % 83 == 7, "a,b").otherwise("").alias("team_hint"),
    )
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("a01_file_scan", """
SELECT kind, frame, count(*) AS n, sum(x1) AS x1 FROM (SELECT frame, CASE WHEN event_id % 97 = 5 OR event_id % 83 = 7 THEN 'malformed' WHEN event_id % 89 = 4 THEN 'blank' ELSE 'row' END AS kind, x1 FROM det) WHERE kind = 'row' GROUP BY ALL
UNION ALL SELECT kind, NULL, count(*), NULL FROM (SELECT CASE WHEN event_id % 97 = 5 OR event_id % 83 = 7 THEN 'malformed' ELSE 'blank' END AS kind FROM det WHERE event_id % 97 = 5 OR event_id % 83 = 7 OR event_id % 89 = 4) GROUP BY kind""", "det")
def file_scan(spark, d):
    """Good rows by frame, and the lines that were put aside by reason."""
    rows, rejects = tables.scan_csv(spark, damaged_files(spark, d), TYPES, required=("event_id", "confidence"))
    good = rows.groupBy(F.lit("row").alias("kind"), "frame").agg(F.count("*").alias("n"), F.sum("x1").alias("x1"))
    put_aside = rejects.groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n"))
    return good.unionByName(put_aside.select("kind", F.lit(None).cast("int").alias("frame"), "n", F.lit(None).cast("double").alias("x1")))


@query("a02_missing_file", """
SELECT 'there' AS file, least(30, count(*)) AS n, 0::BIGINT AS notes FROM det WHERE event_id % 97 <> 5 AND event_id % 83 <> 7 UNION ALL SELECT 'missing', 0, 0""", "det")
def missing_file(spark, d):
    """The first rows of a file that is there and of one that is not."""
    path = damaged_files(spark, d)
    found = [tables.scan_csv(spark, p, TYPES, limit=30)[0].agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.count("note").alias("notes")) for name, p in (("there", path), ("missing", f"{path}-none"))]
    return found[0].unionByName(found[1])


@query("b14_label_files", """
WITH c AS (SELECT frame, detection_id, least(x1, 1920)::BIGINT AS a, least(x2, 1920)::BIGINT AS b, y1::BIGINT AS c, y2::BIGINT AS e FROM det),
q AS (SELECT frame, detection_id, [(2000000 * (a + b) + 3840) // 7680, (2000000 * (c + e) + 2160) // 4320, (2000000 * (b - a) + 1920) // 3840, (2000000 * (e - c) + 1080) // 2160] AS q FROM c),
l AS (SELECT frame, count(*) AS n, md5(string_agg('0 ' || list_aggregate(list_transform(q, lambda v: printf('%d.%06d', v // 1000000, v % 1000000)), 'string_agg', ' ') || chr(10), '' ORDER BY detection_id)) AS labels FROM q GROUP BY frame)
SELECT CASE WHEN row_number() OVER (ORDER BY frame) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.18)) THEN 'val' ELSE 'train' END AS split, printf('frame_%06d.txt', frame + 1) AS file, n, labels FROM l""", "det")
def label_files(spark, d):
    """The training set's label files as they are read back."""
    path = f"{shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    labels.write_dataset(A.detections(spark, d), path)
    files = labels.read_dataset(spark, path)
    return files.select("split", "file", (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).cast("long").alias("n"), F.md5("value").alias("labels"))
