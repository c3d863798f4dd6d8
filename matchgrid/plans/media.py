"""Queries over detectors, masks and sinks, with mock models."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.operators import export, ingest, tiles
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A
from matchgrid.sources import detectors as D


@query("a13_detector_fan_out", """
SELECT frame, i::INT AS detection_id, (60 + 80 * i + frame % 7)::DOUBLE AS x1, (300 + 90 * (i % 5))::DOUBLE AS y1, (90 + 80 * i + frame % 7)::DOUBLE AS x2, (360 + 90 * (i % 5))::DOUBLE AS y2, 0.5::DOUBLE AS confidence
FROM (SELECT DISTINCT frame FROM det), range(22) t(i)""", "det")
def detector_fan_out(spark, d):
    frames = A.detections(spark, d).select("frame").distinct().withColumn("content", F.lit(b""))
    return D.detected(frames, D.MockDetector)


@query("a16_mask_boxes", """
SELECT (event_id % 40)::INT AS frame, (user_id % 5)::INT AS obj, min(event_id % 97)::INT AS x1, min(event_id % 89)::INT AS y1, max(event_id % 97)::INT AS x2, max(event_id % 89)::INT AS y2
FROM events GROUP BY ALL HAVING count(*) >= 10""")
def mask_boxes(spark, d):
    i = F.col("event_id")
    masks = A.scan(spark, d, "events").select((i % 40).cast("int").alias("frame"), (F.col("user_id") % 5).cast("int").alias("obj"), (i % 97).cast("int").alias("x"), (i % 89).cast("int").alias("y"))
    return D.mask_boxes(masks)


@query("b02_fixed_fields", """
SELECT frame::VARCHAR AS frame, detection_id::VARCHAR AS detection_id, team_hint, '' AS note FROM det""", "det")
def fixed_fields(spark, d):
    return export.fields(A.detections(spark, d), ["frame", "detection_id", "team_hint", "note"])


@query("b07_polylines", """
SELECT player_id, count(*) AS n, sum((40 + trunc(x_pitch / 105 * 1050)) * ((frame % 10) + 1))::BIGINT AS mark FROM track GROUP BY player_id""", "track")
def polylines(spark, d):
    lines = export.polylines(A.tracks(spark, d))
    mark = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["x"] * (p["frame"] % 10 + 1))
    return lines.select("player_id", F.size("points").cast("long").alias("n"), mark.alias("mark"))


@query("b15_segment_export", """
SELECT frame, time, team, coalesce(n.name, '?') AS player, foot_x AS screen_x, foot_y AS screen_y, x_pitch, y_pitch, player_id AS track_id
FROM track LEFT JOIN (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) n ON n.tid = player_id""", "track", "base")
def segment_export(spark, d):
    names = ingest.first_wins(A.base_names(spark, d), ["tid"], ["seq"]).select(F.col("tid").alias("player_id"), F.col("name").alias("player"))
    rows = A.tracks(spark, d).join(names, "player_id", "left")
    return rows.select("frame", "time", "team", F.coalesce("player", F.lit("?")).alias("player"), F.col("foot_x").alias("screen_x"), F.col("foot_y").alias("screen_y"), "x_pitch", "y_pitch", F.col("player_id").alias("track_id"))


@query("z05_goal_windows", """
SELECT k.frame AS goal, count(*) AS rows, count(*) FILTER (x_pitch > 88.5) AS near FROM (SELECT frame FROM keyframes WHERE frame % 50 = 0) k JOIN track t ON t.frame BETWEEN k.frame - 10 AND k.frame + 10 GROUP BY k.frame""", "track", "keyframes")
def goal_windows(spark, d):
    from matchgrid.operators.temporal import range_join

    goals = A.keyframes(spark, d).filter("frame % 50 = 0").select(F.col("frame").alias("goal"))
    rows = range_join(goals, A.tracks(spark, d).select("frame", "x_pitch"), "goal", "frame", -10, 10)
    return rows.groupBy("goal").agg(F.count("*").alias("rows"), F.count_if(F.col("x_pitch") > 88.5).alias("near"))


@query("z10_tile_offsets", """
SELECT event_id, (x1 + (event_id % 2) * 960 - 40)::DOUBLE AS x1, (y1 + (event_id % 3) * 540 - 40)::DOUBLE AS y1 FROM det""", "det")
def tile_offsets(spark, d):
    i = F.col("event_id")
    return A.detections(spark, d).select("event_id", (F.col("x1") + (i % 2) * 960 - 40).alias("x1"), (F.col("y1") + (i % 3) * 540 - 40).alias("y1"))


@query("z10_tiled_detection", """
WITH RECURSIVE g AS (SELECT i + 2 * j AS tile, greatest(0, 960 * i - 60) AS l, greatest(0, 540 * j - 60) AS t, least(1920, 960 * (i + 1) + 60) AS r, least(1080, 540 * (j + 1) + 60) AS b FROM range(2) a(i), range(2) c(j)),
s AS (SELECT frame, detection_id * 4 + tile AS own, greatest(x1, l) AS x1, greatest(y1, t) AS y1, least(x2, r) AS x2, least(y2, b) AS y2 FROM det, g),
b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, own) AS i FROM s WHERE x2 - x1 >= 2 AND y2 - y1 >= 2),
w AS (SELECT frame, 0::BIGINT AS i, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, own BIGINT)[] AS kept FROM b GROUP BY frame
  UNION ALL SELECT b.frame, b.i, CASE WHEN len(list_filter(w.kept, lambda k: least(k.x2, b.x2) > greatest(k.x1, b.x1) AND least(k.y2, b.y2) > greatest(k.y1, b.y1)
     AND (least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1)) / least((k.x2 - k.x1) * (k.y2 - k.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.6)) = 0
     THEN list_append(w.kept, {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'own': b.own}) ELSE w.kept END FROM w JOIN b ON b.frame = w.frame AND b.i = w.i + 1),
k AS (SELECT frame, unnest(kept) AS k FROM w WHERE (frame, i) IN (SELECT frame, max(i) FROM b GROUP BY frame))
SELECT frame, k.own AS own, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM k""", "det")
def tiled_detection(spark, d):
    """Boxes as a grid of 2 x 2 overlapping tiles sees them, put together again."""
    grid = tiles.tile_grid(1920, 1080, 2, 2, 60)
    boxes = A.detections(spark, d).select("frame", F.col("detection_id").cast("long").alias("own"), "x1", "y1", "x2", "y2")
    return tiles.from_tiles(tiles.seen_in_tiles(boxes, grid), grid, "frame", 0.6)
