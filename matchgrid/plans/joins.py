"""Queries over joins: edit replay, as-of, range, nearest and theta joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators import editlog, ingest, pairs, temporal
from matchgrid.operators import series as S
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A


def base_boxes(spark, d):
    det = A.detections(spark, d)
    return det.select("frame", F.col("detection_id").alias("box_key"), "x1", "y1", "x2", "y2", F.when(F.col("team_hint") == "A", 1).when(F.col("team_hint") == "B", 2).otherwise(3).alias("group"))


_BASE = "bx AS (SELECT frame, detection_id AS box_key, x1, y1, x2, y2, CASE team_hint WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS \"group\", 'base' AS origin FROM det)"


@query("j09_existence_semi_join", """
SELECT DISTINCT a.event_id FROM det a WHERE EXISTS (SELECT 1 FROM det b WHERE b.frame = a.frame AND b.event_id <> a.event_id
  AND (a.foot_x - b.foot_x) * (a.foot_x - b.foot_x) + (a.foot_y - b.foot_y) * (a.foot_y - b.foot_y) <= 900)""", "det")
def existence_semi_join(spark, d):
    det = A.detections(spark, d)
    return pairs.near_any(det, det, "frame", 30.0, "event_id").select("event_id")


@query("j10_edit_replay", f"""
WITH {_BASE},
mv AS (SELECT frame, box_key, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'move') WHERE r = 1),
rg AS (SELECT frame, box_key, "group" AS g FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'reassign') WHERE r = 1),
ad AS (SELECT frame, box_key, x1, y1, x2, y2, "group", 'added' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'add') WHERE r = 1),
every AS (SELECT * FROM bx UNION ALL SELECT * FROM ad)
SELECT e.frame, e.box_key, coalesce(mv.x1, e.x1) AS x1, coalesce(mv.y1, e.y1) AS y1, coalesce(mv.x2, e.x2) AS x2, coalesce(mv.y2, e.y2) AS y2, coalesce(g, "group") AS "group", origin
FROM every e LEFT JOIN mv USING (frame, box_key) LEFT JOIN rg USING (frame, box_key)
WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.action = 'delete' AND x.frame = e.frame AND x.box_key = e.box_key)""", "det", "edits")
def edit_replay(spark, d):
    return editlog.replay(base_boxes(spark, d), A.edits(spark, d))


@query("j11_delete_anti_join", "SELECT event_id FROM det WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.action = 'delete' AND e.frame = det.frame AND e.box_key = det.detection_id)", "det", "edits")
def delete_anti_join(spark, d):
    gone = A.edits(spark, d).filter("action = 'delete'").select("frame", F.col("box_key").alias("detection_id"))
    return A.detections(spark, d).join(gone, ["frame", "detection_id"], "left_anti").select("event_id")


@query("j12_corrected_frames", "SELECT event_id FROM det WHERE frame IN (SELECT frame FROM edits WHERE action = 'reassign')", "det", "edits")
def corrected_frames(spark, d):
    return A.detections(spark, d).join(A.edits(spark, d).filter("action = 'reassign'"), "frame", "left_semi").select("event_id")


@query("j13_geometry_override", """
SELECT event_id, coalesce(m.x1, det.x1) AS x1, coalesce(m.y2, det.y2) AS y2, (coalesce(m.x1, det.x1) + coalesce(m.x2, det.x2)) / 2 AS foot_x
FROM det LEFT JOIN (SELECT frame, box_key, arg_max(x1, seq) AS x1, arg_max(x2, seq) AS x2, arg_max(y2, seq) AS y2 FROM edits WHERE action = 'move' GROUP BY ALL) m
  ON m.frame = det.frame AND m.box_key = det.detection_id""", "det", "edits")
def geometry_override(spark, d):
    moved = editlog.latest(A.edits(spark, d), ["move"], editlog.BOX)
    new = moved.select("frame", F.col("box_key").alias("detection_id"), *(F.col(f"new_{c}").alias(c) for c in editlog.BOX))
    boxes = editlog.with_geometry(A.detections(spark, d), new, ["frame", "detection_id"])
    return boxes.select("event_id", "x1", "y2", G.foot(F.col("x1"), F.col("x2"), F.col("y2"))[0].alias("foot_x"))


@query("j14_lookup_default", """
SELECT event_id, coalesce(n.name, '?') AS name, coalesce(m.new_id, player_id) AS merged FROM det
LEFT JOIN (SELECT tid, min(name) AS name FROM base WHERE tid % 4 <> 0 GROUP BY tid) n ON n.tid = player_id
LEFT JOIN (SELECT a, min(b) AS new_id FROM edges GROUP BY a) m ON m.a = player_id""", "det", "base", "edges")
def lookup_default(spark, d):
    names = A.base_names(spark, d).filter("tid % 4 <> 0").groupBy(F.col("tid").alias("player_id")).agg(F.min("name").alias("name"))
    merged = A.merge_edges(spark, d).groupBy(F.col("a").cast("int").alias("player_id")).agg(F.min("b").alias("new_id"))
    rows = A.detections(spark, d).join(names, "player_id", "left").join(merged, "player_id", "left")
    return rows.select("event_id", F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("new_id", F.col("player_id").cast("long")).alias("merged"))


@query("j15_point_enrichment", """
SELECT d.event_id, coalesce(t.x_pitch, d.foot_x) AS x, t.x_pitch IS NULL AS fallback FROM det d LEFT JOIN (SELECT * FROM track WHERE frame % 2 = 0) t
  ON t.frame = d.frame AND t.player_id = d.player_id""", "track")
def point_enrichment(spark, d):
    points = A.tracks(spark, d).filter("frame % 2 = 0").select("frame", "player_id", "x_pitch")
    rows = A.detections(spark, d).join(points, ["frame", "player_id"], "left")
    return rows.select("event_id", F.coalesce("x_pitch", "foot_x").alias("x"), F.col("x_pitch").isNull().alias("fallback"))


_FRAGMENTS = """
frag AS (SELECT *, player_id::BIGINT * 1000000000 + sum(CASE WHEN frame - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY frame) AS unit FROM (
  SELECT *, lag(frame) OVER (PARTITION BY player_id ORDER BY frame) AS prev FROM track)),
units AS (SELECT unit, min(frame) AS first, max(frame) AS last, count(*) AS n, arg_min(x_pitch, frame) AS sx, arg_min(y_pitch, frame) AS sy, arg_max(x_pitch, frame) AS ex,
  arg_max(y_pitch, frame) AS ey, arg_min(team, frame) AS team FROM frag GROUP BY unit)"""


def fragments(spark, d):
    """Tracks cut where a player is missing for more than two frames."""
    return pairs.fragments(A.tracks(spark, d), 3)


@query("j16_merge_candidates", f"""
WITH {_FRAGMENTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY frame) AS a, row_number() OVER (PARTITION BY unit ORDER BY frame DESC) AS z FROM frag),
v AS (SELECT unit,
  (arg_max(x_pitch, frame) FILTER (a <= 8) - arg_min(x_pitch, frame) FILTER (a <= 8)) / greatest(1, max(frame) FILTER (a <= 8) - min(frame) FILTER (a <= 8)) AS vx0,
  (arg_max(y_pitch, frame) FILTER (a <= 8) - arg_min(y_pitch, frame) FILTER (a <= 8)) / greatest(1, max(frame) FILTER (a <= 8) - min(frame) FILTER (a <= 8)) AS vy0,
  (arg_max(x_pitch, frame) FILTER (z <= 8) - arg_min(x_pitch, frame) FILTER (z <= 8)) / greatest(1, max(frame) FILTER (z <= 8) - min(frame) FILTER (z <= 8)) AS vx1,
  (arg_max(y_pitch, frame) FILTER (z <= 8) - arg_min(y_pitch, frame) FILTER (z <= 8)) / greatest(1, max(frame) FILTER (z <= 8) - min(frame) FILTER (z <= 8)) AS vy1 FROM ranked GROUP BY unit),
u AS (SELECT * FROM units JOIN v USING (unit)),
p AS (SELECT a.unit AS a_id, b.unit AS b_id, b.first - a.last AS gap, sqrt((a.ex - b.sx) * (a.ex - b.sx) + (a.ey - b.sy) * (a.ey - b.sy)) AS end_dist,
  least(105, greatest(0, a.ex + a.vx1 * (b.first - a.last))) - b.sx AS px, least(68, greatest(0, a.ey + a.vy1 * (b.first - a.last))) - b.sy AS py,
  24.0::DOUBLE * sqrt((a.vx1 - b.vx0) * (a.vx1 - b.vx0) + (a.vy1 - b.vy0) * (a.vy1 - b.vy0)) AS turn
  FROM u a JOIN u b ON b.first - a.last BETWEEN 1 AND 72 AND (a.team = b.team OR a.team = '' OR b.team = '') AND a.unit <> b.unit)
SELECT a_id, b_id, gap, round(end_dist, 3) AS end_dist, round(sqrt(px * px + py * py), 3) AS pred_dist, round(sqrt(px * px + py * py) + end_dist * 0.35::DOUBLE + gap * 0.04::DOUBLE + turn * 0.18::DOUBLE, 3) AS score
FROM p WHERE end_dist <= 14 AND sqrt(px * px + py * py) <= 10 AND end_dist * 24 / gap <= 9
ORDER BY round(sqrt(px * px + py * py) + end_dist * 0.35::DOUBLE + gap * 0.04::DOUBLE + turn * 0.18::DOUBLE, 6), a_id, b_id LIMIT 100""", "track")
def merge_candidates(spark, d):
    """The 100 best by score, as the review of candidates takes them."""
    rows = fragments(spark, d)
    unit = pairs.units(rows).join(S.edge_velocity(rows, "unit"), "unit")
    found = pairs.merge_candidates(unit).orderBy(F.round("score", 6), "a_id", "b_id").limit(100)
    return found.select("a_id", "b_id", "gap", *(F.round(c, 3).alias(c) for c in ("end_dist", "pred_dist", "score")))


@query("j18_as_of_identity", """
SELECT d.event_id, coalesce((SELECT o.name FROM overrides o WHERE o.tid = d.player_id AND o.frame <= d.frame ORDER BY o.frame DESC, o.seq LIMIT 1), b.name) AS name
FROM det d LEFT JOIN (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) b ON b.tid = d.player_id""", "det", "overrides", "base")
def as_of_identity(spark, d):
    base = A.base_names(spark, d).withColumn("frame", F.lit(-1))
    events = A.overrides(spark, d).unionByName(base).withColumnRenamed("tid", "player_id")
    return temporal.as_of(A.detections(spark, d).select("event_id", "player_id", "frame"), events, ["player_id"], "frame", "name", "seq").select("event_id", "name")


@query("j19_cut_boundaries", """
SELECT d.event_id, coalesce(max(o.frame), 0) AS cut FROM det d LEFT JOIN overrides o ON o.tid = d.player_id AND o.frame <= d.frame AND o.frame % 9 = 0 GROUP BY d.event_id""", "det", "overrides")
def cut_boundaries(spark, d):
    cuts = A.overrides(spark, d).filter("frame % 9 = 0").select(F.col("tid").alias("player_id"), "frame", F.col("frame").alias("cut"))
    rows = temporal.as_of(A.detections(spark, d).select("event_id", "player_id", "frame"), cuts, ["player_id"], "frame", "cut")
    return rows.select("event_id", F.coalesce("cut", F.lit(0)).alias("cut"))


@query("j20_keyframe_lerp", """
WITH around AS (
  SELECT f.frame, (SELECT max(k.frame) FROM keyframes k WHERE k.frame <= f.frame) AS a, (SELECT min(k.frame) FROM keyframes k WHERE k.frame >= f.frame) AS b FROM range(2000) t(fr), (SELECT fr::INT AS frame) f)
SELECT r.frame, round(ka.image_x + (kb.image_x - ka.image_x) * CASE WHEN a = b THEN 0 ELSE (r.frame - a) / (b - a)::DOUBLE END, 4) AS x,
       round(ka.image_y + (kb.image_y - ka.image_y) * CASE WHEN a = b THEN 0 ELSE (r.frame - a) / (b - a)::DOUBLE END, 4) AS y, (a = b)::INT AS is_key
FROM around r JOIN keyframes ka ON ka.frame = a JOIN keyframes kb ON kb.frame = b WHERE ka.state = 'pos' AND kb.state = 'pos'""", "keyframes")
def keyframe_lerp(spark, d):
    spine = spark.range(2000).select(F.col("id").cast("int").alias("frame"))
    found = temporal.between_keyframes(spine, A.keyframes(spark, d))
    return found.select("frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "is_key")


@query("j21_nearest_in_time", """
WITH t AS (SELECT DISTINCT player_id, (player_id * 7) % 100 + o AS target FROM track, (VALUES (-6), (0), (6), (12)) v(o))
SELECT player_id, target, (SELECT x.frame FROM track x WHERE x.player_id = t.player_id ORDER BY abs(x.frame - target), x.frame LIMIT 1) AS frame FROM t""", "track")
def nearest_in_time(spark, d):
    rows = A.tracks(spark, d).select("player_id", "frame")
    targets = rows.select("player_id").distinct().select("player_id", F.explode(F.array(*map(F.lit, (-6, 0, 6, 12)))).alias("o"))
    targets = targets.select("player_id", (F.col("player_id") * 7 % 100 + F.col("o")).alias("target"))
    return temporal.nearest_rows(rows, targets, ["player_id"], "frame", "target")


@query("j22_close_pairs", """
SELECT a.frame, a.detection_id AS a_id, b.detection_id AS b_id FROM pos a JOIN pos b ON a.frame = b.frame AND a.detection_id < b.detection_id
WHERE (a.x_pitch - b.x_pitch) * (a.x_pitch - b.x_pitch) + (a.y_pitch - b.y_pitch) * (a.y_pitch - b.y_pitch) < 16""", "pos")
def close_pairs(spark, d):
    return pairs.close_pairs(A.positions(spark, d), "frame", "detection_id", 4.0).select("frame", "a_id", "b_id")


@query("p23_overlap_pairs", """
SELECT a.frame, a.detection_id AS a_id, b.detection_id AS b_id,
       round((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)), 4) AS ratio
FROM det a JOIN det b ON a.frame = b.frame AND a.detection_id < b.detection_id
WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)""", "det")
def overlap_pairs(spark, d):
    return pairs.overlapping(A.detections(spark, d), "frame", "detection_id", 0.0).select("frame", "a_id", "b_id", F.round("ratio", 4).alias("ratio"))


@query("j23_nearest_site_raster", """
SELECT frame, px::INT AS px, py::INT AS py, arg_min(detection_id, struct_pack(d := (px * 5 - x_pitch) * (px * 5 - x_pitch) + (py * 4 - y_pitch) * (py * 4 - y_pitch), i := detection_id)) AS site
FROM pos, range(22) a(px), range(18) b(py) WHERE in_pitch <> 0 GROUP BY ALL""", "pos")
def nearest_site_raster(spark, d):
    return pairs.nearest_site(A.positions(spark, d).filter("in_pitch <> 0"), "detection_id", 22, 18, 5.0, 4.0)


@query("j25_carry_decision", """
SELECT b.tid, b.name, coalesce(o.name, '') AS decision FROM (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) b
LEFT JOIN (SELECT tid, arg_max(name, seq) AS name FROM overrides WHERE tid % 3 = 0 GROUP BY tid) o USING (tid)""", "base", "overrides")
def carry_decision(spark, d):
    rows = ingest.first_wins(A.base_names(spark, d), ["tid"], ["seq"])
    old = A.overrides(spark, d).filter("tid % 3 = 0").groupBy("tid").agg(F.max_by("name", "seq").alias("decision"))
    return rows.join(old, "tid", "left").select("tid", "name", F.coalesce("decision", F.lit("")).alias("decision"))


@query("j26_segment_tracks", """
SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY player_id) AS n FROM track WHERE frame IN (SELECT frame FROM edits WHERE action = 'add')) WHERE n >= 4""", "track", "edits")
def segment_tracks(spark, d):
    frames = A.edits(spark, d).filter("action = 'add'")
    rows = A.tracks(spark, d).join(frames, "frame", "left_semi")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("player_id"))).filter("n >= 4").select("event_id")


@query("j27_empty_frames", """
SELECT frame FROM (SELECT DISTINCT frame FROM det) f WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.frame = f.frame AND e."group" IN (1, 2) AND e.action = 'add') AND NOT frame BETWEEN 10 AND 20""", "det", "edits")
def empty_frames(spark, d):
    live = A.edits(spark, d).filter(F.col("group").isin(1, 2) & (F.col("action") == "add"))
    frames = A.detections(spark, d).select("frame").distinct().join(live, "frame", "left_anti")
    return ingest.without_intervals(frames, "frame", "10-20")


@query("j28_fragment_overlap", """
SELECT a.player_id AS a_id, b.player_id AS b_id, count(*) AS shared, round(avg(sqrt((a.x_pitch - b.x_pitch) * (a.x_pitch - b.x_pitch) + (a.y_pitch - b.y_pitch) * (a.y_pitch - b.y_pitch))), 3) AS mean,
       CASE WHEN avg(sqrt((a.x_pitch - b.x_pitch) * (a.x_pitch - b.x_pitch) + (a.y_pitch - b.y_pitch) * (a.y_pitch - b.y_pitch))) <= 30 THEN 'duplicate' ELSE 'different person' END AS verdict
FROM track a JOIN track b ON a.frame = b.frame AND a.player_id < b.player_id GROUP BY ALL""", "track")
def fragment_overlap(spark, d):
    found = pairs.shared_frames(A.tracks(spark, d), "player_id", limit=30.0)
    return found.withColumn("mean", F.round("mean", 3))


@query("j29_next_start", """
WITH e AS (SELECT player_id, team, max(frame) AS last, arg_max(foot_x, frame) AS x, arg_max(foot_y, frame) AS y FROM track GROUP BY player_id, team),
s AS (SELECT t.* FROM track t WHERE NOT EXISTS (SELECT 1 FROM track p WHERE p.player_id = t.player_id AND p.frame = t.frame - 1))
SELECT e.player_id, e.team, arg_min(s.player_id, struct_pack(c := round(sqrt((x - foot_x) * (x - foot_x) + (y - foot_y) * (y - foot_y)) / 1.5::DOUBLE + 2 * (s.frame - last), 6), f := s.frame, p := s.player_id)) AS next_id
FROM e JOIN s ON s.team = e.team AND s.player_id <> e.player_id AND s.frame > last AND s.frame <= last + 120 GROUP BY e.player_id, e.team""", "track")
def next_start(spark, d):
    return pairs.next_starts(A.tracks(spark, d), reach=120, scale=1.5)


@query("j30_between_frames", """
SELECT a.player_id, a.frame, k::INT AS k, round(a.x_pitch + (coalesce(b.x_pitch, a.x_pitch) - a.x_pitch) * k / 4.0::DOUBLE, 6) AS x
FROM track a LEFT JOIN track b ON b.player_id = a.player_id AND b.frame = a.frame + 1, range(4) t(k)""", "track")
def between_frames(spark, d):
    rows = A.tracks(spark, d)
    return pairs.in_betweens(rows, rows, 4).select("player_id", "frame", "k", F.round("x", 6).alias("x"))


@query("j31_full_frames", "SELECT event_id FROM det WHERE frame IN (SELECT frame FROM track GROUP BY frame HAVING count(*) = 14)", "track")
def full_frames(spark, d):
    full = A.tracks(spark, d).groupBy("frame").count().filter("count = 14")
    return A.detections(spark, d).join(full, "frame", "left_semi").select("event_id")


@query("j32_presence", """
WITH named AS (SELECT t.frame, coalesce(b.name, '') AS name FROM track t LEFT JOIN (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) b ON b.tid = t.player_id)
SELECT frame, count(DISTINCT name) AS n, md5(string_agg(DISTINCT name, ',' ORDER BY name)) AS names FROM named WHERE name NOT LIKE '%3' GROUP BY frame""", "track", "base")
def presence(spark, d):
    names = ingest.first_wins(A.base_names(spark, d), ["tid"], ["seq"]).select(F.col("tid").alias("player_id"), "name")
    rows = A.tracks(spark, d).join(names, "player_id", "left").withColumn("name", F.coalesce("name", F.lit(""))).filter("name not like '%3'")
    each = rows.groupBy("frame").agg(F.array_sort(F.collect_set("name")).alias("s"))
    return each.select("frame", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", ",")).alias("names"))
