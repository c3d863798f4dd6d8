"""Queries over the procedural matchers, trackers and chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.operators import matching as M
from matchgrid.operators import pairs, series
from matchgrid.operators.components import components
from matchgrid.operators.editlog import BOX
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A


def sides(spark, d, frames="true", x="foot_x", y="foot_y"):
    """Boxes of team A against those of team B, within the frame."""
    det = A.detections(spark, d).filter(frames)
    side = lambda team, p: det.filter(F.col("team_hint") == team).select("frame", F.col("detection_id").alias(p), F.col(x).alias(f"{p}x"), F.col(y).alias(f"{p}y"))
    return side("A", "l"), side("B", "r")


def matched(left, right, tolerance, solver="greedy"):
    return M.exclusive(M.candidate_pairs(left, right, "frame", M.foot_distance(), tolerance), "frame", solver)


@query("j02_pairs", """
SELECT a.frame, a.detection_id AS l, b.detection_id AS r, round(sqrt((a.foot_x - b.foot_x) * (a.foot_x - b.foot_x) + (a.foot_y - b.foot_y) * (a.foot_y - b.foot_y)), 4) AS cost
FROM det a JOIN det b ON a.frame = b.frame AND a.team_hint = 'A' AND b.team_hint = 'B'
WHERE sqrt((a.foot_x - b.foot_x) * (a.foot_x - b.foot_x) + (a.foot_y - b.foot_y) * (a.foot_y - b.foot_y)) <= 110""", "det")
def candidate_pairs(spark, d):
    left, right = sides(spark, d)
    return M.candidate_pairs(left, right, "frame", M.foot_distance(), 110.0).withColumn("cost", F.round("cost", 4))


#: A walk through the pairs ``pr`` of each frame in the order of cost, one step a pair, with the sides that are taken.
_WALK = """
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY cost, l, r) AS i FROM pr),
walk AS (SELECT frame, 0::BIGINT AS i, []::INT[] AS ul, []::INT[] AS ur, NULL::INT AS l, NULL::INT AS r, NULL::DOUBLE AS cost, false AS took FROM pr GROUP BY frame
  UNION ALL SELECT o.frame, o.i, CASE WHEN list_contains(ul, o.l) OR list_contains(ur, o.r) THEN ul ELSE list_append(ul, o.l) END, CASE WHEN list_contains(ul, o.l) OR list_contains(ur, o.r) THEN ur ELSE list_append(ur, o.r) END,
    o.l, o.r, o.cost, NOT (list_contains(ul, o.l) OR list_contains(ur, o.r)) FROM walk w JOIN o ON o.frame = w.frame AND o.i = w.i + 1),
taken AS (SELECT frame, l, r, cost FROM walk WHERE took)
"""


def _pairs(where: str, x: str = "foot_x", y: str = "foot_y", tolerance: int = 110, penalty: str = "0") -> str:
    """The candidate pairs of sides(), and the walk through them."""
    gap = f"sqrt((a.{x} - b.{x}) * (a.{x} - b.{x}) + (a.{y} - b.{y}) * (a.{y} - b.{y}))"
    return f"""
WITH RECURSIVE pr AS (SELECT a.frame, a.detection_id AS l, b.detection_id AS r, {gap} + {penalty} AS cost FROM det a JOIN det b ON a.frame = b.frame AND a.team_hint = 'A' AND b.team_hint = 'B' WHERE {gap} <= {tolerance} AND a.{where}),
{_WALK}"""


@query("j02_exclusive_match", _pairs("frame >= 0") + "SELECT * FROM taken", "det")
def exclusive_match(spark, d):
    return matched(*sides(spark, d), 110.0)


@query("j03_snap_match", _pairs("frame >= 0", tolerance=55) + """
SELECT d.frame, d.detection_id AS l, coalesce(p.foot_x, d.foot_x) AS x, coalesce(p.foot_y, d.foot_y) AS y FROM det d LEFT JOIN taken t ON t.frame = d.frame AND t.l = d.detection_id
LEFT JOIN det p ON p.frame = t.frame AND p.detection_id = t.r WHERE d.team_hint = 'A'""", "det")
def snap_match(spark, d):
    """Geometry of the matched partner replaces the box."""
    left, right = sides(spark, d)
    pairs_ = M.exclusive(M.candidate_pairs(left, right, "frame", M.foot_distance(), 55.0), "frame")
    return left.join(pairs_, ["frame", "l"], "left").join(right, ["frame", "r"], "left").select("frame", "l", F.coalesce("rx", "lx").alias("x"), F.coalesce("ry", "ly").alias("y"))


@query("j04_single_frame_match", _pairs("frame = 7") + "SELECT * FROM taken", "det")
def single_frame_match(spark, d):
    return matched(*sides(spark, d, "frame = 7"), 110.0)


@query("j05_centre_match", _pairs("frame >= 0", "center_x", "center_y", 30) + "SELECT * FROM taken", "det")
def centre_match(spark, d):
    """By the distance of the boxes' centres."""
    return matched(*sides(spark, d, x="center_x", y="center_y"), 30.0)


@query("j06_outer_match", _pairs("frame >= 0", tolerance=80, penalty="CASE WHEN a.detection_id % 2 <> b.detection_id % 2 THEN 1.5 ELSE 0 END") + """
SELECT d.frame, d.detection_id AS l, t.r, t.cost, coalesce(p.foot_x, d.foot_x) AS x, coalesce(p.foot_y, d.foot_y) AS y FROM det d LEFT JOIN taken t ON t.frame = d.frame AND t.l = d.detection_id
LEFT JOIN det p ON p.frame = t.frame AND p.detection_id = t.r WHERE d.team_hint = 'A'
UNION ALL SELECT d.frame, NULL, d.detection_id, NULL, d.foot_x, d.foot_y FROM det d WHERE d.team_hint = 'B' AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.frame = d.frame AND t.r = d.detection_id)""", "det")
def outer_match(spark, d):
    """Unlike parity, for unlike colour, counts 1.5 in the order but not against the tolerance; both sides' rest stays.

    A box of the left side keeps its own point where no detection was found for it.
    """
    left, right = sides(spark, d)
    penalty = F.when(F.col("l") % 2 != F.col("r") % 2, 1.5).otherwise(0.0)
    pairs_ = M.exclusive(M.candidate_pairs(left, right, "frame", M.foot_distance(), 80.0, penalty), "frame")
    every = M.with_unmatched(pairs_, left, right, "frame").join(left, ["frame", "l"], "left").join(right, ["frame", "r"], "left")
    return every.select("frame", "l", "r", "cost", F.coalesce("rx", "lx").alias("x"), F.coalesce("ry", "ly").alias("y"))


@query("j06_between_keyframes", f"""
WITH RECURSIVE fr AS (SELECT DISTINCT frame FROM det), mid AS (SELECT frame FROM fr WHERE frame % 2 = 1 AND frame - 1 IN (SELECT frame FROM fr) AND frame + 1 IN (SELECT frame FROM fr)),
k AS (SELECT *, lead(frame) OVER w AS nf, lead(x_pitch) OVER w AS nx, lead(y_pitch) OVER w AS ny, lead(x1) OVER w AS n1, lead(y2) OVER w AS n2 FROM track WHERE frame % 2 = 0 WINDOW w AS (PARTITION BY player_id ORDER BY frame)),
pri AS (SELECT m.frame, player_id AS l, team, x_pitch + (nx - x_pitch) * s AS x, y_pitch + (ny - y_pitch) * s AS y, x1 + (n1 - x1) * s AS x1, y2 + (n2 - y2) * s AS y2
  FROM (SELECT *, (m.frame - k.frame) / (nf - k.frame)::DOUBLE AS s FROM k JOIN mid m ON m.frame > k.frame AND m.frame < nf) k JOIN mid m ON m.frame = k.frame_1),
d AS (SELECT pos.* FROM pos JOIN mid USING (frame)),
pr AS (SELECT p.frame, p.l, d.detection_id AS r, round(sqrt((p.x - d.x_pitch) * (p.x - d.x_pitch) + (p.y - d.y_pitch) * (p.y - d.y_pitch)), 6) + CASE WHEN p.team = d.team_hint THEN 0 ELSE 1.5 END AS cost FROM pri p JOIN d USING (frame)
  WHERE round(sqrt((p.x - d.x_pitch) * (p.x - d.x_pitch) + (p.y - d.y_pitch) * (p.y - d.y_pitch)), 6) <= 4),
{_WALK}
SELECT 'detected' AS kind, t.frame, t.l AS tid, p.team, d.x1, d.y2 FROM taken t JOIN pri p ON p.frame = t.frame AND p.l = t.l JOIN d ON d.frame = t.frame AND d.detection_id = t.r
UNION ALL SELECT 'interpolated', frame, l, team, round(x1, 4), round(y2, 4) FROM pri p WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.frame = p.frame AND t.l = p.l)
UNION ALL SELECT 'extra', frame, NULL, team_hint, x1, y2 FROM d WHERE team_hint IN ('A', 'B') AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.frame = d.frame AND t.r = d.detection_id)""", "track")
def between_keyframes(spark, d):
    """Frames between keyframes: detections by the tracks' interpolated places, the tracks that found none with their interpolated box, and what is left."""
    pos = A.positions(spark, d)
    frames = pos.select("frame").distinct()
    around = frames.select((F.col("frame") + 1).alias("frame")).join(frames.select((F.col("frame") - 1).alias("frame")), "frame", "left_semi").join(frames, "frame", "left_semi")
    mids = around.filter("frame % 2 = 1")
    keys = A.tracks(spark, d).filter("frame % 2 = 0").select("frame", F.col("player_id").alias("l"), "team", "x_pitch", "y_pitch", *BOX)
    priors = series.between_samples(keys, "l", mids, ["x_pitch", "y_pitch", *BOX], ["team"])
    found = pos.join(mids, "frame").select("frame", F.col("detection_id").alias("r"), "team_hint", F.col("x_pitch").alias("rx"), F.col("y_pitch").alias("ry"), *(F.col(c).alias(f"r_{c}") for c in BOX))
    near = F.round(M.foot_distance(), 6)
    left = priors.withColumnsRenamed({"x_pitch": "lx", "y_pitch": "ly"})
    pairs_ = M.exclusive(M.candidate_pairs(left, found, "frame", near, 4.0, F.when(F.col("team") == F.col("team_hint"), 0.0).otherwise(1.5)), "frame")
    every = M.with_unmatched(pairs_, left, found, "frame").join(left, ["frame", "l"], "left").join(found, ["frame", "r"], "left")
    kind = F.when(F.col("l").isNull(), "extra").when(F.col("r").isNull(), "interpolated").otherwise("detected")
    rows = every.select(kind.alias("kind"), "frame", F.col("l").alias("tid"), F.coalesce("team", "team_hint").alias("team"), *(F.coalesce(f"r_{c}", F.round(c, 4)).alias(c) for c in BOX))
    return rows.filter((F.col("kind") != "extra") | F.col("team").isin("A", "B")).select("kind", "frame", "tid", "team", "x1", "y2")


@query("j08_optimal_assignment")
def optimal_assignment(spark, d):
    """The least total distance; detections without a partner open new objects after the frame's largest."""
    left, right = sides(spark, d)
    pairs_ = matched(left, right, 80.0, "optimal")
    rest = right.select("frame", "r").join(pairs_.select("frame", "r"), ["frame", "r"], "left_anti")
    most = left.groupBy("frame").agg(F.max("l").alias("most"))
    number = F.row_number().over(Window.partitionBy("frame").orderBy("r"))
    new = rest.join(most, "frame", "left").select("frame", (F.coalesce("most", F.lit(-1)) + number).alias("l"), "r", F.lit(None).cast("double").alias("cost"), F.lit(True).alias("is_new"))
    return pairs_.withColumn("is_new", F.lit(False)).unionByName(new)


@query("j01_nearest_tracker")
def nearest_tracker(spark, d):
    det = A.detections(spark, d).withColumn("clip", F.floor(F.col("frame") / 50).cast("int"))
    return M.track_nearest(det, "clip", "detection_id").withColumn("track_distance", F.round("track_distance", 2))


@query("j07_velocity_tracker")
def velocity_tracker(spark, d):
    pos = A.positions(spark, d).filter("in_pitch <> 0").withColumn("clip", F.floor(F.col("frame") / 50).cast("int"))
    return M.track_velocity(pos, "clip", "detection_id")


@query("j17_chain_merges")
def chain_merges(spark, d):
    rows = pairs.fragments(A.tracks(spark, d), 3)
    units = pairs.units(rows).withColumn("clip", F.floor(F.col("first") / 100).cast("int"))
    doubles = components(pairs.duplicate_pairs(rows, "unit"), "a_id", "b_id").withColumnRenamed("v", "unit")
    return M.chain_merges(units.join(doubles, "unit", "left").withColumn("component", F.coalesce("root", "unit")).drop("root"), "clip")


@query("t11_suppression", """
WITH RECURSIVE b AS (SELECT frame, detection_id, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'id': detection_id} AS b, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, detection_id) AS i FROM det),
w AS (SELECT frame, 0::BIGINT AS i, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, id INT)[] AS kept FROM b GROUP BY frame
  UNION ALL SELECT b.frame, b.i, CASE WHEN len(list_filter(w.kept, lambda k: least(k.x2, b.b.x2) > greatest(k.x1, b.b.x1) AND least(k.y2, b.b.y2) > greatest(k.y1, b.b.y1)
     AND (least(k.x2, b.b.x2) - greatest(k.x1, b.b.x1)) * (least(k.y2, b.b.y2) - greatest(k.y1, b.b.y1)) / least((k.x2 - k.x1) * (k.y2 - k.y1), (b.b.x2 - b.b.x1) * (b.b.y2 - b.b.y1)) > 0.3)) = 0 THEN list_append(w.kept, b.b) ELSE w.kept END
  FROM w JOIN b ON b.frame = w.frame AND b.i = w.i + 1),
k AS (SELECT frame, unnest(kept) AS k FROM w WHERE (frame, i) IN (SELECT frame, max(i) FROM b GROUP BY frame))
SELECT frame, k.id AS detection_id, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM k""", "det")
def suppression(spark, d):
    boxes = A.detections(spark, d).select("frame", "detection_id", "x1", "y1", "x2", "y2")
    return M.suppressed(boxes, "frame", "detection_id", 0.3)


@query("g20_two_clusters")
def two_clusters(spark, d):
    """2-means on feature vectors; the cluster with the lower mean first element is A."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = A.features(spark, d).withColumn("features", array_to_vector(F.col("q").cast("array<double>")))
    found = KMeans(k=2, seed=42, maxIter=50).fit(rows).transform(rows).select("vec_id", "q", "prediction")
    first = found.groupBy("prediction").agg(F.avg(F.get("q", F.lit(0))).alias("m")).agg(F.min_by("prediction", "m").alias("a"))
    return found.join(F.broadcast(first)).select("vec_id", F.when(F.col("prediction") == F.col("a"), "A").otherwise("B").alias("team"))  # first is one row
