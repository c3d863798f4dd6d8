"""Queries over regions of the pitch, heat, masks and colours of crops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators import analytics, boxgroups, colours, heat, masks, models, pairs, regions
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A

# Another way than cutting polygons: a border is an interval of a line, bounded by a linear inequality for every other player.
_LINES = """
pt AS (SELECT frame, detection_id AS id, team, x_pitch AS x, y_pitch AS y, row_number() OVER (PARTITION BY frame, x_pitch, y_pitch ORDER BY detection_id) AS r FROM pos WHERE x_pitch BETWEEN 0 AND 105 AND y_pitch BETWEEN 0 AND 68),
p AS (SELECT * FROM pt WHERE r = 1),
line AS (
  SELECT a.frame, a.id AS i, b.id AS j, a.x, a.y, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS ux, b.x - a.x AS uy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS size,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2 AS h, a.x AS qx, a.y AS qy FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id
  UNION ALL SELECT frame, id, s, x, y, mx, my, ux, uy, 1, abs((x - mx) * uy - (y - my) * ux), x, y FROM p, (VALUES (-1, 0, 0, 1, 0), (-2, 105, 0, 0, 1), (-3, 0, 68, 1, 0), (-4, 0, 0, 0, 1)) v(s, mx, my, ux, uy)),
cons AS (
  SELECT l.frame, l.i, l.j, 2 * (l.ux * (l.qx - k.x) + l.uy * (l.qy - k.y)) AS a, 2 * (l.mx * (l.qx - k.x) + l.my * (l.qy - k.y)) + k.x * k.x + k.y * k.y - l.qx * l.qx - l.qy * l.qy AS b
  FROM line l JOIN p k ON k.frame = l.frame AND k.id <> l.i AND k.id <> l.j
  UNION ALL SELECT frame, i, j, ux * sx + uy * sy, mx * sx + my * sy + c FROM line, (VALUES (1, 0, 0), (-1, 0, 105), (0, 1, 0), (0, -1, 68)) v(sx, sy, c)),
iv AS (SELECT frame, i, j, max(-b / a) FILTER (a > 1e-9) AS lo, min(-b / a) FILTER (a < -1e-9) AS hi, bool_or(abs(a) <= 1e-9 AND b < -1e-6) AS never FROM cons GROUP BY ALL),
seg AS (SELECT l.*, lo, hi FROM line l JOIN iv USING (frame, i, j) WHERE hi > lo AND NOT never)
"""


def strict(spark, d):
    """Players on the pitch itself."""
    return A.positions(spark, d).filter(F.col("x_pitch").between(0, G.LENGTH) & F.col("y_pitch").between(0, G.WIDTH))


@query("z04_cell_areas", f"""
WITH {_LINES}, c AS (SELECT frame, i, sum(h * size * (hi - lo)) / 2 AS area FROM seg GROUP BY ALL)
SELECT pt.frame, pt.id AS detection_id, team, round(coalesce(area, 0), 2) AS area FROM pt LEFT JOIN c ON c.frame = pt.frame AND c.i = pt.id AND r = 1""", "pos")
def cell_areas(spark, d):
    """The exact area that is nearest to each player, in every frame."""
    rows = strict(spark, d)
    found = regions.cells(rows, "frame", "detection_id").select("frame", F.col("detection_id").cast("int").alias("detection_id"), F.round("area", 2).alias("area"))
    return found.join(rows.select("frame", "detection_id", "team"), ["frame", "detection_id"])


@query("b09_ridges", f"""
WITH {_LINES}, e AS (SELECT frame, i AS a_id, j AS b_id, round(mx + ux * lo + 1e-6, 3) AS ax, round(my + uy * lo + 1e-6, 3) AS ay, round(mx + ux * hi + 1e-6, 3) AS bx, round(my + uy * hi + 1e-6, 3) AS by_ FROM seg WHERE j > i AND (hi - lo) * size > 1e-3)
SELECT frame, a_id::BIGINT AS a_id, b_id::BIGINT AS b_id, CASE WHEN (ax, ay) < (bx, by_) THEN ax ELSE bx END AS x1, CASE WHEN (ax, ay) < (bx, by_) THEN ay ELSE by_ END AS y1,
  CASE WHEN (ax, ay) < (bx, by_) THEN bx ELSE ax END AS x2, CASE WHEN (ax, ay) < (bx, by_) THEN by_ ELSE ay END AS y2 FROM e""", "pos")
def ridges(spark, d):
    """The borders between neighbouring cells of every frame, as segments."""
    return regions.ridges(regions.cells(strict(spark, d), "frame", "detection_id"), "frame", "detection_id")


@query("z04_reach_areas", """
WITH v AS (SELECT frame, player_id, team, x_pitch, y_pitch, CASE WHEN pf = frame - 1 THEN (x_pitch - px) * 2 ELSE 0 END AS vx, CASE WHEN pf = frame - 1 THEN (y_pitch - py) * 2 ELSE 0 END AS vy FROM (
  SELECT *, lag(frame) OVER w AS pf, lag(x_pitch) OVER w AS px, lag(y_pitch) OVER w AS py FROM track WINDOW w AS (PARTITION BY player_id ORDER BY frame))),
h AS (SELECT frame, player_id, team, x_pitch + vx * k AS x, y_pitch + vy * k AS y FROM (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) > 8 THEN 8 / sqrt(vx * vx + vy * vy) ELSE 1 END * 0.7::DOUBLE AS k FROM v)),
g AS (SELECT px, py, (px + 0.5::DOUBLE) * 5 AS cx, (py + 0.5::DOUBLE) * 4 AS cy FROM range(21) a(px), range(17) b(py)),
n AS (SELECT frame, px, py, min(struct_pack(s := round(0.7::DOUBLE + sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) / 8, 6), p := player_id, t := team)) AS best FROM h, g GROUP BY ALL)
SELECT frame, best.t AS team, count(*) * 20 AS area, round(avg(best.s), 4) AS seconds FROM n GROUP BY ALL""", "track")
def reach_areas(spark, d):
    """Square metres that each team reaches first in every frame, and the mean time to get there."""
    order = Window.partitionBy("player_id").orderBy("frame")
    follows = F.lag("frame").over(order) == F.col("frame") - 1
    speed = lambda c: F.when(follows, (F.col(c) - F.lag(c).over(order)) * 2).otherwise(0.0)  # noqa: E731  two frames a second
    rows = A.tracks(spark, d).withColumns({"vx": speed("x_pitch"), "vy": speed("y_pitch"), "who": F.struct("player_id", "team")})
    found = regions.first_to_arrive(rows, "frame", "who", 21, 17)
    return found.groupBy("frame", "site.team").agg((F.count("*") * 20).alias("area"), F.round(F.avg("seconds"), 4).alias("seconds"))


_LAB = """
lin AS (SELECT vec_id, j, r, g, bl, list_transform([r, g, bl], lambda c: CASE WHEN c / 255.0::DOUBLE > 0.04045 THEN pow((c / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE c / 255.0::DOUBLE / 12.92::DOUBLE END) AS c FROM px),
xyz AS (SELECT *, (0.412453::DOUBLE * c[1] + 0.357580::DOUBLE * c[2] + 0.180423::DOUBLE * c[3]) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * c[1] + 0.715160::DOUBLE * c[2] + 0.072169::DOUBLE * c[3] AS y,
  (0.019334::DOUBLE * c[1] + 0.119193::DOUBLE * c[2] + 0.950227::DOUBLE * c[3]) / 1.088754::DOUBLE AS z FROM lin),
f AS (SELECT *, list_transform([x, y, z], lambda t: CASE WHEN t > 0.008856 THEN cbrt(t) ELSE 7.787::DOUBLE * t + 16 / 116.0::DOUBLE END) AS f FROM xyz),
lab AS (SELECT vec_id, j, r, g, bl, round(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3::DOUBLE * y END * 2.55::DOUBLE) AS ll, round(500 * (f[1] - f[2]) + 128) AS la, round(200 * (f[2] - f[3]) + 128) AS lb FROM f)"""
_FEATURE = f"""
WITH {_LAB},
hs AS (SELECT *, greatest(r, g, bl) AS hi, least(r, g, bl) AS lo FROM lab),
h AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE 60 * (CASE WHEN hi = r THEN CASE WHEN g < bl THEN (g - bl) / (hi - lo)::DOUBLE + 6 ELSE (g - bl) / (hi - lo)::DOUBLE END WHEN hi = g THEN (bl - r) / (hi - lo)::DOUBLE + 2 ELSE (r - g) / (hi - lo)::DOUBLE + 4 END) END AS hue,
  CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0 END AS sat FROM hs),
k AS (SELECT *, floor(round(hue / 2) % 180 / 15) AS hb, floor(round(sat * 255) / (256 / 6.0::DOUBLE)) AS sb, floor(hi / (256 / 6.0::DOUBLE)) AS vb FROM h),
n AS (SELECT *, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, bl / 255.0::DOUBLE AS fb FROM k),
ft AS (SELECT vec_id, list_concat(list_transform(range(12), lambda i: len(list_filter(list(hb), lambda x: x = i)) / 21.0::DOUBLE), list_transform(range(6), lambda i: len(list_filter(list(sb), lambda x: x = i)) / 21.0::DOUBLE),
  list_transform(range(6), lambda i: len(list_filter(list(vb), lambda x: x = i)) / 21.0::DOUBLE),
  [avg(fr), avg(fg), avg(fb), stddev_pop(fr), stddev_pop(fg), stddev_pop(fb), avg(ll / 255), avg(la / 255), avg(lb / 255), stddev_pop(ll / 255), stddev_pop(la / 255), stddev_pop(lb / 255),
   count(*) FILTER (hue BETWEEN 65 AND 165 AND sat >= 0.25 AND hi / 255.0::DOUBLE >= 0.18 AND g > r + 5 AND g > bl - 5) / 21.0::DOUBLE, count(*) FILTER (fr < 0.25 AND fg < 0.25 AND fb < 0.25) / 21.0::DOUBLE,
   count(*) FILTER (fr > 0.75 OR fg > 0.75 OR fb > 0.75) / 21.0::DOUBLE, avg(fg - fr), avg(fg - fb), avg(fg / (fr + fb + 1e-4::DOUBLE))]) AS q FROM n GROUP BY vec_id)"""


def colour_features(spark, d):
    return colours.colour_features(A.pixels(spark, d), "px").select("vec_id", F.col("feature").alias("q"))


@query("f10_lab", f"WITH {_LAB} SELECT vec_id, sum(ll)::BIGINT AS l, sum(la)::BIGINT AS a, sum(lb)::BIGINT AS b FROM lab GROUP BY vec_id", "px")
def lab(spark, d):
    """Sums of the 8-bit LAB channels of every crop."""
    rows = A.pixels(spark, d).select("vec_id", F.transform("px", colours.lab).alias("lab"))
    total = lambda c: F.aggregate("lab", F.lit(0.0), lambda s, p: s + p[c]).cast("long").alias(c)
    return rows.select("vec_id", *map(total, "lab"))


@query("g29_colour_feature", _FEATURE + " SELECT vec_id, (i - 1)::INT AS i, round(q[i], 5) AS value FROM ft, range(1, 43) t(i)", "px")
def colour_feature(spark, d):
    """The 42 values of every crop."""
    return colour_features(spark, d).select("vec_id", F.posexplode("q").alias("i", "value")).withColumn("value", F.round("value", 5))


@query("j24_colour_knn", _FEATURE + """,
e AS (SELECT vec_id, unnest(list_transform(q, lambda v: round(v, 6))) AS x, generate_subscripts(q, 1) AS i FROM ft),
stats AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM e GROUP BY i),
z AS (SELECT vec_id, list((x - mean) / std ORDER BY i) AS z FROM e JOIN stats USING (i) GROUP BY ALL),
pairs AS (SELECT a.vec_id, (SELECT team FROM features f WHERE f.vec_id = b.vec_id) AS bt, list_distance(a.z, b.z) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.z, b.z), b.vec_id) AS r FROM z a JOIN z b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT vec_id, CASE WHEN round(sum(CASE WHEN bt = 1 THEN 1 ELSE -1 END / (d + 1e-6)), 9) >= 0 THEN 1 ELSE 2 END AS predicted FROM pairs WHERE r <= 7 GROUP BY ALL""", "px", "features")
def colour_knn(spark, d):
    """Teams by the nearest colour features, for the query set of searches."""
    found = colour_features(spark, d).withColumn("q", F.transform("q", lambda v: F.round(v, 6)))
    rows = models.z_scored(found.join(A.features(spark, d).select("vec_id", "team"), "vec_id"), "q")
    return models.knn(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "q", "team", 7, True).select("vec_id", "predicted")


@query("g31_dominant_colour")
def dominant_colour(spark, d):
    """The jersey colour of every crop."""
    found = colours.dominant_colour(A.pixels(spark, d), "px")
    return found.select("vec_id", *(F.round(F.col(f"jersey.{c}"), 3).alias(c) for c in "lab"), "jersey_pixels", F.round("jersey_score", 3).alias("jersey_score"))


_TAPS = "tap AS (SELECT i - 15 AS off, exp(-((i - 15) * (i - 15)) / (2 * 5.0::DOUBLE * 5.0::DOUBLE)) AS e FROM range(31) t(i)), k AS (SELECT off, e / (SELECT sum(e) FROM tap) AS w FROM tap)"


@query("b08_heat_map", f"""
WITH cell AS (SELECT px, py, count(*)::DOUBLE AS n FROM (SELECT trunc(x_pitch / 105 * 210)::INT AS px, trunc(y_pitch / 68 * 136)::INT AS py FROM track) WHERE px BETWEEN 0 AND 209 AND py BETWEEN 0 AND 135 GROUP BY ALL),
{_TAPS},
gx AS (SELECT x, off, CASE WHEN x + off < 0 THEN -(x + off) WHEN x + off > 209 THEN 418 - (x + off) ELSE x + off END AS src, w FROM range(210) t(x), k),
one AS (SELECT x AS px, py, sum(n * w) AS n FROM gx JOIN cell ON cell.px = src GROUP BY ALL),
gy AS (SELECT y, off, CASE WHEN y + off < 0 THEN -(y + off) WHEN y + off > 135 THEN 270 - (y + off) ELSE y + off END AS src, w FROM range(136) t(y), k),
two AS (SELECT px, y AS py, sum(n * w) AS n FROM gy JOIN one ON one.py = src GROUP BY ALL)
SELECT px::INT AS px, py::INT AS py, round(n / (SELECT max(n) FROM two), 6) AS heat, floor(round(n / (SELECT max(n) FROM two), 6) * 255)::INT AS level FROM two WHERE round(n / (SELECT max(n) FROM two), 6) > 0.03""", "track")
def heat_map(spark, d):
    """The blurred heat map of all players."""
    cells = analytics.heat_cells(A.tracks(spark, d), 210, 136)
    return heat.heat_map(cells, 210, 136, heat.kernel_size(210))


def mask_shapes(spark, d):
    """The boxes of overlapping masks."""
    x1, x2, y1, y2 = (F.col(c).cast("int") for c in ("x1", "x2", "y1", "y2"))
    rows = A.detections(spark, d).select("frame", F.col("detection_id").alias("object"), x1.alias("l"), x2.alias("r"), y1.alias("t"), y2.alias("b"), (F.col("confidence") * 10).alias("c"))
    return rows.dropna()


def mask_runs(boxes):
    """Every box is a diamond of runs, with a core that is surer than its rim."""
    l, r, t, b = (boxes.column(c).to_numpy().astype(np.int64) for c in "lrtb")  # noqa: E741
    lines = np.maximum(b - t + 1, 0)
    row = np.repeat(np.arange(len(lines)), lines)
    y = np.arange(len(row)) + (t - np.cumsum(lines) + lines)[row]
    inside = np.minimum(np.abs(2 * y - (t + b)[row]) // 8, np.trunc((r - l) / 2).astype(np.int64)[row])
    x1, x2, c = l[row] + inside, r[row] - inside, boxes.column("c").to_numpy()[row]
    return tuple(map(np.concatenate, ((row, row), (y, y), (x1, x1 + 3), (x2, x2 - 3), (c - 2, c))))


@query("a16_exclusive_masks", """
WITH b AS (SELECT frame, detection_id AS object, x1::INT AS l, x2::INT AS r, y1::INT AS t, y2::INT AS b, confidence * 10 AS c FROM det),
rw AS (SELECT *, least(trunc(abs(2 * y - t - b) / 8.0::DOUBLE)::INT, (r - l) // 2) AS inn FROM (SELECT *, unnest(range(t, b + 1)) AS y FROM b)),
runs AS (SELECT frame, object, y, l + inn AS x1, r - inn AS x2, c - 2 AS logit FROM rw UNION ALL SELECT frame, object, y, l + inn + 3, r - inn - 3, c FROM rw),
px AS (SELECT frame, y, x, arg_min(object, struct_pack(a := -logit, o := object)) AS object FROM (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM runs WHERE logit > 0) GROUP BY ALL)
SELECT frame, object, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2, count(*) AS pixels FROM px GROUP BY ALL HAVING count(*) >= 10""", "det")
def exclusive_masks(spark, d):
    """Boxes of all objects after every pixel has gone to its surest object."""
    found = masks.exclusive_boxes(mask_shapes(spark, d), mask_runs)
    return found.withColumns({c: F.col(c).cast("int") for c in ("y1", "y2")})


@query("g33_overlap_components", """
WITH RECURSIVE e AS (SELECT a.frame, a.detection_id AS x, b.detection_id AS y FROM det a JOIN det b ON a.frame = b.frame AND a.detection_id <> b.detection_id
  WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
    AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.05),
r AS (SELECT DISTINCT frame, x, x AS root FROM e UNION SELECT e.frame, e.y, r.root FROM r JOIN e ON e.frame = r.frame AND e.x = r.x),
c AS (SELECT frame, x, min(root) AS component FROM r GROUP BY ALL)
SELECT frame, x::BIGINT AS detection_id, component::BIGINT AS component, (dense_rank() OVER (PARTITION BY frame ORDER BY component) - 1)::INT AS colour FROM c""", "det")
def overlap_components(spark, d):
    """The groups of boxes that overlap, directly or through others, in every frame, each with its colour."""
    edges = pairs.overlapping(A.detections(spark, d), "frame", "detection_id", 0.05)
    found = boxgroups.coloured(boxgroups.components(edges, "frame"), "frame")
    return found.withColumnRenamed("node", "detection_id")
