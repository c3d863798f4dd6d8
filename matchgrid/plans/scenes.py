"""Queries over shots, saved edits and click logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators import analytics, clicks, cover, editlog
from matchgrid.operators.temporal import range_join
from matchgrid.plans.joins import _BASE, base_boxes
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A

_BALL = f"""
balls AS (SELECT k.frame, ({A._H[0]} * image_x + {A._H[1]} * iy + {A._H[2]}) / nullif({A._H[6]} * image_x + {A._H[7]} * iy + {A._H[8]}, 0) AS x,
    ({A._H[3]} * image_x + {A._H[4]} * iy + {A._H[5]}) / nullif({A._H[6]} * image_x + {A._H[7]} * iy + {A._H[8]}, 0) AS y FROM (SELECT *, 690 + image_y % 210 AS iy FROM keyframes) k WHERE state = 'pos'),
held AS (SELECT frame, x, y, team, hx, hy FROM (SELECT b.*, t.team, t.x_pitch AS hx, t.y_pitch AS hy, row_number() OVER (PARTITION BY b.frame ORDER BY round((t.x_pitch - x) * (t.x_pitch - x) + (t.y_pitch - y) * (t.y_pitch - y), 6), t.detection_id) AS r
    FROM balls b JOIN track t USING (frame)) WHERE r = 1)"""


def balls(spark, d):
    """The ball on the pitch, by frame."""
    x, y = G.projected(F.col("image_x"), 690 + F.col("image_y") % 210)  # keyframes have other heights, the pitch is there
    return A.keyframes(spark, d).filter("state = 'pos'").select("frame", x.alias("ball_x"), y.alias("ball_y"))


def holders(spark, d):
    """(frame, team, ball_x, ball_y, x, y): the player nearest to the ball of every keyframe, the first detection on a tie."""
    near = F.round(G.squared(F.col("x_pitch"), F.col("y_pitch"), F.col("ball_x"), F.col("ball_y")), 6)
    rows = A.tracks(spark, d).select("frame", "detection_id", "team", "x_pitch", "y_pitch").join(balls(spark, d), "frame")
    who = F.struct("team", "ball_x", "ball_y", F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))
    return rows.groupBy("frame").agg(F.min_by(who, F.struct(near, "detection_id")).alias("h")).select("frame", "h.*")


def shots(spark, d):
    """A shot from every ball keyframe by its holder; A plays towards the far goal."""
    return holders(spark, d).drop("x", "y").withColumn("goal_x", F.when(F.col("team") == "A", G.LENGTH).otherwise(0.0))


@query("z08_near_holder", f"""
WITH {_BALL} SELECT h.frame, count(*) FILTER (t.team = h.team) AS own, count(*) FILTER (t.team <> h.team) AS others FROM held h JOIN track t ON t.frame = h.frame
WHERE (t.x_pitch - hx) * (t.x_pitch - hx) + (t.y_pitch - hy) * (t.y_pitch - hy) <= 400 GROUP BY h.frame""", "track", "keyframes")
def near_holder(spark, d):
    """Players within 20 m of the one at the ball, himself included, by team."""
    held = holders(spark, d).select("frame", F.col("team").alias("own"), "x", "y")
    rows = A.tracks(spark, d).join(held, "frame").filter(G.squared(F.col("x_pitch"), F.col("y_pitch"), F.col("x"), F.col("y")) <= 400)
    return rows.groupBy("frame").agg(F.count_if(F.col("team") == F.col("own")).alias("own"), F.count_if(F.col("team") != F.col("own")).alias("others"))


@query("z09_goal_shift", f"""
WITH {_BALL}, g AS (SELECT frame AS goal, CASE WHEN x > 52.5 THEN 'far' ELSE 'near' END AS side FROM balls WHERE (x BETWEEN 88.5 AND 110 OR x BETWEEN -5 AND 16.5) AND y BETWEEN 13.84 AND 54.16),
c AS (SELECT frame, team, sum(round(x_pitch * 1000)::BIGINT) / count(*) / 1000 AS x FROM track GROUP BY ALL)
SELECT goal, side, team, round(avg(x) FILTER (frame < goal), 4) AS before, round(avg(x) FILTER (frame > goal), 4) AS after, round(avg(x) FILTER (frame > goal) - avg(x) FILTER (frame < goal), 4) AS shift
FROM g JOIN c ON c.frame BETWEEN goal - 20 AND goal + 20 GROUP BY ALL""", "track", "keyframes")
def goal_shift(spark, d):
    """How far each team's centroid moves from the ten seconds before to the ten seconds after the ball is in front of a goal."""
    front = (F.col("ball_x").between(88.5, 110) | F.col("ball_x").between(-5, 16.5)) & F.col("ball_y").between(13.84, 54.16)
    goals = balls(spark, d).filter(front).select(F.col("frame").alias("goal"), F.when(F.col("ball_x") > G.LENGTH / 2, "far").otherwise("near").alias("side"))
    rows = range_join(goals, analytics.centroids(A.tracks(spark, d)).select("frame", "team", "centroid_x"), "goal", "frame", -20, 20)
    mean = lambda test: F.avg(F.when(test, F.col("centroid_x")))
    before, after = mean(F.col("frame") < F.col("goal")), mean(F.col("frame") > F.col("goal"))
    return rows.groupBy("goal", "side", "team").agg(F.round(before, 4).alias("before"), F.round(after, 4).alias("after"), F.round(after - before, 4).alias("shift"))


@query("z06_shot_cover", f"""
WITH {_BALL},
shot AS (SELECT frame, team, y AS by_, CASE team WHEN 'A' THEN 105 - x ELSE x END AS depth FROM held),
seen AS (SELECT *, atan2(30.34 - by_, depth) AS low, atan2(37.66 - by_, depth) AS high FROM shot WHERE depth > 0),
def AS (SELECT s.*, t.detection_id, CASE s.team WHEN 'A' THEN 105 - x_pitch ELSE x_pitch END AS line, y_pitch FROM seen s JOIN track t ON t.frame = s.frame AND t.team <> s.team),
who AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY line * line + (y_pitch - 34) * (y_pitch - 34), detection_id) = 1 AS keeper,
  depth - line AS ahead, y_pitch - by_ AS aside, sqrt((depth - line) * (depth - line) + (y_pitch - by_) * (y_pitch - by_)) AS far FROM def),
ang AS (SELECT *, CASE WHEN far > CASE WHEN keeper THEN 1.2 ELSE 0.35 END THEN asin(CASE WHEN keeper THEN 1.2 ELSE 0.35 END / far) ELSE pi() / 2 END AS half FROM who WHERE ahead > 0 AND line >= 0),
iv AS (SELECT frame, low, high, keeper, greatest(low, atan2(aside, ahead) - half) AS lo, least(high, atan2(aside, ahead) + half) AS hi FROM ang
  WHERE least(high, atan2(aside, ahead) + half) > greatest(low, atan2(aside, ahead) - half)),
kinds AS (SELECT frame, 'all' AS kind, lo, hi FROM iv UNION ALL SELECT frame, CASE WHEN keeper THEN 'keeper' ELSE 'wall' END, lo, hi FROM iv UNION ALL SELECT frame, k, high, high FROM seen, (VALUES ('all'), ('wall'), ('keeper')) v(k)),
gaps AS (SELECT k.frame, kind, coalesce(max(hi) OVER (PARTITION BY k.frame, kind ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low) AS a, lo, low, high FROM kinds k JOIN seen USING (frame)),
g AS (SELECT *, greatest(a, lo) - a AS gap, (greatest(a, lo) + a) / 2 AS mid FROM gaps),
s AS (SELECT frame, max(low) AS low, max(high) - max(low) AS total, sum(gap) FILTER (kind = 'wall') AS w, sum(gap) FILTER (kind = 'keeper') AS k, sum(gap) FILTER (kind = 'all') AS o FROM g GROUP BY frame),
m AS (SELECT frame, gap, mid FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(gap, 9) DESC, round(a, 9)) AS r FROM g WHERE kind = 'all') WHERE r = 1)
SELECT frame, round(degrees(total), 4) AS goal_angle, round((k - o) / total, 5) AS wall_only, round((w - o) / total, 5) AS keeper_only, round((total - w - k + o) / total, 5) AS both, round(o / total, 5) AS open,
  (SELECT count(*) FROM iv WHERE iv.frame = s.frame AND NOT keeper) AS n_wall, round(degrees(gap), 4) AS widest_gap, round((mid - low) * 2 / total - 1, 4) AS gap_place FROM s JOIN m USING (frame)""", "track", "keyframes")
def shot_cover(spark, d):
    """Which share of the goal mouth wall and keeper cover, from the ball of every keyframe."""
    taken = shots(spark, d)
    rows = A.tracks(spark, d).select("frame", F.col("detection_id").alias("who"), F.col("team").alias("own"), "x_pitch", "y_pitch")
    defenders = rows.join(taken.select("frame", "team"), "frame").filter("own <> team")
    found = cover.shot_cover(taken, defenders, "frame")
    places = {"goal_angle": 4, "wall_only": 5, "keeper_only": 5, "both": 5, "open": 5, "widest_gap": 4, "gap_place": 4}
    return found.select("frame", "n_wall", *(F.round(c, n).alias(c) for c, n in places.items()))


@query("k01_saved_difference", f"""
WITH {_BASE},
mv AS (SELECT frame, box_key, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'move') WHERE r = 1),
rg AS (SELECT frame, box_key, "group" AS g FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'reassign') WHERE r = 1),
ad AS (SELECT frame, box_key, x1, y1, x2, y2, "group", 'added' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM edits WHERE action = 'add') WHERE r = 1),
every AS (SELECT * FROM bx UNION ALL SELECT * FROM ad),
ed AS (SELECT e.frame, e.box_key, coalesce(mv.x1, e.x1) AS x1, coalesce(mv.y1, e.y1) AS y1, coalesce(mv.x2, e.x2) AS x2, coalesce(mv.y2, e.y2) AS y2, coalesce(g, "group") AS "group"
  FROM every e LEFT JOIN mv USING (frame, box_key) LEFT JOIN rg USING (frame, box_key) WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.action = 'delete' AND x.frame = e.frame AND x.box_key = e.box_key)),
j AS (SELECT frame, box_key, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a."group" AS ag, b.x1, b.y1, b.x2, b.y2, b."group" AS bg FROM bx a FULL JOIN ed b USING (frame, box_key)),
acts AS (SELECT *, 0 AS place, 'add' AS action FROM j WHERE ag IS NULL UNION ALL SELECT *, 1, 'delete' FROM j WHERE bg IS NULL UNION ALL SELECT *, 2, 'reassign' FROM j WHERE ag <> bg
  UNION ALL SELECT *, 3, 'move' FROM j WHERE round(ax1, 1) <> round(x1, 1) OR round(ay1, 1) <> round(y1, 1) OR round(ax2, 1) <> round(x2, 1) OR round(ay2, 1) <> round(y2, 1))
SELECT row_number() OVER (ORDER BY frame, box_key, place)::BIGINT AS seq, frame, box_key, action, CASE WHEN place IN (0, 3) THEN round(x1, 1) END AS x1, CASE WHEN place IN (0, 3) THEN round(y1, 1) END AS y1,
  CASE WHEN place IN (0, 3) THEN round(x2, 1) END AS x2, CASE WHEN place IN (0, 3) THEN round(y2, 1) END AS y2, coalesce(bg, ag) AS "group" FROM acts""", "det", "edits")
def saved_difference(spark, d):
    """What a save writes after all edits: the shortest log from the boxes as they were to the boxes as they are."""
    base = base_boxes(spark, d)
    return editlog.difference(base, editlog.replay(base, A.edits(spark, d)))


@query("k02_reset_boxes", f"""
WITH {_BASE},
log AS (SELECT * FROM edits WHERE frame % 10 <> 3),
mv AS (SELECT frame, box_key, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM log WHERE action = 'move') WHERE r = 1),
rg AS (SELECT frame, box_key, "group" AS g FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM log WHERE action = 'reassign') WHERE r = 1),
ad AS (SELECT frame, box_key, x1, y1, x2, y2, "group", 'added' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_key ORDER BY seq DESC) AS r FROM log WHERE action = 'add') WHERE r = 1),
every AS (SELECT * FROM bx UNION ALL SELECT * FROM ad)
SELECT e.frame, e.box_key, coalesce(mv.x1, e.x1) AS x1, coalesce(mv.y1, e.y1) AS y1, coalesce(mv.x2, e.x2) AS x2, coalesce(mv.y2, e.y2) AS y2, coalesce(g, "group") AS "group", origin
FROM every e LEFT JOIN mv USING (frame, box_key) LEFT JOIN rg USING (frame, box_key) WHERE NOT EXISTS (SELECT 1 FROM log x WHERE x.action = 'delete' AND x.frame = e.frame AND x.box_key = e.box_key)""", "det", "edits")
def reset_boxes(spark, d):
    """All boxes after the edits, every tenth frame set back to its original detections."""
    base, log = base_boxes(spark, d), A.edits(spark, d)
    return editlog.replay(base, editlog.reset(log, log.filter("frame % 10 = 3")))


def found_anew(base):
    """A second detector's boxes: where those of ``base`` are, from too narrow to wide."""
    key = F.col("box_key")
    return base.filter(key % 7 != 0).select("frame", key.alias("place"), (F.col("x1") + 0.28).alias("x1"), "y1", (F.col("x1") + 1.53 + key % 4).alias("x2"), "y2", (1 + key % 3).cast("int").alias("group"))


@query("k02_redetected_log", f"""
WITH {_BASE},
kept AS (SELECT seq, frame, box_key, action, x1, y1, x2, y2, "group" FROM edits WHERE frame < 20),
found AS (SELECT frame, box_key AS place, x1 + 0.28 AS x1, y1, x1 + 1.53 + box_key % 4 AS x2, y2, 1 + box_key % 3 AS "group" FROM bx WHERE box_key % 7 <> 0 AND frame >= 20),
ad AS (SELECT frame, -row_number() OVER (ORDER BY frame, place) AS box_key, 'add' AS action, round(x1, 1) AS x1, round(y1, 1) AS y1, round(x2, 1) AS x2, round(y2, 1) AS y2, "group" FROM found WHERE x2 - x1 >= 2 AND y2 - y1 >= 2),
fresh AS (SELECT frame, box_key, 'delete' AS action, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, "group" FROM bx WHERE frame >= 20 UNION ALL SELECT * FROM ad)
SELECT * FROM kept UNION ALL
SELECT (SELECT coalesce(max(seq), 0) FROM kept) + row_number() OVER (ORDER BY frame, action DESC, abs(box_key)) AS seq, frame, box_key, action, x1, y1, x2, y2, "group" FROM fresh""", "det", "edits")
def redetected_log(spark, d):
    """The edit log once all frames from 20 on were detected anew."""
    base = base_boxes(spark, d)
    return editlog.redetected(base, A.edits(spark, d), base, found_anew(base), 20)


def click_log(spark, d):
    """A click log for every customer: the order's key is its place."""
    o, k = A.scan(spark, d, "orders"), F.col("o_orderkey")
    last = F.when(k % 5 == 0, "reset").otherwise("save")
    action = F.when(F.col("o_orderpriority") == "5-LOW", last).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "undo").otherwise("click")
    return o.select(F.col("o_custkey").alias("session"), k.alias("seq"), action.alias("action"), (k % 1900).cast("double").alias("x"), (k % 1010).cast("double").alias("y"))


@query("k10_point_log", """
WITH RECURSIVE l AS (SELECT o_custkey AS session, o_orderkey AS seq, CASE o_orderpriority WHEN '5-LOW' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'reset' ELSE 'save' END WHEN '4-NOT SPECIFIED' THEN 'undo' ELSE 'click' END AS action,
  (o_orderkey % 1900) || ':' || (o_orderkey % 1010) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT session, 0::BIGINT AS i, []::VARCHAR[] AS points, NULL::VARCHAR AS saved, 0::BIGINT AS ignored, 0::BIGINT AS idle, 0::BIGINT AS refused FROM l GROUP BY session
  UNION ALL SELECT r.session, l.i, CASE action WHEN 'reset' THEN []::VARCHAR[] WHEN 'undo' THEN points[1:len(points) - 1] WHEN 'click' THEN CASE WHEN len(points) < 4 THEN list_append(points, p) ELSE points END ELSE points END,
    CASE WHEN action = 'save' AND len(points) = 4 THEN array_to_string(points, ' ') ELSE saved END, ignored + (action = 'click' AND len(points) = 4)::INT, idle + (action = 'undo' AND len(points) = 0)::INT, refused + (action = 'save' AND len(points) < 4)::INT
  FROM r JOIN l ON l.session = r.session AND l.i = r.i + 1)
SELECT session, i AS actions, coalesce(array_to_string(points, ' '), '') AS points, saved, ignored, idle, refused FROM r WHERE (session, i) IN (SELECT session, max(i) FROM l GROUP BY session)""")
def point_log(spark, d):
    """The pitch corners that every session's clicks, undos, resets and saves leave."""
    found = clicks.point_stacks(click_log(spark, d), "session", "seq")
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["x"].cast("int").cast("string"), F.lit(":"), p["y"].cast("int").cast("string"))), " ")
    return found.select("session", "actions", text("points").alias("points"), text("saved").alias("saved"), "ignored", "idle", "refused")
