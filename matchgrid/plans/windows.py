"""Queries over windows and ordered sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.operators import analytics as N
from matchgrid.operators import identity, pairs
from matchgrid.operators import series as S
from matchgrid.operators.ranges import numbered
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A


@query("w01_steps", """
SELECT event_id, round(sqrt((x_pitch - px) * (x_pitch - px) + (y_pitch - py) * (y_pitch - py)) * 1000)::BIGINT AS step_mm, time - pt AS dt
FROM (SELECT *, lag(x_pitch) OVER w AS px, lag(y_pitch) OVER w AS py, lag(time) OVER w AS pt FROM track WINDOW w AS (PARTITION BY player_id ORDER BY time, frame))""", "track")
def steps(spark, d):
    return N.steps(A.tracks(spark, d)).select("event_id", "step_mm", "dt")


@query("w02_dense_relabel", """
SELECT player_id, row_number() OVER (ORDER BY n DESC, first)::BIGINT AS new_id FROM (SELECT player_id, count(*) AS n, min(event_id) AS first FROM det GROUP BY player_id)""", "det")
def dense_relabel(spark, d):
    return identity.relabel(A.detections(spark, d), "player_id", "event_id")


@query("w03_candidate_rank", """
SELECT event_id, row_number() OVER (ORDER BY confidence DESC, event_id)::BIGINT AS rank FROM (SELECT * FROM det ORDER BY confidence DESC, event_id LIMIT 100)""", "det")
def candidate_rank(spark, d):
    top = A.detections(spark, d).orderBy(F.desc("confidence"), "event_id").limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("confidence"), "event_id")).cast("long").alias("rank"))


@query("w04_ema", """
WITH RECURSIVE o AS (SELECT player_id, frame, x_pitch AS x, row_number() OVER (PARTITION BY player_id ORDER BY frame) AS i FROM track),
e AS (SELECT player_id, frame, x, i FROM o WHERE i = 1 UNION ALL SELECT o.player_id, o.frame, 0.5 * o.x + 0.5 * e.x, o.i FROM e JOIN o ON o.player_id = e.player_id AND o.i = e.i + 1)
SELECT player_id, frame, round(x, 7) AS x FROM e""", "track")
def ema(spark, d):
    return S.ema(A.tracks(spark, d), "x_pitch").select("player_id", "frame", F.round("x_pitch", 7).alias("x"))


@query("w05_gap_fill", """
WITH n AS (SELECT player_id, frame, x_pitch AS x, lead(frame) OVER w AS f2, lead(x_pitch) OVER w AS x2 FROM track WINDOW w AS (PARTITION BY player_id ORDER BY frame))
SELECT player_id, frame, round(x, 5) AS x, false AS is_filled FROM n
UNION ALL SELECT player_id, frame + k, round(x + (x2 - x) * (k / (f2 - frame)::DOUBLE), 5), true FROM n, (VALUES (1), (2), (3), (4)) t(k) WHERE f2 - frame BETWEEN 2 AND 5 AND k < f2 - frame""", "track")
def gap_fill(spark, d):
    return S.fill_gaps(A.tracks(spark, d), ["x_pitch"]).select("player_id", "frame", F.round("x_pitch", 5).alias("x"), "is_filled")


@query("w06_moving_average", """
SELECT event_id, round(avg(CASE WHEN event_id % 7 <> 0 THEN foot_x END) OVER (PARTITION BY player_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS x FROM track""", "track")
def moving_average(spark, d):
    rows = A.tracks(spark, d).select("event_id", "player_id", "frame", F.when(F.col("event_id") % 7 != 0, F.col("foot_x")).alias("x"))
    return S.moving_average(rows, "player_id", "x").select("event_id", F.round("x", 4).alias("x"))


@query("w07_majority_vote", """
SELECT event_id, 2 * sum((confidence > 0.5)::INT) OVER w > count(*) OVER w AS vote FROM track WINDOW w AS (PARTITION BY player_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", "track")
def majority_vote(spark, d):
    return S.majority_vote(A.tracks(spark, d), "player_id", F.col("confidence") > 0.5).select("event_id", "vote")


@query("w08_islands", """
SELECT player_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT player_id, frame, frame - row_number() OVER (PARTITION BY player_id ORDER BY frame) AS run FROM track) GROUP BY player_id, run""", "track")
def islands(spark, d):
    return S.islands(A.tracks(spark, d), "player_id")


@query("w10_edge_velocity", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY frame) AS a, row_number() OVER (PARTITION BY player_id ORDER BY frame DESC) AS z FROM track)
SELECT player_id, round((arg_max(x_pitch, frame) FILTER (a <= 8) - arg_min(x_pitch, frame) FILTER (a <= 8)) / greatest(1, max(frame) FILTER (a <= 8) - min(frame) FILTER (a <= 8)), 4) AS vx0,
       round((arg_max(y_pitch, frame) FILTER (z <= 8) - arg_min(y_pitch, frame) FILTER (z <= 8)) / greatest(1, max(frame) FILTER (z <= 8) - min(frame) FILTER (z <= 8)), 4) AS vy1 FROM r GROUP BY player_id""", "track")
def edge_velocity(spark, d):
    return S.edge_velocity(A.tracks(spark, d), "player_id").select("player_id", F.round("vx0", 4).alias("vx0"), F.round("vy1", 4).alias("vy1"))


@query("w11_extrapolation", """
SELECT event_id, round(x_pitch + (x_pitch - px) / greatest(1, frame - pf) * 2, 7) AS x FROM (SELECT *, lag(x_pitch) OVER w AS px, lag(frame) OVER w AS pf FROM track WINDOW w AS (PARTITION BY player_id ORDER BY frame))""", "track")
def extrapolation(spark, d):
    w = Window.partitionBy("player_id").orderBy("frame")
    speed = (F.col("x_pitch") - F.lag("x_pitch").over(w)) / F.greatest(F.lit(1), F.col("frame") - F.lag("frame").over(w))
    return A.tracks(spark, d).select("event_id", F.round(F.col("x_pitch") + speed * 2, 7).alias("x"))


@query("w12_count_changes", "SELECT frame, n, n - lag(n) OVER (ORDER BY frame) AS change FROM (SELECT frame, count(*) AS n FROM track GROUP BY frame)", "track")
def count_changes(spark, d):
    return S.count_changes(A.tracks(spark, d))


@query("w13_frame_problems", """
WITH f AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS before FROM (SELECT DISTINCT frame FROM det)),
i AS (SELECT frame, player_id, count(*) AS n, min(foot_x) AS x, min(foot_y) AS y FROM det GROUP BY ALL),
nw AS (SELECT i.frame FROM i JOIN f USING (frame) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i o WHERE o.frame = before AND o.player_id = i.player_id)),
gn AS (SELECT f.frame FROM f JOIN i o ON o.frame = f.before WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.frame = f.frame AND i.player_id = o.player_id))
SELECT * FROM (SELECT DISTINCT frame, 'duplicate' AS problem FROM i WHERE n > 1
UNION ALL SELECT frame, 'count' FROM det GROUP BY frame HAVING count(*) <> 20
UNION ALL SELECT DISTINCT i.frame, 'warp' FROM i JOIN f USING (frame) JOIN i o ON o.frame = before AND o.player_id = i.player_id WHERE (i.x - o.x) * (i.x - o.x) + (i.y - o.y) * (i.y - o.y) > 16900
UNION ALL SELECT frame, 'swap' FROM (SELECT frame FROM nw INTERSECT SELECT frame FROM gn)) WHERE frame NOT IN (SELECT frame FROM edits WHERE seq % 50 = 0)""", "det", "edits")
def frame_problems(spark, d):
    return S.frame_problems(A.detections(spark, d), 20, 130.0, A.edits(spark, d).filter("seq % 50 = 0"))


@query("w14_last_seen", """
SELECT player_id, t, coalesce((SELECT max(frame) FROM track x WHERE x.player_id = p.player_id AND x.frame <= t), -1) AS last FROM (SELECT DISTINCT player_id FROM track) p, (VALUES (0), (25), (60)) q(t)""", "track")
def last_seen(spark, d):
    rows = A.tracks(spark, d)
    seen = rows.groupBy("player_id").agg(*(F.coalesce(F.max(F.when(F.col("frame") <= t, F.col("frame"))), F.lit(-1)).alias(f"t{t}") for t in (0, 25, 60)))
    return seen.select("player_id", F.inline(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"t{t}").alias("last")) for t in (0, 25, 60)))))


@query("w15_systematic_sample", """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY player_id) // 8) AS k FROM det) WHERE i % k = 0 AND i // k < 8""", "det")
def systematic_sample(spark, d):
    return S.systematic(A.detections(spark, d), "player_id", "event_id", 8).select("event_id")


@query("g10_sampled_mean", """
SELECT player_id, round(avg(confidence), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY player_id) // 8) AS k FROM det) WHERE i % k = 0 AND i // k < 8 GROUP BY player_id""", "det")
def sampled_mean(spark, d):
    return S.systematic(A.detections(spark, d), "player_id", "event_id", 8).groupBy("player_id").agg(F.round(F.avg("confidence"), 6).alias("mean"))


@query("w16_track_starts", "SELECT event_id FROM track t WHERE NOT EXISTS (SELECT 1 FROM track p WHERE p.player_id = t.player_id AND p.frame = t.frame - 1)", "track")
def track_starts(spark, d):
    return pairs.starts(A.tracks(spark, d)).select("event_id")


@query("w17_negative_keys", """
SELECT frame, event_id, (-1 - row_number() OVER (PARTITION BY frame ORDER BY event_id))::BIGINT AS box_key FROM det WHERE confidence < 0.2""", "det")
def negative_keys(spark, d):
    rows = A.detections(spark, d).filter("confidence < 0.2")
    return identity.negative_keys(rows, F.lit(-1), "frame", "event_id").select("frame", "event_id", "box_key")


@query("w18_stable_ids", """
WITH s AS (SELECT player_id, count(*) AS n, min(event_id) AS first FROM det GROUP BY player_id), old AS (SELECT player_id, player_id + 100 AS id FROM s WHERE player_id % 3 = 0)
SELECT player_id, id::BIGINT AS id FROM old UNION ALL
SELECT player_id, ((SELECT max(id) FROM old) + row_number() OVER (ORDER BY n DESC, first))::BIGINT FROM s WHERE player_id % 3 <> 0""", "det")
def stable_ids(spark, d):
    rows = A.detections(spark, d)
    old = rows.filter("player_id % 3 = 0").select("player_id", (F.col("player_id") + 100).cast("long").alias("id")).distinct()
    return identity.stable_ids(rows, old, "player_id", "event_id")


@query("w19_tail_split", """
SELECT frame, CASE WHEN row_number() OVER (ORDER BY frame) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.18)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT frame FROM det)""", "det")
def tail_split(spark, d):
    return S.tail_split(A.detections(spark, d).select("frame").distinct(), "frame")


@query("w20_next_keyframe", """
SELECT f AS frame, (SELECT max(frame) FROM keyframes WHERE frame < f) AS prev, (SELECT min(frame) FROM keyframes WHERE frame > f) AS next FROM (VALUES (5), (100), (777), (1990)) t(f)""", "keyframes")
def next_keyframe(spark, d):
    k = A.keyframes(spark, d).select("frame")
    at = (5, 100, 777, 1990)
    row = k.agg(*(F.struct(F.lit(t).alias("frame"), F.max(F.when(F.col("frame") < t, F.col("frame"))).alias("prev"), F.min(F.when(F.col("frame") > t, F.col("frame"))).alias("next")).alias(f"a{t}") for t in at))
    return row.select(F.inline(F.array(*(f"a{t}" for t in at))))


@query("t06_top_eleven", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, detection_id) <= 11 THEN 'A' ELSE 'B' END AS team FROM (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM det) WHERE n = 20""", "det")
def top_eleven(spark, d):
    return identity.split_teams(A.detections(spark, d), 20, 11).select("event_id", "team")


@query("t08_roster_order", """
SELECT player_id, row_number() OVER (ORDER BY visible, last DESC, player_id)::BIGINT AS place FROM (SELECT player_id, (max((frame = 90)::INT)) AS visible, max(frame) AS last FROM track WHERE frame <= 90 GROUP BY player_id)""", "track")
def roster_order(spark, d):
    seen = A.tracks(spark, d).filter("frame <= 90").groupBy("player_id").agg(F.max((F.col("frame") == 90).cast("int")).alias("visible"), F.max("frame").alias("last"))
    return numbered(seen, ["visible", F.desc("last"), "player_id"], "place").select("player_id", "place")


@query("t09_first_unanswered", "SELECT min(conv_id) AS first FROM conversations WHERE conv_id % 5 > 1")
def first_unanswered(spark, d):
    return A.scan(spark, d, "conversations").filter("conv_id % 5 > 1").agg(F.min("conv_id").alias("first"))


@query("w20_frame_steps", """
WITH f AS (SELECT DISTINCT frame FROM det), p AS (SELECT frame FROM (SELECT frame, count(DISTINCT player_id) AS k, count(*) AS n FROM det GROUP BY frame) WHERE n - k >= 8)
SELECT frame, coalesce((SELECT max(frame) FROM p WHERE p.frame < f.frame), (SELECT max(frame) FROM p)) AS previous, coalesce((SELECT min(frame) FROM p WHERE p.frame > f.frame), (SELECT min(frame) FROM p)) AS next FROM f""", "det")
def frame_steps(spark, d):
    """From every frame the previous and the next one with eight or more doubled ids, round the end of the clip."""
    rows = A.detections(spark, d)
    bad = rows.groupBy("frame").agg(F.count_distinct("player_id").alias("k"), F.count("*").alias("n")).filter("n - k >= 8")
    return S.stepped(rows, bad)
