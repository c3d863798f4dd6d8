"""Queries over scans, projections, predicates, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.functions import text as X
from matchgrid.operators import ingest
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A


@query("a03_typed_scan", """
SELECT reason, count(*) AS n, sum(k)::BIGINT AS k FROM (
  SELECT TRY_CAST(v AS INT) AS k, CASE WHEN TRY_CAST(v AS INT) IS NULL THEN 'rejected' ELSE 'good' END AS reason
  FROM (SELECT CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'x1' ELSE json_extract_string(props, '$.k') END AS v FROM events))
GROUP BY reason""")
def typed_scan(spark, d):
    i = F.col("event_id")
    raw = A.scan(spark, d, "events").select(F.when(i % 11 == 0, "").when(i % 13 == 0, "x1").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    good, bad = ingest.typed(raw, {"k": "int"})
    both = good.select("k", F.lit("good").alias("reason")).unionByName(bad.select(F.lit(None).cast("int").alias("k"), F.lit("rejected").alias("reason")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("a07_parse_rate", """
SELECT rate, CASE WHEN num IS NULL THEN NULL WHEN den = 0 THEN 0.0::DOUBLE ELSE round(num / den, 4) END AS fps FROM (
  SELECT rate, TRY_CAST(split_part(rate, '/', 1) AS DOUBLE) AS num, coalesce(TRY_CAST(nullif(split_part(rate, '/', 2), '') AS DOUBLE), 1) AS den
  FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN (event_id % 60)::VARCHAR ELSE (event_id % 60000) || '/' || (event_id % 5) END AS rate FROM events))""")
def parse_rate(spark, d):
    i = F.col("event_id")
    rates = A.scan(spark, d, "events").select(F.when(i % 3 == 0, (i % 60).cast("string")).otherwise(F.concat_ws("/", (i % 60000).cast("string"), (i % 5).cast("string"))).alias("rate")).distinct()
    return rates.select("rate", F.round(X.rate(F.col("rate")), 4).alias("fps"))


@query("a09_frame_metadata", """
SELECT (row_number() OVER (ORDER BY filename) - 1)::BIGINT AS frame_idx, filename, round(105 + (row_number() OVER (ORDER BY filename) - 1) / 24.0::DOUBLE, 3) AS timestamp
FROM (SELECT DISTINCT printf('frame_%06d.jpg', frame + 1) AS filename FROM det)""", "det")
def frame_metadata(spark, d):
    names = A.detections(spark, d).select(X.frame_name(F.col("frame") + 1).alias("filename")).distinct()
    return ingest.frame_metadata(names, start=105.0, fps=24.0)


@query("a11_detector_json", """
WITH r AS (SELECT event_id, (event_id // 10) % 4 AS k, event_id % 50 AS a, event_id % 30 AS b FROM events),
box AS (
  SELECT event_id, CASE k WHEN 0 THEN ('0.' || (10 + a))::DOUBLE ELSE a::DOUBLE END AS x1, CASE k WHEN 0 THEN ('0.' || (10 + b))::DOUBLE ELSE b::DOUBLE END AS y1,
         CASE k WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 500 WHEN 2 THEN 2500 END AS x2, CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 400 WHEN 2 THEN 300 END AS y2,
         CASE k WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25 ELSE 1 END AS confidence FROM r WHERE k <> 3),
scaled AS (SELECT event_id, confidence, CASE WHEN x2 <= 1.5 THEN 1920 ELSE 1 END AS sx, CASE WHEN x2 <= 1.5 THEN 1080 ELSE 1 END AS sy, x1, y1, x2, y2 FROM box)
SELECT event_id, 0 AS pos, round(least(greatest(x1 * sx, 0), 1920), 3) AS x1, round(least(greatest(y1 * sy, 0), 1080), 3) AS y1,
       round(least(greatest(x2 * sx, 0), 1920), 3) AS x2, round(least(greatest(y2 * sy, 0), 1080), 3) AS y2, confidence FROM scaled""")
def detector_json(spark, d):
    found = ingest.detector_boxes(A.raw_json(spark, d), "response", 1920.0, 1080.0)
    return found.select("event_id", "pos", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")), "confidence")


@query("a12_mock_boxes", """
SELECT frame, i::INT AS detection_id, round(1920 * [0.18, 0.28, 0.38, 0.48, 0.58, 0.68, 0.78, 0.24, 0.42, 0.62, 0.76][i % 11 + 1] - 17.28, 3) AS x1,
       round(1080 * (CASE WHEN i < 11 THEN 0.38 ELSE 0.62 END + ((i % 11) % 3 - 1) * 0.035) - 59.4, 3) AS y1, round(1920 * [0.18, 0.28, 0.38, 0.48, 0.58, 0.68, 0.78, 0.24, 0.42, 0.62, 0.76][i % 11 + 1] + 17.28, 3) AS x2,
       round(1080 * (CASE WHEN i < 11 THEN 0.38 ELSE 0.62 END + ((i % 11) % 3 - 1) * 0.035), 3) AS y2, 0.5 AS confidence, CASE WHEN i < 11 THEN 'A' ELSE 'B' END AS team_hint FROM (SELECT DISTINCT frame FROM det), range(22) t(i)""", "det")
def mock_boxes(spark, d):
    boxes = ingest.mock_boxes(A.detections(spark, d).select("frame").distinct(), 1920.0, 1080.0)
    return boxes.select("frame", "detection_id", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")), "confidence", "team_hint")


@query("a21_data_url", "SELECT doc_id, md5('data:image/jpeg;base64,' || base64(encode(substr(text, 1, 50)))) AS url FROM documents")
def data_url(spark, d):
    return A.scan(spark, d, "documents").select("doc_id", F.md5(X.data_url(F.encode(F.substr("text", F.lit(1), F.lit(50)), "UTF-8"))).alias("url"))


@query("a22_effective_fps", """
SELECT round(CASE WHEN t2 > t1 THEN 1 / (t2 - t1) ELSE 2.0 END, 6) AS fps FROM (
  SELECT min(time) FILTER (rn = 1) AS t1, min(time) FILTER (rn = 2) AS t2 FROM (SELECT time, row_number() OVER (ORDER BY frame) AS rn FROM (SELECT DISTINCT frame, time FROM det)))""", "det")
def effective_fps(spark, d):
    times = A.detections(spark, d).select("frame", "time").distinct()
    return ingest.effective_fps(times, "frame", "time")


@query("b03_json_rows", """SELECT frame, player_id, '{"frame":' || frame || ',"player_id":' || player_id || ',"team":"' || team || '"}' AS line FROM track""", "track")
def json_rows(spark, d):
    return A.tracks(spark, d).select("frame", "player_id", F.to_json(F.struct("frame", "player_id", "team")).alias("line"))


@query("b14_yolo_labels", """
WITH c AS (SELECT frame, detection_id, least(x1, 1920)::BIGINT AS a, least(x2, 1920)::BIGINT AS b, y1::BIGINT AS c, y2::BIGINT AS e FROM det),
q AS (SELECT frame, detection_id, [(2000000 * (a + b) + 3840) // 7680, (2000000 * (c + e) + 2160) // 4320, (2000000 * (b - a) + 1920) // 3840, (2000000 * (e - c) + 1080) // 2160] AS q FROM c)
SELECT frame, count(*) AS n, md5(string_agg('0 ' || list_aggregate(list_transform(q, lambda v: printf('%d.%06d', v // 1000000, v % 1000000)), 'string_agg', ' '), chr(10) ORDER BY detection_id)) AS labels
FROM q GROUP BY frame""", "det")
def yolo_labels(spark, d):
    line = X.yolo_label(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 1920.0, 1080.0)
    rows = A.detections(spark, d).select("frame", F.struct("detection_id", line.alias("line")).alias("r"))
    each = rows.groupBy("frame").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("r")).alias("rs"))
    return each.select("frame", "n", F.md5(F.array_join(F.transform("rs", lambda r: r["line"]), "\n")).alias("labels"))


@query("p01_valid_boxes", "SELECT event_id FROM det WHERE confidence >= 0.3 AND x2 > x1 AND y2 > y1", "det")
def valid_boxes(spark, d):
    return ingest.valid_boxes(A.detections(spark, d), 0.3).select("event_id")


@query("p02_minimum_size", "SELECT event_id FROM det WHERE x2 - x1 >= 12 AND y2 - y1 >= 25", "det")
def minimum_size(spark, d):
    return ingest.large_enough(A.detections(spark, d), 12, 25).select("event_id")


@query("p03_default_team", "SELECT event_id, CASE WHEN trim(team_hint) = '' THEN CASE WHEN center_y < 840 THEN 'A' ELSE 'B' END ELSE trim(team_hint) END AS team FROM det", "det")
def default_team(spark, d):
    return ingest.default_team(A.detections(spark, d), middle=840.0).select("event_id", F.col("team_hint").alias("team"))


@query("p04_derived_geometry", "SELECT event_id, round((x1 + x2) / 2, 2) AS cx, round((y1 + y2) / 2, 2) AS cy, round(y2, 2) AS fy FROM det", "det")
def derived_geometry(spark, d):
    fx, fy = G.foot(F.col("x1"), F.col("x2"), F.col("y2"))
    return A.detections(spark, d).select("event_id", F.round(fx, 2).alias("cx"), F.round((F.col("y1") + F.col("y2")) / 2, 2).alias("cy"), F.round(fy, 2).alias("fy"))


@query("p05_homography", "SELECT event_id, x_pitch, y_pitch FROM pos", "pos")
def homography(spark, d):
    return A.positions(spark, d).select("event_id", "x_pitch", "y_pitch")


@query("p06_in_pitch", "SELECT in_pitch, count(*) AS n FROM pos GROUP BY in_pitch", "pos")
def in_pitch(spark, d):
    return A.positions(spark, d).groupBy("in_pitch").agg(F.count("*").alias("n"))


@query("p07_analysis_filter", "SELECT count(*) AS n FROM pos WHERE coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE in_pitch END, 1) <> 0", "pos")
def analysis_filter(spark, d):
    rows = A.positions(spark, d).withColumn("in_pitch", F.when(F.col("event_id") % 7 != 0, F.col("in_pitch")))
    return ingest.analysed(rows).agg(F.count("*").alias("n"))


@query("p08_strict_pitch", "SELECT event_id FROM pos WHERE x_pitch BETWEEN 0 AND 105 AND y_pitch BETWEEN 0 AND 68", "pos")
def strict_pitch(spark, d):
    return A.positions(spark, d).filter(G.in_pitch(F.col("x_pitch"), F.col("y_pitch"), 0.0) == 1).select("event_id")


@query("p09_frame_range", "SELECT event_id FROM det WHERE frame BETWEEN 20 AND 120", "det")
def frame_range(spark, d):
    return A.detections(spark, d).filter(F.col("frame").between(20, 120)).select("event_id")


@query("p10_skip_intervals", "SELECT frame, count(*) AS n FROM det WHERE NOT (frame BETWEEN 10 AND 30 OR frame BETWEEN 55 AND 55 OR frame BETWEEN 100 AND 180) GROUP BY frame", "det")
def skip_intervals(spark, d):
    return ingest.without_intervals(A.detections(spark, d), "frame", "10-30, 55,100-180").groupBy("frame").agg(F.count("*").alias("n"))


@query("p11_keyframes", "SELECT DISTINCT frame FROM det WHERE frame % 6 = 0", "det")
def keyframe_rows(spark, d):
    return A.detections(spark, d).filter(F.pmod("frame", F.lit(6)) == 0).select("frame").distinct()


@query("p12_rescale", "SELECT event_id, round(x1 * 1920 / 3840, 4) AS x, round(x1 * 3840 / 1920, 4) AS native FROM det", "det")
def rescale(spark, d):
    return A.detections(spark, d).select("event_id", F.round(G.rescaled(F.col("x1"), 3840.0), 4).alias("x"), F.round(G.rescaled(F.col("x1"), 3840.0, False), 4).alias("native"))


@query("p13_pitch_pixels", "SELECT event_id, (40 + trunc(x_pitch / 105 * 1050))::INT AS px, (40 + trunc(y_pitch / 68 * 680))::INT AS py FROM pos WHERE abs(x_pitch) < 100000", "pos")
def pitch_pixels(spark, d):
    rows = A.positions(spark, d).filter("abs(x_pitch) < 100000")
    return rows.select("event_id", G.to_pixel(F.col("x_pitch"), 105.0, 1050, 40).alias("px"), G.to_pixel(F.col("y_pitch"), 68.0, 680, 40).alias("py"))


@query("p14_clamp", "SELECT event_id, least(greatest(x_pitch, 0), 105) AS x FROM pos", "pos")
def clamp(spark, d):
    return A.positions(spark, d).select("event_id", G.clamp(F.col("x_pitch"), 0.0, 105.0).alias("x"))


@query("p15_team_groups", """
SELECT event_type, CASE upper(trim(event_type)) WHEN 'CLICK' THEN 3 WHEN 'GREEN' THEN 1 ELSE 3 END AS a,
       CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 ELSE 3 END AS b, CASE WHEN event_type = 'click' THEN 'A' WHEN event_type = 'view' THEN 'B' ELSE '?' END AS team
FROM (SELECT DISTINCT event_type FROM events)""")
def team_groups(spark, d):
    kinds = A.scan(spark, d, "events").select("event_type").distinct()
    hint = F.when(F.col("event_type") == "click", " green").when(F.col("event_type") == "view", "BLACK ").otherwise(F.col("event_type"))
    return kinds.select("event_type", X.group_of_hint(F.col("event_type")).alias("a"), X.group_of_hint(hint).alias("b"), X.team_of_group(X.group_of_hint(hint)).alias("team"))


@query("p16_swap_teams", "SELECT event_id, CASE WHEN frame BETWEEN 10 AND 50 THEN CASE team WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE team END ELSE team END AS team FROM pos", "pos")
def swap_teams(spark, d):
    return A.positions(spark, d).select("event_id", F.when(F.col("frame").between(10, 50), X.swapped(F.col("team"))).otherwise(F.col("team")).alias("team"))


@query("p17_ranking_gate", "SELECT player_id, n FROM (SELECT player_id, count(*) AS n, sum(x_pitch) AS s FROM track GROUP BY player_id) WHERE n >= 10 AND s > 0", "track")
def ranking_gate(spark, d):
    return A.tracks(spark, d).groupBy("player_id").agg(F.count("*").alias("n"), F.sum("x_pitch").alias("s")).filter("n >= 10 and s > 0").select("player_id", "n")


@query("p18_players_only", 'SELECT seq FROM edits WHERE "group" IN (1, 2) AND action <> \'delete\'', "edits")
def players_only(spark, d):
    return A.edits(spark, d).filter(F.col("group").isin(1, 2) & (F.col("action") != "delete")).select("seq")


@query("p20_first_wins", "SELECT tid, name FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY seq) AS rn FROM base) WHERE rn = 1", "base")
def first_wins(spark, d):
    return ingest.first_wins(A.base_names(spark, d), ["tid"], ["seq"]).select("tid", "name")


@query("p21_index_maths", """
SELECT frame, frame + 1 AS image_no, round(frame / 23.99::DOUBLE, 3) AS t, 6 * frame AS j, 12 * frame - 2520 AS moved, 12 * frame - 2520 >= 0 AND 12 * frame - 2520 < 2880 AS inside
FROM (SELECT DISTINCT frame FROM det)""", "det")
def index_maths(spark, d):
    f, moved = F.col("frame"), 12 * F.col("frame") - 2520
    return A.detections(spark, d).select("frame").distinct().select(
        "frame", (f + 1).alias("image_no"), F.round(f / 23.99, 3).alias("t"), (6 * f).alias("j"), moved.alias("moved"), ((moved >= 0) & (moved < 2880)).alias("inside"))


@query("p22_distance", "SELECT event_id, round(sqrt((foot_x - 960) * (foot_x - 960) + (foot_y - 540) * (foot_y - 540)), 4) AS d FROM det", "det")
def distances(spark, d):
    return A.detections(spark, d).select("event_id", F.round(G.distance(F.col("foot_x"), F.col("foot_y"), F.lit(960.0), F.lit(540.0)), 4).alias("d"))


@query("p24_size_score", """
SELECT event_id, round(CASE WHEN e <= 0 THEN 1 WHEN h / e < 0.8 THEN h / e / 0.8 WHEN h / e > 1.2 THEN 1.2 / (h / e) ELSE 1 END, 4) AS score
FROM (SELECT event_id, y2 - y1 AS h, 0.1404::DOUBLE * center_y - 90 AS e FROM det)""", "det")
def size_score(spark, d):
    score = G.size_score(F.col("y2") - F.col("y1"), F.col("center_y"), 0.1404, -90.0, 0.8, 1.2)
    return A.detections(spark, d).select("event_id", F.round(score, 4).alias("score"))


@query("p28_luminance", "SELECT DISTINCT r, g, bl AS b, CASE WHEN 0.299 * r + 0.587 * g + 0.114 * bl > 140 THEN 'black' ELSE 'white' END AS halo FROM px", "px")
def luminance(spark, d):
    rows = A.pixels(spark, d).select(F.inline("px")).distinct()
    return rows.withColumn("halo", X.halo(F.col("r"), F.col("g"), F.col("b")))


@query("p29_hit_test", """
SELECT frame, arg_min(detection_id, ((x2 - x1) * (y2 - y1)) * 100 + detection_id) AS detection_id FROM det WHERE 900 BETWEEN x1 - 400 AND x2 + 400 AND 850 BETWEEN y1 - 40 AND y2 + 40 GROUP BY frame""", "det")
def hit_test(spark, d):
    near = A.detections(spark, d).filter((F.col("x1") - 400 <= 900) & (F.col("x2") + 400 >= 900) & (F.col("y1") - 40 <= 850) & (F.col("y2") + 40 >= 850))
    return near.groupBy("frame").agg(F.min_by("detection_id", F.struct(G.area(), "detection_id")).alias("detection_id"))


@query("t01_numeric_sort", "SELECT event_id, frame, detection_id FROM det ORDER BY frame, detection_id", "det")
def numeric_sort(spark, d):
    """Text columns in the order of their numbers."""
    rows = A.detections(spark, d).select("event_id", F.col("frame").cast("string").alias("f"), F.col("detection_id").cast("string").alias("i"))
    return rows.orderBy(F.col("f").cast("int"), F.col("i").cast("int")).select("event_id", F.col("f").cast("int").alias("frame"), F.col("i").cast("int").alias("detection_id"))


@query("t02_head_limit", "SELECT event_id FROM det ORDER BY frame, detection_id LIMIT 50", "det")
def head_limit(spark, d):
    return A.detections(spark, d).orderBy("frame", "detection_id").select("event_id").limit(50)


@query("f01_frame_number", r"""
SELECT name, CASE WHEN regexp_matches(split_part(name, '_', 2), '^[0-9]+$') THEN split_part(name, '_', 2)::BIGINT ELSE 0 END AS frame
FROM (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN printf('frame_%06d', event_id) WHEN 1 THEN 'f_' || event_id || '_x' WHEN 2 THEN 'frame_x' || event_id ELSE 'plain' END AS name FROM events)""")
def frame_number(spark, d):
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.format_string("frame_%06d", i)).when(i % 4 == 1, F.concat(F.lit("f_"), i.cast("string"), F.lit("_x"))).when(i % 4 == 2, F.concat(F.lit("frame_x"), i.cast("string"))).otherwise("plain")
    return A.scan(spark, d, "events").select(name.alias("name")).distinct().select("name", X.frame_number(F.col("name")).alias("frame"))


@query("f02_padded_names", "SELECT frame, printf('frame_%06d.jpg', frame + 1) AS a, printf('f_%05d.jpg', frame) AS b FROM (SELECT DISTINCT frame FROM det)", "det")
def padded_names(spark, d):
    return A.detections(spark, d).select("frame").distinct().select("frame", X.frame_name(F.col("frame") + 1).alias("a"), F.format_string("f_%05d.jpg", "frame").alias("b"))


@query("f03_member_list", """
SELECT event_id, coalesce(list_sum(list_filter(list_transform(string_split(replace(s, ',', ' '), ' '), lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL)), 0)::BIGINT AS total
FROM (SELECT event_id, (event_id % 7) || ',' || (event_id % 5) || ' x ' || (event_id % 3) AS s FROM events)""")
def member_list(spark, d):
    i = F.col("event_id")
    s = F.concat((i % 7).cast("string"), F.lit(","), (i % 5).cast("string"), F.lit(" x "), (i % 3).cast("string"))
    return A.scan(spark, d, "events").select("event_id", F.aggregate(X.members(s), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("f04_decision", """
SELECT conv_id, turn, CASE WHEN w IN ('yes', 'y', 'same', 'merge', '1', 'true', 'ok') THEN 'yes' WHEN w IN ('no', 'n', 'different', '0', 'false') THEN 'no' ELSE 'uncertain' END AS decision
FROM (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'same' WHEN 2 THEN 'no' WHEN 3 THEN 'different' ELSE lower(trim(substr(text, 1, 3))) END AS w FROM conversations)""")
def decision(spark, d):
    k = F.col("conv_id") % 5
    said = F.when(k == 0, " YES").when(k == 1, "Same ").when(k == 2, "no").when(k == 3, "Different").otherwise(F.substr("text", F.lit(1), F.lit(3)))
    return A.scan(spark, d, "conversations").select("conv_id", "turn", X.decision(said).alias("decision"))


@query("f06_html_labels", """
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html FROM documents""")
def html_labels(spark, d):
    return A.scan(spark, d, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("html"))


@query("f08_prompt", r"""
SELECT conv_id, turn, md5(printf('Track %d, turn %d: %s', conv_id, turn, translate(text, chr(10) || chr(13), '  '))) AS prompt FROM conversations""")
def prompt(spark, d):
    return A.scan(spark, d, "conversations").select("conv_id", "turn", F.md5(F.format_string("Track %d, turn %d: %s", "conv_id", "turn", F.translate("text", "\n\r", "  "))).alias("prompt"))


@query("f11_arrays", """
SELECT vec_id, list_sum(q[1:8])::BIGINT AS head, list_sum(list_filter(q, lambda v, i: i % 4 = 1))::BIGINT AS strided, list_max(q) AS top, list_position(q, list_max(q)) - 1 AS argmax FROM features""", "features")
def arrays(spark, d):
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return A.features(spark, d).select("vec_id", total(F.slice("q", 1, 8)).alias("head"), total(F.filter("q", lambda v, i: i % 4 == 0)).alias("strided"),
                                       F.array_max("q").alias("top"), (F.array_position("q", F.array_max("q")) - 1).alias("argmax"))
