"""Queries over annotation logs and the remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.operators import annotations as N
from matchgrid.operators import ingest, models, pairs
from matchgrid.operators.ranges import numbered
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A


@query("a05_json_scan", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_scan(spark, d):
    return A.scan(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("k01_edit_log_counts", 'SELECT action, "group", count(*) AS n, count(DISTINCT frame) AS frames FROM edits GROUP BY ALL', "edits")
def edit_log_counts(spark, d):
    return A.edits(spark, d).groupBy("action", "group").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("frames"))


@query("k02_frame_reset", """
SELECT frame, count(*) AS n FROM (SELECT frame FROM det WHERE frame % 10 <> 3 UNION ALL SELECT frame FROM edits WHERE action = 'add' AND frame % 10 = 3) GROUP BY frame""", "det", "edits")
def frame_reset(spark, d):
    reset = A.detections(spark, d).select("frame").distinct().filter("frame % 10 = 3")
    kept = A.detections(spark, d).join(reset, "frame", "left_anti").select("frame")
    new = A.edits(spark, d).filter("action = 'add' and frame % 10 = 3").select("frame")
    return kept.unionByName(new).groupBy("frame").agg(F.count("*").alias("n"))


@query("k03_identity_edits", """
SELECT t.player_id AS tid, t.frame, coalesce(max(c.cut), 0) AS cut FROM track t LEFT JOIN (SELECT tid, frame AS cut FROM overrides WHERE frame % 11 = 0) c ON c.tid = t.player_id AND c.cut <= t.frame GROUP BY t.player_id, t.frame""", "track", "overrides")
def identity_edits(spark, d):
    cuts = A.overrides(spark, d).filter("frame % 11 = 0").groupBy("tid").agg(F.collect_set("frame").alias("fs"))
    entry = F.map_from_entries(F.collect_list(F.struct(F.col("tid").cast("string"), "fs")))
    document = cuts.agg(F.to_json(F.struct(entry.alias("cuts"))).alias("doc"))
    tables = N.edit_tables(document, "doc")
    rows = A.tracks(spark, d).select(F.col("player_id").alias("tid"), "frame")
    return N.sub_ids(rows, tables["cuts"])


def identity_documents(spark, d):
    """A log of small identity documents (seq, doc): cuts and merges from overrides, names from suppliers, geometry from moves."""
    text = lambda c: F.col(c).cast("string")
    doc = lambda name, key, value: F.to_json(F.struct(F.map_from_arrays(F.array(key), F.array(value)).alias(name)))
    o = A.overrides(spark, d).filter("frame % 11 = 0")
    cuts = o.select("seq", doc("cuts", text("tid"), F.array("frame")).alias("doc"))
    pair = F.array(F.array(F.array("tid", "frame"), F.array((F.col("tid") * 7) % 25, F.lit(0))))
    merges = o.filter("seq % 40 = 1").select("seq", F.to_json(F.struct(pair.alias("merges"))).alias("doc"))
    names = A.base_names(spark, d).select("seq", doc("names", F.concat(text("tid"), F.lit("_0")), F.col("name")).alias("doc"))
    moved = A.edits(spark, d).filter("action = 'move'").groupBy("frame", "box_key").agg(F.max_by(F.struct("seq", "x1", "y1", "x2", "y2"), "seq").alias("e"))
    geom = moved.select("e.seq", doc("geom", F.concat(text("frame"), F.lit("_"), text("box_key")), F.array("e.x1", "e.y1", "e.x2", "e.y2")).alias("doc"))
    return cuts.unionByName(merges).unionByName(names).unionByName(geom)


@query("k03_identity_document", """
WITH RECURSIVE cuts AS (SELECT DISTINCT tid, frame AS cut FROM overrides WHERE frame % 11 = 0),
m AS (SELECT tid::BIGINT * 2147483648 + frame AS a, ((tid * 7) % 25)::BIGINT * 2147483648 AS b FROM overrides WHERE frame % 11 = 0 AND seq % 40 = 1),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
reach AS (SELECT a AS v, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v),
root AS (SELECT v, min(r) AS root FROM reach GROUP BY v),
g AS (SELECT frame, box_key, arg_max(x1, seq) AS x1, arg_max(y2, seq) AS y2 FROM edits WHERE action = 'move' GROUP BY ALL),
b AS (SELECT t.frame, t.player_id AS tid, coalesce(g.x1, t.x1) AS x1, coalesce(g.y2, t.y2) AS y2, coalesce((SELECT max(cut) FROM cuts c WHERE c.tid = t.player_id AND c.cut <= t.frame), 0) AS cut
  FROM track t LEFT JOIN g ON g.frame = t.frame AND g.box_key = t.player_id),
n AS (SELECT b.*, coalesce(root, tid::BIGINT * 2147483648 + cut) AS root FROM b LEFT JOIN root ON v = tid::BIGINT * 2147483648 + cut),
num AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, min(frame), root) AS player_id FROM n GROUP BY root),
nm AS (SELECT coalesce(root, tid::BIGINT * 2147483648) AS root, arg_min(name, seq) AS name FROM base LEFT JOIN root ON v = tid::BIGINT * 2147483648 GROUP BY ALL)
SELECT frame, tid, cut, player_id, coalesce(name, '') AS name, x1, y2 FROM n JOIN num USING (root) LEFT JOIN nm USING (root)""", "track", "overrides", "edits", "base")
def identity_document(spark, d):
    """Tracks after cuts, merges, names and moved boxes of the whole document."""
    tables = N.edit_tables(identity_documents(spark, d), "doc", "seq")
    rows = A.tracks(spark, d).select("frame", F.col("player_id").alias("tid"), "x1", "y1", "x2", "y2")
    return N.identified(rows, tables).select("frame", "tid", "cut", "player_id", "name", "x1", "y2")


@query("k05_roster_rename", "SELECT tid, CASE WHEN name = (SELECT min(name) FROM base) THEN 'G01' ELSE name END AS name FROM base", "base")
def roster_rename(spark, d):
    names = A.base_names(spark, d)
    return N.renamed(names, names.agg(F.min("name")).first()[0], "G01").select("tid", "name")


@query("k05_roster_cascade", """
WITH seed AS (SELECT t || i AS name, t AS team FROM (VALUES ('G'), ('B')) a(t), range(1, 12) b(i)),
old AS (SELECT DISTINCT name, 'A' AS team FROM base), roster AS (SELECT * FROM old UNION ALL SELECT * FROM seed WHERE name NOT IN (SELECT name FROM old)),
ren AS (SELECT seq, name AS old, CASE WHEN seq % 5 = 0 THEN 'G' || (seq % 11 + 1) ELSE 'N' || (seq % 40) END AS new FROM base WHERE seq % 2 = 0),
ok AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY seq) AS a FROM ren WHERE old <> new AND new NOT IN (SELECT name FROM roster) AND old IN (SELECT name FROM roster)),
g AS (SELECT old, new FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY seq) AS b FROM ok WHERE a = 1) WHERE b = 1)
SELECT 'roster' AS kind, coalesce(new, name) AS name, count(*) AS n FROM roster LEFT JOIN g ON old = name GROUP BY ALL
UNION ALL SELECT 'base', coalesce(new, name), count(*) FROM base LEFT JOIN g ON old = name GROUP BY ALL
UNION ALL SELECT 'overrides', coalesce(new, name), count(*) FROM (SELECT b.name FROM overrides o JOIN base b ON b.seq = o.seq % 100) LEFT JOIN g ON old = name GROUP BY ALL""", "base", "overrides")
def roster_cascade(spark, d):
    """A seeded roster and its renames, carried on to base names and overrides; a name that is taken is refused."""
    base = A.base_names(spark, d)
    team = F.explode(F.array(F.lit("G"), F.lit("B")))
    seed = spark.range(1, 12).select("id", team.alias("team")).select("id", F.concat("team", F.col("id").cast("string")).alias("name"), "team")
    roster = N.roster_added(base.select("name", F.lit("A").alias("team")).distinct(), seed, "id")
    seq = F.col("seq")
    new = F.when(seq % 5 == 0, F.concat(F.lit("G"), (seq % 11 + 1).cast("string"))).otherwise(F.concat(F.lit("N"), (seq % 40).cast("string")))
    renames = N.granted(roster, base.filter("seq % 2 = 0").select("seq", F.col("name").alias("old"), new.alias("new")), "seq")
    given = A.overrides(spark, d).select((seq % 100).alias("seq")).join(base.select("seq", "name"), "seq")
    tables = {"roster": roster, "base": base, "overrides": given}
    parts = [N.cascaded(t, renames).groupBy(F.lit(k).alias("kind"), "name").agg(F.count("*").alias("n")) for k, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k06_assignments", """
WITH l AS (SELECT seq, tid, name, frame, CASE seq % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'unassign' ELSE 'override' END AS kind FROM overrides),
r AS (SELECT tid, max(seq) AS s FROM l WHERE kind <> 'override' GROUP BY tid)
SELECT l.tid, l.name, l.kind, CASE WHEN kind = 'base' THEN -1 ELSE frame END AS frame FROM l LEFT JOIN r USING (tid)
WHERE (kind = 'base' AND seq = s) OR (kind = 'override' AND seq > coalesce(s, -1))""", "overrides")
def assignments(spark, d):
    k = F.col("seq") % 4
    return N.assigned(A.overrides(spark, d).withColumn("kind", F.when(k == 0, "base").when(k == 1, "unassign").otherwise("override")))


@query("k07_forward_swap", """
SELECT CASE tid WHEN 1 THEN 2 ELSE 1 END AS tid, 100 AS frame, name, (1000 + (tid = 2)::INT)::BIGINT AS seq FROM (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) WHERE tid IN (1, 2)""", "base")
def forward_swap(spark, d):
    return N.swapped_from(ingest.first_wins(A.base_names(spark, d), ["tid"], ["seq"]), 1, 2, 100, 1000)


@query("k09_keyframe_upsert", """
WITH c AS (SELECT frame, seq, x1, y1, seq % 3 = 0 AS cleared, row_number() OVER (PARTITION BY frame ORDER BY seq DESC) AS r FROM edits WHERE action = 'add')
SELECT frame, image_x, image_y FROM keyframes WHERE frame NOT IN (SELECT frame FROM c) UNION ALL SELECT frame, x1, y1 FROM c WHERE r = 1 AND NOT cleared""", "keyframes", "edits")
def keyframe_upsert(spark, d):
    changes = A.edits(spark, d).filter("action = 'add'").select("frame", "seq", F.col("x1").alias("image_x"), F.col("y1").alias("image_y"), (F.col("seq") % 3 == 0).alias("cleared"))
    return N.upserted(A.keyframes(spark, d).select("frame", "image_x", "image_y"), changes, "frame", "seq")


@query("k11_trim_range", "SELECT frame, count(*) AS n FROM det WHERE frame BETWEEN 30 AND 90 GROUP BY frame", "det")
def trim_range(spark, d):
    return N.trimmed(A.detections(spark, d), "frame", 90, 30).groupBy("frame").agg(F.count("*").alias("n"))


@query("p26_candidate_score", """
SELECT event_id, round(foot_x / 100 + 0.35 * foot_y / 100 + 0.04 * (frame % 72 + 1) + 0.18 * confidence, 6) AS score, round(foot_y / 100 / greatest((frame % 72 + 1) / 24.0::DOUBLE, 1 / 24.0::DOUBLE), 6) AS speed FROM det""", "det")
def candidate_score(spark, d):
    gap, end = F.col("frame") % 72 + 1, F.col("foot_y") / 100
    return A.detections(spark, d).select("event_id", F.round(N.candidate_score(F.col("foot_x") / 100, end, gap, F.col("confidence")), 6).alias("score"), F.round(N.required_speed(end, gap, 24.0), 6).alias("speed"))


@query("t03_limit_rows", "SELECT event_id FROM det ORDER BY event_id LIMIT 30", "det")
def limit_rows(spark, d):
    return A.detections(spark, d).orderBy("event_id").limit(30).select("event_id")


@query("t07_column_sort", "SELECT unit::BIGINT AS unit, row_number() OVER (ORDER BY n DESC, unit)::BIGINT AS place FROM (SELECT player_id AS unit, count(*) AS n FROM track GROUP BY player_id)", "track")
def column_sort(spark, d):
    counts = A.tracks(spark, d).groupBy(F.col("player_id").cast("long").alias("unit")).agg(F.count("*").alias("n"))
    return numbered(counts, [F.desc("n"), "unit"], "place").select("unit", "place")


@query("t10_value_sort", "SELECT player_id, round(avg(confidence), 6) AS mean FROM det GROUP BY player_id ORDER BY mean DESC, player_id", "det")
def value_sort(spark, d):
    return A.detections(spark, d).groupBy("player_id").agg(F.round(F.avg("confidence"), 6).alias("mean")).orderBy(F.desc("mean"), "player_id")


@query("f07_json_fallback", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'uncertain' ELSE 'k' || json_extract_string(props, '$.k') END AS answer, substr(CASE WHEN event_id % 4 = 3 THEN 'no json ' || event_id ELSE '' END, 1, 12) AS note FROM events""")
def json_fallback(spark, d):
    text = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("no json "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    k = F.get_json_object(text, "$.k")
    return A.scan(spark, d, "events").select("event_id", F.coalesce(F.concat(F.lit("k"), k), F.lit("uncertain")).alias("answer"), F.when(k.isNull(), F.substr(text, F.lit(1), F.lit(12))).otherwise("").alias("note"))


@query("f09_math", "SELECT event_id, round(sqrt(x1 * x1 + y1 * y1), 4) AS h, abs(x1 - 960) AS a, (event_id // 7)::BIGINT AS q, event_id % 7 AS m, trunc(x1 / 7)::INT AS t FROM det", "det")
def math(spark, d):
    return A.detections(spark, d).select("event_id", F.round(F.hypot("x1", "y1"), 4).alias("h"), F.abs(F.col("x1") - 960).alias("a"), F.floor(F.col("event_id") / 7).alias("q"), (F.col("event_id") % 7).alias("m"), (F.col("x1") / 7).cast("int").alias("t"))


@query("f15_type_guards", "SELECT event_id, TRY_CAST(v AS DOUBLE) AS d, regexp_matches(v, '^[0-9]+$') AS digits FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_id::VARCHAR ELSE event_id || '.5' END AS v FROM events)")
def type_guards(spark, d):
    s = F.col("event_id").cast("string")
    v = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, s).otherwise(F.concat(s, F.lit(".5")))
    return A.scan(spark, d, "events").select("event_id", v.try_cast("double").alias("d"), v.rlike("^[0-9]+$").alias("digits"))


@query("g23_threshold_fusion")
def threshold_fusion(spark, d):
    rows = A.pixels(spark, d).select(models.share_of("px", models.green_dominant).alias("v"))
    centres = models.two_means(rows, "v")
    split = models.otsu(rows, "v").first()
    fused = models.fused_threshold(sum(centres) / 2, split.threshold) if centres and split and split.threshold is not None else None
    return spark.range(1).select(F.lit(fused).cast("double").alias("threshold"))


@query("z04_region_areas", """
WITH n AS (SELECT frame, px, py, arg_min(team, struct_pack(d := (px * 5 - x_pitch) * (px * 5 - x_pitch) + (py * 4 - y_pitch) * (py * 4 - y_pitch), i := detection_id)) AS team
  FROM pos, range(22) a(px), range(18) b(py) WHERE in_pitch <> 0 GROUP BY frame, px, py)
SELECT frame, team, count(*) AS cells FROM n GROUP BY ALL""", "pos")
def region_areas(spark, d):
    """Cells of each team's regions in every frame: the area over time."""
    sites = A.positions(spark, d).filter("in_pitch <> 0").withColumn("who", F.struct("detection_id", "team"))
    cells = pairs.nearest_site(sites, "who", 22, 18, 5.0, 4.0)
    return cells.groupBy("frame", "site.team").agg(F.count("*").alias("cells"))


@query("z06_visible_angle", """
SELECT event_id, round(abs(degrees(atan2(37.66 - y_pitch, 105 - x_pitch) - atan2(30.34 - y_pitch, 105 - x_pitch))), 4) AS angle FROM track""", "track")
def visible_angle(spark, d):
    return A.tracks(spark, d).select("event_id", F.round(N.visible_angle(F.col("x_pitch"), F.col("y_pitch"), 105.0, 30.34, 37.66), 4).alias("angle"))


@query("a01_csv_scan", "SELECT event_id, frame, x1, confidence, team_hint FROM det", "det")
def csv_scan(spark, d):
    """Rows written as CSV text and parsed with a declared schema; a blank cell is null."""
    rows = A.detections(spark, d).select("event_id", "frame", "x1", "confidence", "team_hint")
    text = rows.select(F.to_csv(F.struct(*rows.columns)).alias("line"))
    parsed = text.select(F.from_csv("line", "event_id long, frame int, x1 double, confidence double, team_hint string").alias("r")).select("r.*")
    return parsed.withColumn("team_hint", F.coalesce("team_hint", F.lit("")))


@query("b04_prompt_lines", """
SELECT player_id, '{"rank":' || player_id || ',"metrics":{"n":' || count(*) || ',"last":' || max(frame) || '}}' AS line FROM track GROUP BY player_id""", "track")
def prompt_lines(spark, d):
    counts = A.tracks(spark, d).groupBy("player_id").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
    return counts.select("player_id", F.to_json(F.struct(F.col("player_id").alias("rank"), F.struct("n", "last").alias("metrics"))).alias("line"))


@query("b10_movement_bars", "SELECT player_id, count(*) AS n FROM track GROUP BY player_id HAVING count(*) >= 10 ORDER BY n DESC, player_id LIMIT 12", "track")
def movement_bars(spark, d):
    counts = A.tracks(spark, d).groupBy("player_id").agg(F.count("*").alias("n")).filter("n >= 10")
    return counts.orderBy(F.desc("n"), "player_id").limit(12)


@query("p30_lerp", "SELECT event_id, round(x1 + (x2 - x1) * ((event_id % 8) / 8.0::DOUBLE), 6) AS x FROM det", "det")
def lerp(spark, d):
    from matchgrid.functions import geometry as G

    return A.detections(spark, d).select("event_id", F.round(G.lerp(F.col("x1"), F.col("x2"), F.col("event_id") % 8 / 8.0), 6).alias("x"))


@query("f05_key_values", "SELECT event_id, split_part(s, '=', 1) AS k, split_part(s, '=', 2) AS v FROM (SELECT event_id, event_type || '=' || user_id AS s FROM events)")
def key_values(spark, d):
    s = F.concat("event_type", F.lit("="), F.col("user_id").cast("string"))
    return A.scan(spark, d, "events").select("event_id", F.split_part(s, F.lit("="), F.lit(1)).alias("k"), F.split_part(s, F.lit("="), F.lit(2)).alias("v"))


@query("f13_counter", """
SELECT frame, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS top, max(n) AS n FROM (SELECT event_id // 20 AS frame, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY frame""")
def counter(spark, d):
    counts = A.scan(spark, d, "events").groupBy(F.expr("event_id div 20").alias("frame"), "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("frame").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("top"), F.max("n").alias("n"))


@query("f16_optional_column", "SELECT count(*) AS n FROM det", "det")
def optional_column(spark, d):
    """Without an in_pitch column every row counts."""
    return ingest.analysed(A.detections(spark, d)).agg(F.count("*").alias("n"))


@query("k12_learned_threshold", """
WITH v AS (SELECT q[3] AS v, team = 1 AS p FROM features),
t AS (SELECT (lag(v) OVER (ORDER BY v) + v) / 2.0::DOUBLE AS th FROM (SELECT DISTINCT v FROM v) UNION ALL SELECT min(v) - 1e-6::DOUBLE FROM v UNION ALL SELECT max(v) + 1e-6::DOUBLE FROM v),
f AS (SELECT th, high, count(*) FILTER ((v >= th) = (p = (high = 1))) AS ok, count(*) AS n FROM v, t, (VALUES (1), (0)) d(high) WHERE th IS NOT NULL GROUP BY th, high)
SELECT th AS threshold, high AS high_is_positive, round(ok / n, 6) AS accuracy FROM f ORDER BY ok DESC, high DESC, th LIMIT 1""", "features")
def learned_threshold(spark, d):
    """Learns from annotated rows only, and only with enough of both teams."""
    rows = A.features(spark, d).select(F.get("q", F.lit(2)).alias("v"), "team")
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("team").alias("t")).first()
    return models.accuracy_threshold(rows if n.n >= 12 and n.t == 2 else rows.limit(0), "v", F.col("team") == 1)
