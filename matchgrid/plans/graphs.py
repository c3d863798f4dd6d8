"""Queries over set operations and merge graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.operators import identity
from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A

_REACH = """RECURSIVE both_ AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT u, u AS r FROM both_ UNION SELECT e.v, reach.r FROM reach JOIN both_ e ON e.u = reach.u),
comp AS (SELECT u AS v, min(r) AS root FROM reach GROUP BY u)"""


@query("u01_union", "SELECT source, count(*) AS n FROM (SELECT 'det' AS source FROM det UNION ALL SELECT 'edit' FROM edits WHERE action = 'add') GROUP BY source", "det", "edits")
def union(spark, d):
    added = A.edits(spark, d).filter("action = 'add'").select(F.lit("edit").alias("source"))
    return A.detections(spark, d).select(F.lit("det").alias("source")).unionByName(added).groupBy("source").agg(F.count("*").alias("n"))


@query("u02_difference", "SELECT frame, player_id FROM det EXCEPT SELECT frame, player_id FROM track", "track")
def difference(spark, d):
    return A.detections(spark, d).select("frame", "player_id").distinct().join(A.tracks(spark, d), ["frame", "player_id"], "left_anti")


@query("u03_intersection", "SELECT frame FROM track WHERE player_id = 1 INTERSECT SELECT frame FROM track WHERE player_id = 2", "track")
def intersection(spark, d):
    t = A.tracks(spark, d)
    return t.filter("player_id = 1").select("frame").intersect(t.filter("player_id = 2").select("frame"))


@query("u04_distinct", "SELECT DISTINCT frame, team FROM pos", "pos")
def distinct(spark, d):
    return A.positions(spark, d).select("frame", "team").distinct()


@query("u05_components", f"WITH {_REACH} SELECT v, root FROM comp", "edges")
def components(spark, d):
    return identity.components(A.merge_edges(spark, d))


@query("b16_merge_map", f"""
WITH {_REACH}, s AS (SELECT root, count(*) AS n, min(v) AS first FROM comp GROUP BY root), k AS (SELECT root, row_number() OVER (ORDER BY n DESC, first)::BIGINT AS new_id FROM s)
SELECT v AS old_id, new_id FROM comp JOIN k USING (root)""", "edges")
def merge_map(spark, d):
    labels = identity.components(A.merge_edges(spark, d))
    return labels.join(identity.relabel(labels, "root", "v"), "root").select(F.col("v").alias("old_id"), "new_id")


@query("u06_reset_group", f"""
WITH {_REACH} SELECT e.a, e.b FROM edges e JOIN comp c ON c.v = e.a WHERE c.root <> (SELECT root FROM comp WHERE v = (SELECT max(a) FROM edges))""", "edges")
def reset_group(spark, d):
    e = A.merge_edges(spark, d)
    labels = identity.components(e)
    target = labels.join(e.agg(F.max("a").alias("v")), "v").select("root")
    keep = labels.join(target, "root", "left_anti").select(F.col("v").alias("a"))
    return e.join(keep, "a").select("a", "b")


@query("u07_decision_edges", """
WITH d AS (SELECT event_id, [event_id % 97, event_id % 89] AS a, [event_id % 83] AS b FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0)
SELECT DISTINCT a, b FROM (SELECT a[1] AS a, unnest(list_concat(a, b)) AS b FROM d) WHERE a <> b""")
def decision_edges(spark, d):
    i = F.col("event_id")
    rows = A.scan(spark, d, "events").filter(i % 3 == 0).select(F.array(i % 97, i % 89).alias("a_members"), F.array(i % 83).alias("b_members"), F.when(i % 2 == 0, "yes").otherwise("no").alias("decision"))
    return identity.decision_edges(rows)


@query("u08_range_replace", """
SELECT frame, count(*) AS n, count(*) FILTER (fresh) AS fresh FROM (
  SELECT frame, false AS fresh FROM det WHERE NOT frame BETWEEN 20 AND 60 UNION ALL SELECT frame, true FROM edits WHERE action = 'add' AND frame BETWEEN 20 AND 60) GROUP BY frame""", "det", "edits")
def range_replace(spark, d):
    inside = F.col("frame").between(20, 60)
    old = A.detections(spark, d).filter(~inside).select("frame", F.lit(False).alias("fresh"))
    new = A.edits(spark, d).filter("action = 'add'").filter(inside).select("frame", F.lit(True).alias("fresh"))
    return old.unionByName(new).groupBy("frame").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))


@query("k04_component_names", f"""
WITH {_REACH} SELECT root, arg_min(s_name, s_suppkey) AS name FROM comp JOIN supplier ON s_suppkey = v WHERE v % 2 = 0 GROUP BY root""", "edges")
def component_names(spark, d):
    names = A.scan(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("v"), F.col("s_name").alias("name"))
    return identity.names_by_component(names, identity.components(A.merge_edges(spark, d)), "v")


@query("k08_decision_update", """
SELECT b.tid, CASE WHEN o.name IS NOT NULL THEN o.name ELSE b.name END AS name FROM (SELECT tid, arg_min(name, seq) AS name FROM base GROUP BY tid) b LEFT JOIN (SELECT tid, arg_max(name, seq) AS name FROM overrides GROUP BY tid) o USING (tid)""", "base", "overrides")
def decision_update(spark, d):
    old = A.base_names(spark, d).groupBy("tid").agg(F.min_by("name", "seq").alias("name"))
    new = A.overrides(spark, d).groupBy("tid").agg(F.max_by("name", "seq").alias("new"))
    return old.join(new, "tid", "left").select("tid", F.coalesce("new", "name").alias("name"))
