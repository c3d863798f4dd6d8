"""Tracking tables derived from the driver's tables, in Spark and as DuckDB views.

The arithmetic is the same on both sides and stays in integers as long as it
can, so results compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G

PER_FRAME = 20
PLAYERS = 25


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column) -> Column:
    return c.cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per event: 20 detections a frame, two frames a second."""
    return detections_of(scan(spark, sf_dir, "events"))


def detections_of(e: DataFrame, *more: str) -> DataFrame:
    """The boxes of a batch or stream of events, with ``more`` of its columns."""
    c, i = _long(F.round(F.col("value") * 100)), F.col("event_id")
    hint = F.when(F.col("event_type").isin("click", "view"), "A").when(F.col("event_type").isin("purchase", "signup"), "B").otherwise("")
    base = e.select(
        *more, i, F.expr("cast(event_id div 20 as int)").alias("frame"), (i % PER_FRAME).cast("int").alias("detection_id"),
        (F.col("user_id") % PLAYERS).cast("int").alias("player_id"), ((7 * c + 13 * i) % 1900).alias("_x"), (760 + (11 * c + 29 * i) % 130).alias("_y"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("confidence"), hint.alias("team_hint"),
    )
    boxes = base.select(
        *more, "event_id", "frame", "detection_id", "player_id", (F.col("frame") / 2.0).alias("time"), F.col("_x").cast("double").alias("x1"), F.col("_y").cast("double").alias("y1"),
        (F.col("_x") + 8 + F.col("event_id") % 17).cast("double").alias("x2"), (F.col("_y") + 20 + (3 * F.col("event_id")) % 25).cast("double").alias("y2"), "confidence", "team_hint",
    )
    fx, fy = G.foot(F.col("x1"), F.col("x2"), F.col("y2"))
    return boxes.withColumns({"center_x": (F.col("x1") + F.col("x2")) / 2, "center_y": (F.col("y1") + F.col("y2")) / 2, "foot_x": fx, "foot_y": fy})


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with pitch coordinates (rounded to mm) and team."""
    d = detections(spark, sf_dir)
    x, y = G.projected(F.col("foot_x"), F.col("foot_y"))
    d = d.withColumns({"x_pitch": F.round(x, 3), "y_pitch": F.round(y, 3)})
    return d.withColumns({"in_pitch": G.in_pitch(F.col("x_pitch"), F.col("y_pitch")), "team": F.when(F.col("team_hint") == "", "B").otherwise(F.col("team_hint"))})


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box edit log: the order's key is its place in the log."""
    o, k = scan(spark, sf_dir, "orders"), F.col("o_orderkey")
    add = F.col("o_orderpriority") == "5-LOW"
    action = F.when(add, "add").when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "move").otherwise("reassign")
    return o.select(
        k.alias("seq"), (F.col("o_custkey") % 500).cast("int").alias("frame"), F.when(add, -1 - k % 20).otherwise(k % 20).cast("int").alias("box_key"),
        action.alias("action"), (k % 1900).cast("double").alias("x1"), (760 + k % 130).cast("double").alias("y1"),
        (k % 1900 + 12).cast("double").alias("x2"), (790 + k % 130).cast("double").alias("y2"), (1 + k % 3).cast("int").alias("group"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scan(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 500).cast("int").alias("frame"), (F.col("o_orderkey") % 25).cast("int").alias("tid"), F.col("o_orderpriority").alias("name"))


def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") % 25).cast("int").alias("tid"), F.col("s_name").alias("name"))


def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("a"), F.expr("s_suppkey - s_suppkey % 7").alias("b"))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyframe per frame: its line item of the largest quantity, the first by its keys."""
    li = scan(spark, sf_dir, "lineitem").withColumn("frame", (F.col("l_orderkey") % 2000).cast("int"))
    order = F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    first = li.groupBy("frame").agg(F.min_by(F.struct("l_partkey", "l_suppkey", "l_returnflag"), order).alias("l")).select("frame", "l.*")
    none = F.col("l_returnflag") == "R"
    return first.select("frame", F.when(none, "none").otherwise("pos").alias("state"), F.when(~none, F.col("l_partkey") % 1900 + 0.0).alias("image_x"), F.when(~none, F.col("l_suppkey") % 1000 + 0.0).alias("image_y"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of two teams, quantised to integers."""
    v = scan(spark, sf_dir, "embeddings")
    return v.select("vec_id", (F.col("label") % 2 + 1).cast("int").alias("team"), F.transform("embedding", lambda e: _long(F.round(e.cast("double") * 1000))).alias("q"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 RGB triples per vector."""
    v = scan(spark, sf_dir, "embeddings")
    b = F.transform("embedding", lambda e: F.pmod(_long(F.round(e.cast("double") * 1000)), F.lit(256)))
    at = F.sequence(F.lit(0), F.lit(20))
    triple = lambda j: F.struct(F.get("b", j * 3).alias("r"), F.get("b", j * 3 + 1).alias("g"), F.get("b", j * 3 + 2).alias("b"))
    return v.select("vec_id", b.alias("b")).select("vec_id", F.transform(at, triple).alias("px"))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector responses in four shapes, one box each, in relative or pixel coordinates."""
    e = scan(spark, sf_dir, "events")
    s = lambda c: c.cast("string")
    i = F.col("event_id")
    a, b = (i % 50).cast("int"), (i % 30).cast("int")
    one = F.concat(F.lit('{"objects":[{"x_min":0.'), s(10 + a), F.lit(',"y_min":0.'), s(10 + b), F.lit(',"x_max":0.7,"y_max":0.9}]}'))
    two = F.concat(F.lit('{"objects":[],"detections":[{"bbox":['), s(a), F.lit(","), s(b), F.lit(",500,400],"), F.lit('"confidence":0.5}]}'))
    three = F.concat(F.lit('{"boxes":[{"left":'), s(a), F.lit(',"top":'), s(b), F.lit(',"right":2500,"bottom":300,"score":0.25}]}'))
    four = F.concat(F.lit('{"results":[{"box":{"x1":'), s(a), F.lit(',"y1":'), s(b), F.lit("}}]}"))
    k = F.expr("event_id div 10") % 4
    return e.select("event_id", F.when(k == 0, one).when(k == 1, two).when(k == 2, three).otherwise(four).alias("response"))


_H = [f"{v!r}::DOUBLE" for v in G.CAMERA]
#: DuckDB text of the same tables; each may use those above it.
VIEWS = {
    "det": """
      SELECT event_id, frame, detection_id, player_id, frame / 2.0::DOUBLE AS time, x::DOUBLE AS x1, y::DOUBLE AS y1,
             (x + 8 + event_id % 17)::DOUBLE AS x2, (y + 20 + (3 * event_id) % 25)::DOUBLE AS y2, confidence, team_hint,
             (x + x + 8 + event_id % 17) / 2.0::DOUBLE AS center_x, (y + y + 20 + (3 * event_id) % 25) / 2.0::DOUBLE AS center_y,
             (x + x + 8 + event_id % 17) / 2.0::DOUBLE AS foot_x, (y + 20 + (3 * event_id) % 25)::DOUBLE AS foot_y
      FROM (SELECT event_id, (event_id // 20)::INT AS frame, (event_id % 20)::INT AS detection_id, (user_id % 25)::INT AS player_id,
                   (7 * c + 13 * event_id) % 1900 AS x, 760 + (11 * c + 29 * event_id) % 130 AS y,
                   json_extract_string(props, '$.k')::INT / 100.0::DOUBLE AS confidence,
                   CASE WHEN event_type IN ('click', 'view') THEN 'A' WHEN event_type IN ('purchase', 'signup') THEN 'B' ELSE '' END AS team_hint
            FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events))""",
    "pos": f"""
      SELECT *, CASE WHEN x_pitch BETWEEN -5 AND 110 AND y_pitch BETWEEN -5 AND 73 THEN 1 ELSE 0 END AS in_pitch,
             CASE WHEN team_hint = '' THEN 'B' ELSE team_hint END AS team
      FROM (SELECT *, round(({_H[0]} * foot_x + {_H[1]} * foot_y + {_H[2]}) / nullif({_H[6]} * foot_x + {_H[7]} * foot_y + {_H[8]}, 0), 3) AS x_pitch,
                   round(({_H[3]} * foot_x + {_H[4]} * foot_y + {_H[5]}) / nullif({_H[6]} * foot_x + {_H[7]} * foot_y + {_H[8]}, 0), 3) AS y_pitch FROM det)""",
    "track": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, frame ORDER BY detection_id) AS rn FROM pos WHERE in_pitch <> 0) WHERE rn = 1""",
    "edits": """
      SELECT o_orderkey AS seq, (o_custkey % 500)::INT AS frame,
             (CASE WHEN o_orderpriority = '5-LOW' THEN -1 - o_orderkey % 20 ELSE o_orderkey % 20 END)::INT AS box_key,
             CASE WHEN o_orderpriority = '5-LOW' THEN 'add' WHEN o_orderstatus = 'F' THEN 'delete' WHEN o_orderstatus = 'O' THEN 'move' ELSE 'reassign' END AS action,
             (o_orderkey % 1900)::DOUBLE AS x1, (760 + o_orderkey % 130)::DOUBLE AS y1, (o_orderkey % 1900 + 12)::DOUBLE AS x2,
             (790 + o_orderkey % 130)::DOUBLE AS y2, (1 + o_orderkey % 3)::INT AS "group" FROM orders""",
    "overrides": "SELECT o_orderkey AS seq, (o_custkey % 500)::INT AS frame, (o_orderkey % 25)::INT AS tid, o_orderpriority AS name FROM orders",
    "base": "SELECT s_suppkey AS seq, (s_suppkey % 25)::INT AS tid, s_name AS name FROM supplier",
    "edges": "SELECT s_suppkey AS a, s_suppkey - s_suppkey % 7 AS b FROM supplier",
    "keyframes": """
      SELECT frame, CASE WHEN l_returnflag = 'R' THEN 'none' ELSE 'pos' END AS state,
             CASE WHEN l_returnflag <> 'R' THEN (l_partkey % 1900)::DOUBLE END AS image_x, CASE WHEN l_returnflag <> 'R' THEN (l_suppkey % 1000)::DOUBLE END AS image_y
      FROM (SELECT *, (l_orderkey % 2000)::INT AS frame, row_number() OVER (PARTITION BY l_orderkey % 2000 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem) WHERE rn = 1""",
    "features": "SELECT vec_id, (label % 2 + 1)::INT AS team, list_transform(embedding, lambda e: round(e::DOUBLE * 1000)::BIGINT) AS q FROM embeddings",
    "px": """
      SELECT vec_id, j, b[3 * j + 1] AS r, b[3 * j + 2] AS g, b[3 * j + 3] AS bl
      FROM (SELECT vec_id, list_transform(embedding, lambda e: ((round(e::DOUBLE * 1000)::BIGINT % 256) + 256) % 256) AS b, unnest(range(0, 21)) AS j FROM embeddings)""",
}
NEEDS = {"pos": ["det"], "track": ["det", "pos"]}


def oracle(body: str, *views: str) -> str:
    """``body`` with the views it uses as common table expressions in front."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not names:
        return body
    if body.upper().startswith("WITH "):
        rest = body[5:]
        if rest.upper().startswith("RECURSIVE "):
            return f"WITH RECURSIVE {ctes}, {rest[10:]}"
        return f"WITH {ctes}, {rest}"
    return f"WITH {ctes} {body}"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions inside the pitch, the first per player and frame."""
    from pyspark.sql import Window

    # Those outside come last and go after the window: a filter before it would be pushed down to the scan and there
    # work out the projection, rounding and all, anew for each time that it is named.
    inside = F.when(F.col("in_pitch") != 0, 0).otherwise(1)
    first = F.row_number().over(Window.partitionBy("player_id", "frame").orderBy(inside, "detection_id"))
    return positions(spark, sf_dir).withColumn("rn", first).filter("rn = 1 and in_pitch <> 0").drop("rn")
