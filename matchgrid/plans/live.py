"""Queries that run a stream over ``events`` to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchgrid.plans.registry import query
from matchgrid.sources import adapters as A
from matchgrid.sources.store import shared_dir
from matchgrid.streaming import live


def stream(spark, d, columns):
    """Detections as a stream of the events table, with its time and clip."""
    spark.conf.set(*live.STORE)
    files = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
    # One table file in a folder of tables, or a folder of files.
    raw = files.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events*.parquet")
    det = A.detections_of(raw, "ts").withColumns({"ts": F.col("ts").cast("timestamp"), "clip": F.floor(F.col("frame") / 50).cast("int"), "team": F.when(F.col("team_hint") == "", "B").otherwise(F.col("team_hint"))})
    return det.select(*columns)


def ended(df, at, mode="append", keys=()):
    """Run the stream until its input is read; the query, with its last progress.

    Rows go to ``at``/rows, the checkpoint to ``at``/state. In update mode every batch is a folder of its own, named
    by its number, so that a batch that is run again replaces itself.
    """
    writer = df.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "update":
        running = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/rows/_batch={number}")).start()
    else:
        parts = [c for c in ("late",) if c in df.columns]
        running = writer.format("parquet").option("path", f"{at}/rows").partitionBy(*parts).start()
    running.awaitTermination()
    return running


def drained(spark, df, mode="append", at=None, keys=()):
    """Run the stream until its input is read; the result is the table it wrote.

    Rows and checkpoint are in the shared folder; a run that is given the folder
    ``at`` of one that was stopped goes on from its checkpoint. In update mode the last
    batch that has a row of the ``keys`` counts.
    """
    at = at or f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    ended(df, at, mode)
    if mode != "update":
        return spark.read.schema(df.schema).parquet(f"{at}/rows")
    rows = spark.read.schema(df.schema.add("_batch", "long")).parquet(f"{at}/rows")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*").select(*df.columns)


@query("x01_live_tracks")
def live_tracks(spark, d):
    rows = drained(spark, live.live_tracks(stream(spark, d, ["clip", "frame", "detection_id", "foot_x", "foot_y", "ts"])))
    return rows.filter("not late").drop("late")


@query("x05_windowed_counts", """
SELECT time_bucket(INTERVAL '60 minutes', ts) AS start, CASE WHEN team_hint = '' THEN 'B' ELSE team_hint END AS team, count(*) AS n FROM det JOIN events USING (event_id) GROUP BY ALL""", "det")
def windowed_counts(spark, d):
    out = live.windowed_counts(stream(spark, d, ["ts", "team", "foot_x"]), "60 minutes")
    return drained(spark, out, "update", keys=["start", "team"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "team", "n")


@query("x04_presence_sessions", """
WITH e AS (SELECT player_id, ts::TIMESTAMP AS ts FROM det JOIN events USING (event_id)),
s AS (SELECT *, sum(CASE WHEN ts >= prev + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, lag(ts) OVER (PARTITION BY player_id ORDER BY ts) AS prev FROM e)),
w AS (SELECT player_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY player_id, k)
SELECT start, "end", player_id, n FROM w WHERE "end" <= (SELECT max(ts) - INTERVAL '10 minutes' FROM e)""", "det")
def presence_sessions(spark, d):
    """Sessions that the watermark has closed."""
    rows = drained(spark, live.presence_sessions(stream(spark, d, ["ts", "player_id"])))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "player_id", "n")


@query("x03_live_ema", """
WITH RECURSIVE o AS (SELECT player_id, frame, x, row_number() OVER (PARTITION BY player_id ORDER BY frame) AS i FROM (SELECT player_id, frame, arg_min(foot_x, detection_id) AS x FROM det GROUP BY ALL)),
e AS (SELECT player_id, frame, x, i FROM o WHERE i = 1 UNION ALL SELECT o.player_id, o.frame, 0.5 * o.x + 0.5 * e.x, o.i FROM e JOIN o ON o.player_id = e.player_id AND o.i = e.i + 1)
SELECT player_id, frame, round(x, 4) AS x FROM e""", "det")
def live_ema(spark, d):
    """Smoothed positions of every player: of several boxes in a frame the first counts, as later ones are not newer."""
    rows = stream(spark, d, ["player_id", "frame", F.col("detection_id").alias("place"), F.col("foot_x").alias("x"), "ts"])
    return drained(spark, live.live_ema(rows)).filter("not late").select("player_id", "frame", F.round("x", 4).alias("x"))


@query("x06_reseed_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS day, (det.frame // 8)::BIGINT AS seed, count(*) AS n, min(det.frame) AS keyframe, count(DISTINCT det.frame) AS frames FROM det JOIN events USING (event_id) GROUP BY ALL""", "det")
def reseed_windows(spark, d):
    """Blocks of eight frames, each of which starts tracking anew at its first frame."""
    rows = drained(spark, live.reseed_blocks(stream(spark, d, ["ts", "frame"])), "update", keys=["day", "seed"])
    return rows.select(F.col("day").cast("timestamp_ntz").alias("day"), "seed", "n", "keyframe", F.bit_count("seen").cast("long").alias("frames"))


@query("x07_late_rows", """
WITH e AS (SELECT det.event_id, (det.frame // 50)::INT AS clip, det.frame, epoch_ms(ts::TIMESTAMP) AS ms FROM det JOIN events USING (event_id)),
one AS (SELECT * FROM e WHERE event_id % 7 <> 3), w AS (SELECT max(ms) - 600000 AS w FROM one),
st AS (SELECT clip, max(frame) AS newest FROM one GROUP BY clip HAVING max(ms) + 1800000 >= (SELECT w FROM w)),
two AS (SELECT e.clip, CASE WHEN newest IS NULL THEN ms <= w ELSE frame <= newest END AS late FROM e LEFT JOIN st USING (clip), w WHERE event_id % 7 = 3)
SELECT clip, count(*) FILTER (NOT late) AS tracked, count(*) FILTER (late) AS late FROM (SELECT clip, false AS late FROM one UNION ALL SELECT clip, late FROM two) GROUP BY clip""", "det")
def late_rows(spark, d):
    """Every seventh event comes after all the others have been tracked: how many of each clip are too late."""
    at = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    events = A.scan(spark, d, "events")
    for part in ("event_id % 7 <> 3", "event_id % 7 = 3"):
        events.filter(part).write.mode("append").parquet(f"{at}/in/events.parquet")
        rows = live.live_tracks(stream(spark, f"{at}/in", ["clip", "frame", "detection_id", "foot_x", "foot_y", "ts"]))
        found = drained(spark, rows, at=f"{at}/out")
    return found.groupBy("clip").agg(F.count_if(~F.col("late")).alias("tracked"), F.count_if("late").alias("late"))
