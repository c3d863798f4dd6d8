"""Streams write to the shared folder and go on from their checkpoint."""

import pytest
from pyspark.sql import functions as F

from matchgrid.plans import live, registry
from matchgrid.sources.store import shared_dir
from matchgrid.streaming import live as streams


@pytest.mark.parametrize("name", ["x01_live_tracks", "x03_live_ema", "x04_presence_sessions", "x05_windowed_counts", "x06_reseed_windows", "x07_late_rows"])
def test_rows_are_in_the_shared_folder(name, spark, sf_dir):
    df = registry.queries()[name](spark, sf_dir)
    files = df.inputFiles()
    assert df.count() > 0 and files and all(shared_dir(spark).removeprefix("file:") in f for f in files)


@pytest.mark.parametrize("mode", ["append", "update"])
def test_a_second_run_goes_on_from_the_checkpoint(mode, spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "at")

    def found():
        rows = spark.readStream.schema("i long").parquet(source)
        df = rows if mode == "append" else rows.groupBy((F.col("i") % 2).alias("k")).agg(F.sum("i").alias("i"))
        return sorted(r.i for r in live.drained(spark, df, mode, at, keys=["k"]).collect())

    spark.range(3).toDF("i").coalesce(1).write.mode("append").parquet(source)
    assert found() == ([0, 1, 2] if mode == "append" else [1, 2])
    spark.range(3, 5).toDF("i").coalesce(1).write.mode("append").parquet(source)
    assert found() == ([0, 1, 2, 3, 4] if mode == "append" else [4, 6])


BOXES = "clip int, frame int, detection_id int, foot_x double, foot_y double, second long"


def tracked(spark, tmp_path, rows):
    """Feed rows of (clip, frame, detection_id, x, y, second) to the tracker; the query that ran and all rows so far."""
    spark.conf.set(*streams.STORE)
    df = spark.createDataFrame(rows, BOXES).withColumn("ts", F.timestamp_seconds("second")).drop("second")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = live.ended(streams.live_tracks(stream, late="10 seconds", idle="60 seconds"), f"{tmp_path}/at")
    found = spark.read.parquet(f"{tmp_path}/at/rows").withColumn("late", F.col("late").cast("boolean"))
    return query, [r.asDict() for r in found.collect()]


def states(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_ends_and_late_rows_come_out_marked(spark, tmp_path):
    first = [(c, f, i, 100.0 * i, 5.0, 1000 + f) for c in (1, 2) for f in range(3) for i in range(2)]
    query, rows = tracked(spark, tmp_path, first)
    assert len(rows) == 12 and not any(r["late"] for r in rows) and {r["track_id"] for r in rows} == {1, 2}
    # In time for clip 1; a frame that clip 2 has already seen is late.
    query, rows = tracked(spark, tmp_path, [(1, 3, 0, 1.0, 5.0, 1003), (2, 2, 5, 1.0, 5.0, 1002), (3, 0, 0, 1.0, 1.0, 1004)])
    assert len(rows) == 15
    assert [(r["clip"], r["frame"], r["track_id"]) for r in rows if r["late"]] == [(2, 2, None)]
    assert [r["track_id"] for r in rows if (r["clip"], r["frame"]) == (1, 3)] == [1]
    # Much later only the newest clip has state.
    query, rows = tracked(spark, tmp_path, [(9, 0, 0, 1.0, 1.0, 5000)])
    query, rows = tracked(spark, tmp_path, [(9, 1, 0, 1.0, 1.0, 5001)])
    assert states(query) in (1, 2)  # the value, and its timer where the store counts it
    # A clip that has ended gets no state back, its rows are late; a clip that starts after the watermark is not.
    query, rows = tracked(spark, tmp_path, [(1, 9, 0, 1.0, 5.0, 1009), (4, 0, 0, 1.0, 5.0, 5002)])
    assert sorted((r["clip"], r["frame"], r["late"]) for r in rows if r["clip"] == 4 or r["frame"] == 9) == [(1, 9, True), (4, 0, False)]
    late = [r for r in rows if r["late"]]
    assert len(rows) == 19 and len(late) == 2 and all(r["track_id"] is None for r in late)
    # Late rows are an output of their own.
    assert spark.read.parquet(f"{tmp_path}/at/rows/late=true").count() == 2


def test_windowed_counts_drop_their_state(spark, tmp_path):
    def run(rows):
        df = spark.createDataFrame(rows, "second long, team string, foot_x double").withColumn("ts", F.timestamp_seconds("second")).drop("second")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streams.windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "1 minute", "1 minute")
        return live.ended(out, f"{tmp_path}/at", "update")

    run([(60 * m, "A", 1.0) for m in range(50)])
    assert states(run([(60 * 100, "A", 1.0)])) <= 3
