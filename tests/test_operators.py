"""Hand-made cases of the tracking operators."""

import math

import pytest
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators import analytics, editlog, identity, ingest, models, series, temporal

BOX = "x1 double, y1 double, x2 double, y2 double"


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_homography_maps_the_corners():
    for (x, y), (u, v) in zip(G.IMAGE_CORNERS, G.PITCH_CORNERS, strict=True):
        h = G.CAMERA
        depth = h[6] * x + h[7] * y + h[8]
        assert (h[0] * x + h[1] * y + h[2]) / depth == pytest.approx(u, abs=1e-6)
        assert (h[3] * x + h[4] * y + h[5]) / depth == pytest.approx(v, abs=1e-6)


def test_vanishing_line_and_bounds(spark):
    rows = spark.createDataFrame([(-5.0, 0.0), (110.0, 73.0), (110.01, 0.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in rows.select(G.in_pitch(F.col("x"), F.col("y"))).collect()] == [1, 1, 0, 0]
    x, y = G.projected(F.lit(1.0), F.lit(0.0), [1, 0, 0, 0, 1, 0, 1, 0, -1])
    assert spark.range(1).select(x, y).first() == (None, None)


def test_typed_splits_good_and_bad(spark):
    raw = spark.createDataFrame([("1", "2.5"), ("", "1"), ("x", "1"), (None, None)], "a string, b string")
    good, bad = ingest.typed(raw, {"a": "int", "b": "double"})
    assert values(good, "a", "b") == [(1, 2.5)] and bad.count() == 3


def test_detector_json_shapes(spark):
    texts = [
        '{"objects": [], "detections": [{"bbox": [1, 2, 30, 40], "score": 0.5}]}', '{"boxes": [{"x_min": 0.5, "ymin": 0.5, "right": 1.5, "y2": 1.0}]}',
        '{"results": [{"box": {"x1": 1}}]}', "not json", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = ingest.detector_boxes(df, "t", 100.0, 100.0)
    assert values(found, "i", "x1", "y1", "x2", "y2", "confidence") == [(0, 1.0, 2.0, 30.0, 40.0, 0.5), (1, 50.0, 50.0, 100.0, 100.0, 1.0)]


def test_replay(spark):
    base = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0, 1), (1, 1, 5.0, 5.0, 6.0, 6.0, 2)], f"frame int, box_key int, {BOX}, `group` int")
    log = spark.createDataFrame(
        [(1, 1, 0, "delete", None, 3), (2, 1, 0, "move", 9.0, 3), (3, 2, -1, "add", 4.0, 1), (4, 1, 1, "move", 7.0, 3), (5, 1, 1, "reassign", None, 1), (6, 9, 9, "move", 1.0, 1)],
        "seq long, frame int, box_key int, action string, x1 double, `group` int",
    ).select("seq", "frame", "box_key", "action", "x1", F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"), "group")
    assert values(editlog.replay(base, log), "frame", "box_key", "x1", "group", "origin") == [(1, 1, 7.0, 1, "base"), (2, -1, 4.0, 1, "added")]
    assert values(editlog.replay(base, log.limit(0)), "box_key", "x1") == [(0, 0.0), (1, 5.0)]


def test_as_of_ties(spark):
    rows = spark.createDataFrame([(1, 0), (1, 3), (1, 7), (2, 5)], "k int, t int")
    events = spark.createDataFrame([(1, 3, "b", 2), (1, 3, "a", 1), (1, 6, "c", 3)], "k int, t int, v string, s int")
    found = temporal.as_of(rows, events, ["k"], "t", "v", "s")
    assert values(found, "k", "t", "v") == sorted([(1, 0, None), (1, 3, "a"), (1, 7, "c"), (2, 5, None)], key=repr)


def test_range_join_equals_brute_force(spark):
    a = spark.range(60).select((F.col("id") * 7 % 50).alias("x"), F.col("id").alias("i"))
    b = spark.range(60).select((F.col("id") * 11 % 50).alias("y"), F.col("id").alias("j"))
    for low, high in ((1, 10), (-3, 3), (0, 0)):
        found = temporal.range_join(a, b, "x", "y", low, high)
        slow = [(r.i, s.j) for r in a.collect() for s in b.collect() if low <= s.y - r.x <= high]
        assert values(found, "i", "j") == sorted(slow, key=repr)


def test_keyframes(spark):
    frames = spark.range(12).select(F.col("id").cast("int").alias("frame"))
    keys = spark.createDataFrame([(2, "pos", 0.0, 0.0), (6, "pos", 4.0, 8.0), (8, "none", None, None), (10, "pos", 1.0, 1.0)], "frame int, state string, image_x double, image_y double")
    found = {r.frame: (r.x, r.y, r.is_key) for r in temporal.between_keyframes(frames, keys).collect()}
    assert found == {2: (0.0, 0.0, 1), 3: (1.0, 2.0, 0), 4: (2.0, 4.0, 0), 5: (3.0, 6.0, 0), 6: (4.0, 8.0, 1), 10: (1.0, 1.0, 1)}


def test_gap_fill_and_smoothing(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 5, 5.0), (1, 11, 6.0)], "player_id int, frame int, x double")
    filled = series.fill_gaps(rows, ["x"])
    assert values(filled, "frame", "x") == sorted([(f, float(f)) for f in range(6)] + [(11, 6.0)], key=repr)
    assert [round(r.x, 6) for r in series.ema(rows, "x", 1.0).orderBy("frame").collect()] == [0.0, 5.0, 6.0]
    assert [r.x for r in series.ema(rows, "x", 0.5).orderBy("frame").collect()] == [0.0, 2.5, 4.25]


def test_majority_vote_is_strict(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, False])], "player_id int, frame int, b boolean")
    votes = [r.vote for r in series.majority_vote(rows, "player_id", F.col("b")).orderBy("frame").collect()]
    assert votes == [True, False, False, False]


def test_islands(spark):
    rows = spark.createDataFrame([(f,) for f in (1, 2, 3, 7, 9, 10)], "frame int").withColumn("k", F.lit(0))
    assert values(series.islands(rows, "k"), "first", "last", "n") == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]
    assert series.islands(rows.limit(0), "k").count() == 0


def test_movement_of_a_single_sample_and_equal_times(spark):
    schema = "player_id int, team string, frame int, time double, x_pitch double, y_pitch double"
    rows = spark.createDataFrame([(1, "A", 0, 0.0, 0.0, 0.0), (2, "B", 0, 0.0, 0.0, 0.0), (2, "A", 1, 0.0, 3.0, 4.0)], schema)
    found = {r.player_id: r for r in analytics.movement(rows).collect()}
    assert (found[1].distance_m, found[1].max_speed_mps, found[2].team, found[2].distance_m, found[2].max_speed_mps) == (0.0, 0.0, "B", 5.0, 5_000_000.0)


def test_directions_flip_team_two_on_equal_margins(spark):
    rows = [(f, t, float(x)) for f in range(3) for t in "AB" for x in (10, 20, 30)]
    df = spark.createDataFrame(rows, "frame int, team string, x_pitch double")
    assert values(analytics.attack_directions(df), "team", "direction") == [("A", 1), ("B", -1)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    found = dict(values(identity.components(edges), "v", "root"))
    assert all(found[i] == 1 for i in range(1, 41)) and found[100] == found[102] == 100


def test_otsu_and_thresholds(spark):
    rows = spark.createDataFrame([(v, v > 5) for v in (1, 2, 2, 3, 8, 9, 9)], "v long, p boolean")
    assert models.otsu(rows, "v").first().threshold == 3
    assert models.f1_threshold(rows, "v", F.col("p")).first() == (5.5, 1.0)
    assert models.accuracy_threshold(rows, "v", F.col("p")).first() == (5.5, 1, 1.0)
    a, b = models.two_means(rows, "v")
    assert math.isclose(a, 2.0) and math.isclose(b, 26 / 3)


def test_fused_threshold():
    assert models.fused_threshold(0.3, 0.32) == pytest.approx(0.31) and models.fused_threshold(0.3, 0.4) == 0.3
