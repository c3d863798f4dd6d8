"""Tiles, frame steps, rosters and the fill report on hand-made cases."""

import random

from pyspark.sql import functions as F

from matchgrid.operators import analytics, series, tiles
from matchgrid.operators import annotations as N

BOX = "frame int, own long, x1 double, y1 double, x2 double, y2 double"


def test_boxes_come_back_whole_from_overlapping_tiles(spark):
    rng = random.Random(6)
    boxes = [(f, i, x, y, x + 30, y + 40) for f in range(4) for i, (x, y) in enumerate((100.0 * a + rng.uniform(0, 60), 120.0 * b + rng.uniform(0, 70)) for a in range(18) for b in range(8))]
    grid = tiles.tile_grid(1920, 1080, 3, 2, 50)
    seen = tiles.seen_in_tiles(spark.createDataFrame(boxes, BOX), grid)
    assert seen.count() > len(boxes) and seen.filter("x1 < 0 or y1 < 0").count() == 0
    found = tiles.from_tiles(seen, grid, "frame").collect()
    # An overlap wider than a box lets one tile see it whole.
    assert sorted((r.frame, r.own // 6, round(r.x1, 6), round(r.y1, 6), round(r.x2, 6), round(r.y2, 6)) for r in found) == sorted((f, i, *(round(v, 6) for v in b)) for f, i, *b in boxes)


def test_tiles_cover_the_image():
    for columns, rows, overlap in ((2, 2, 0), (3, 3, 40), (1, 1, 10)):
        grid = tiles.tile_grid(1000, 700, columns, rows, overlap)
        assert all(any(left <= x < right and top <= y < bottom for _, left, top, right, bottom in grid) for x in range(0, 1000, 7) for y in range(0, 700, 7))


def test_steps_wrap_round(spark):
    frames = spark.createDataFrame([(f,) for f in (1, 2, 3, 5, 8, 8)], "frame int")
    step = lambda flagged: {r.frame: (r.previous, r.next) for r in series.stepped(frames, spark.createDataFrame([(f,) for f in flagged], "frame int")).collect()}
    assert step([2, 5]) == {1: (5, 2), 2: (5, 5), 3: (2, 5), 5: (2, 2), 8: (5, 2)}
    assert step([3])[3] == (3, 3) and step([]) == dict.fromkeys((1, 2, 3, 5, 8), (None, None))
    assert step([4])[3] == (4, 4)  # a flagged frame that is not among the frames


def test_renames_are_refused_where_the_name_is_taken(spark):
    roster = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B")], "name string, team string")
    renames = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "c", "x"), (4, "b", "b"), (5, "nobody", "z"), (6, "a", "y")], "seq int, old string, new string")
    good = N.granted(roster, renames, "seq")
    assert [tuple(r) for r in good.collect()] == [("a", "x")]
    base = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "tid int, name string")
    assert sorted(map(tuple, N.cascaded(base, good).collect())) == [(1, "x"), (2, "c"), (3, None)]
    added = N.roster_added(roster, spark.createDataFrame([(2, "n", "second"), (1, "n", "first"), (3, "a", "B")], "id int, name string, team string"), "id")
    assert sorted(map(tuple, added.collect())) == [("a", "A"), ("b", "A"), ("c", "B"), ("n", "first")]


def test_fill_report_counts_kinds(spark):
    rows = [(1, True, 0.9), (1, False, 0.5), (1, False, 0.1), (1, True, 0.3), (2, True, 1.0)]
    df = spark.createDataFrame(rows, "frame int, matched boolean, score double")
    assert [tuple(r) for r in analytics.fill_report(df, 0.8, 0.4, 4).collect()] == [(1, 0.45, 4, 2, 1, 2, 2)]
    assert analytics.fill_report(df.filter(F.lit(False)), 0.8, 0.4, 4).collect() == []
