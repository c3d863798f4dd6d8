"""Matchings and candidates against plain Python, and the rules that decide at their borders."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from matchgrid.operators import ingest, models, pairs
from matchgrid.operators import matching as M
from matchgrid.plans import registry
from matchgrid.sources import adapters as A


def plain_greedy(spark, sf_dir, x, y, tolerance, penalty=lambda a, b: 0.0):
    """{(frame, l): (r, cost)} by sorting all pairs of a frame."""
    frames = {}
    for r in A.detections(spark, sf_dir).collect():
        frames.setdefault(r.frame, []).append(r)
    out = {}
    for frame, rows in frames.items():
        left, right = ([r for r in rows if r.team_hint == t] for t in "AB")
        pairs_ = [(math.sqrt((a[x] - b[x]) ** 2 + (a[y] - b[y]) ** 2), a.detection_id, b.detection_id) for a in left for b in right]
        pairs_ = sorted((d + penalty(a, b), a, b) for d, a, b in pairs_ if d <= tolerance)
        used_l, used_r = set(), set()
        for cost, a, b in pairs_:
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                out[frame, a] = (b, cost)
    return out


CASES = [("j02_exclusive_match", "foot_x", "foot_y", 110.0), ("j04_single_frame_match", "foot_x", "foot_y", 110.0), ("j05_centre_match", "center_x", "center_y", 30.0)]


@pytest.mark.parametrize(("name", "x", "y", "tolerance"), CASES)
def test_matchings_equal_plain_greedy(spark, sf_dir, name, x, y, tolerance):
    want = plain_greedy(spark, sf_dir, x, y, tolerance)
    if name.startswith("j04"):
        want = {k: v for k, v in want.items() if k[0] == 7}
    found = {(r.frame, r.l): (r.r, r.cost) for r in registry.queries()[name](spark, sf_dir).collect()}
    assert want and found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1]) for k in want)


def test_penalty_orders_but_does_not_cut(spark, sf_dir):
    want = plain_greedy(spark, sf_dir, "foot_x", "foot_y", 80.0, lambda a, b: 1.5 * (a % 2 != b % 2))
    rows = registry.queries()["j06_outer_match"](spark, sf_dir).collect()
    assert {(r.frame, r.l): r.r for r in rows if r.cost is not None} == {k: v[0] for k, v in want.items()}
    assert any(c > 80 for _, c in want.values()) or max(c for _, c in want.values()) <= 80
    boxes = A.detections(spark, sf_dir).filter("team_hint <> ''").count()
    assert len(rows) == boxes - len(want) and all(r.x is not None for r in rows)
    one = lambda p, c: spark.createDataFrame([(1, 1, 0.0, 0.0)], f"frame int, {p} int, {p}x double, {p}y double").withColumn(f"{p}x", F.lit(c))
    got = M.candidate_pairs(one("l", 0.0), one("r", 79.0), "frame", M.foot_distance(), 80.0, F.lit(1.5)).collect()
    assert [r.cost for r in got] == [80.5]


def test_optimal_assignment_opens_new_objects(spark, sf_dir):
    rows = registry.queries()["j08_optimal_assignment"](spark, sf_dir).collect()
    right = A.detections(spark, sf_dir).filter("team_hint = 'B'").count()
    assert len(rows) == right and len({(r.frame, r.l) for r in rows}) == right and any(r.is_new for r in rows)


def test_tracker_forgets_after_five_frames(spark):
    rows = [("c", f, 0, 1.0, 1.0) for f in (0, 5, 11)]
    det = spark.createDataFrame(rows, "clip string, frame int, detection_id int, foot_x double, foot_y double")
    assert [r.track_id for r in M.track_nearest(det, "clip", "detection_id").orderBy("frame").collect()] == [1, 1, 2]


UNIT = "unit long, first int, last int, n long, sx double, sy double, ex double, ey double, team string, vx0 double, vy0 double, vx1 double, vy1 double"


def unit(i, first, last, start, end, team="A", v0=(0.0, 0.0), v1=(0.0, 0.0)):
    return (i, first, last, 5, *start, *end, team, *v0, *v1)


def test_merge_candidates_rules(spark):
    a = unit(1, 0, 10, (0.0, 0.0), (50.0, 30.0), "A", v1=(0.05, 0.0))
    others = [
        unit(2, 82, 90, (53.0, 30.0), (0.0, 0.0)), unit(3, 83, 90, (53.0, 30.0), (0.0, 0.0)), unit(4, 20, 30, (52.0, 30.0), (0.0, 0.0), "B"), unit(5, 20, 30, (52.0, 30.0), (0.0, 0.0), ""),
        unit(6, 20, 30, (55.0, 30.0), (0.0, 0.0)), unit(7, 82, 90, (41.0, 30.0), (0.0, 0.0)), unit(8, 10, 30, (50.0, 30.0), (0.0, 0.0)),
    ]
    found = {r.b_id: r for r in pairs.merge_candidates(spark.createDataFrame([a, *others], UNIT)).filter("a_id = 1").collect()}
    # 3 begins 73 frames later, 4 is of the other team, 6 would need 12 m/s, 7 is 12.6 m from where 1 was going, 8 overlaps.
    assert set(found) == {2, 5}
    two = found[2]
    assert (two.gap, two.end_dist, two.pred_dist, two.speed) == (72, 3.0, pytest.approx(0.6), 1.0)
    assert two.score == pytest.approx(0.6 + 3 * 0.35 + 72 * 0.04 + 0.05 * 24 * 0.18)


def test_chain_merges_teams_and_components(spark):
    rows = [(1, "c", 0, 10, 0.0, 0.0, 0.0, 0.0, "A", 1), (2, "c", 12, 20, 1.0, 0.0, 1.0, 0.0, "", 2), (3, "c", 12, 20, 0.5, 0.0, 0.5, 0.0, "B", 3), (4, "c", 22, 30, 1.0, 0.0, 0.0, 0.0, "B", 4), (5, "c", 12, 25, 0.1, 0.0, 0.0, 0.0, "A", 1)]
    units = spark.createDataFrame(rows, "unit long, clip string, first int, last int, sx double, sy double, ex double, ey double, team string, component long")
    assert {(r.a, r.b) for r in M.chain_merges(units, "clip").collect()} == {(1, 2), (2, 4)}
    assert (1, 5) in {(r.a, r.b) for r in M.chain_merges(units.drop("component"), "clip").collect()}


def test_duplicate_pairs(spark):
    rows = [(f, p, 1.5 * (p == 2) + 5.0 * (p == 3), 0.0) for f in range(3) for p in (1, 2, 3)] + [(9, 1, 0.0, 0.0), (9, 3, 0.5, 0.0)]
    found = pairs.duplicate_pairs(spark.createDataFrame(rows, "frame int, unit int, x_pitch double, y_pitch double"), "unit").collect()
    assert [tuple(r) for r in found] == [(1, 2, 3, 1.5)]


def test_mock_boxes(spark):
    rows = ingest.mock_boxes(spark.range(1).select(F.lit(0).alias("frame")), 1000.0, 1000.0).orderBy("detection_id").collect()
    assert len(rows) == 22 and [r.team_hint for r in rows] == ["A"] * 11 + ["B"] * 11
    assert (rows[0].x1, rows[0].y1, rows[0].x2, rows[0].y2) == pytest.approx((171.0, 290.0, 189.0, 345.0)) and rows[11].y2 == pytest.approx(585.0) and rows[12].y2 == pytest.approx(620.0)


@pytest.mark.parametrize("block", [20_000, 7])
def test_nearest_rows_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(models, "QUERY_BLOCK", block)
    points = [(i, [float((i * 37) % 101), float((i * 53) % 89)], 1 + i % 2) for i in range(60)]
    df = spark.createDataFrame(points, "id long, v array<double>, team int").repartition(5)
    for k, own in itertools.product((1, 7), (False, True)):
        for r in models.knn(df, df, "id", "v", "team", k, own).collect():
            q = points[r.id][1]
            near = sorted((math.dist(q, v), i, t) for i, v, t in points if not (own and i == r.id))[:k]
            vote = sum((1 if t == 1 else -1) / (d + 1e-6) for d, _, t in near)
            assert r.predicted == (1 if round(vote, 9) >= 0 else 2)


VALUES = "v double, good boolean"


def test_threshold_between_separable_classes_is_the_middle(spark):
    rows = spark.createDataFrame([(0.9, True), (0.6, True), (0.2, False), (0.4, False)], VALUES)
    assert tuple(models.f1_threshold(rows, "v", F.col("good")).first()) == (pytest.approx(0.5), 1.0)
    mixed = spark.createDataFrame([(0.9, True), (0.3, True), (0.2, False), (0.4, False)], VALUES)
    assert tuple(models.f1_threshold(mixed, "v", F.col("good")).first()) == (0.3, 0.8)
    assert tuple(models.f1_threshold(rows.filter("good"), "v", F.col("good")).first()) == (None, None)


def plain_accuracy(rows):
    values = sorted({v for v, _ in rows})
    cuts = [values[0] - 1e-6, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1e-6]
    best = None
    for high in (True, False):
        for t in cuts:
            ok = sum(((v >= t) if high else (v < t)) == good for v, good in rows)
            if best is None or ok > best[2]:
                best = (t, int(high), ok)
    return best[0], best[1], round(best[2] / len(rows), 6)


def test_accuracy_thresholds_are_middles_and_ends(spark):
    import random

    rng = random.Random(9)
    cases = [[(1.0, True), (2.0, True)], [(1.0, False), (2.0, False)], [(1.0, True), (2.0, False)]]
    cases += [[(float(rng.randrange(8)), rng.random() < 0.5) for _ in range(rng.randrange(3, 30))] for _ in range(6)]
    for rows in cases:
        if len({v for v, _ in rows}) > 1:
            assert tuple(models.accuracy_threshold(spark.createDataFrame(rows, VALUES), "v", F.col("good")).first()) == pytest.approx(plain_accuracy(rows))
    assert tuple(models.accuracy_threshold(spark.createDataFrame([(1.0, True), (1.0, False)], VALUES), "v", F.col("good")).first()) == (None, None, None)


@pytest.mark.parametrize(("n", "limit"), [(5, 9), (9, 9), (10, 9), (23, 4), (40, 39), (101, 20)])
def test_balanced_rows_are_evenly_spaced(spark, n, limit):
    rows = spark.range(n).select("id", F.lit(1).alias("label"))
    want = list(range(n)) if n <= limit else sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)})
    assert sorted(r.id for r in models.balanced(rows, "label", "id", limit).collect()) == want


def test_next_start_weighs_image_distance_by_its_scale(spark):
    rows = [(1, "A", 10, 0.0, 0.0), (2, "A", 11, 30.0, 0.0), (3, "A", 14, 3.0, 0.0), (4, "B", 11, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "player_id int, team string, frame int, foot_x double, foot_y double")
    nxt = lambda scale: {r.player_id: r.next_id for r in pairs.next_starts(df, 120, scale).collect()}[1]
    assert nxt(1.0) == 3 and nxt(10.0) == 2  # 32 against 11, then 5 against 8.3


def test_labelled_frames_have_no_problems(spark):
    from matchgrid.operators import series

    rows = spark.createDataFrame([(f, 1, 200.0 * f, 0.0) for f in range(3)], "frame int, player_id int, foot_x double, foot_y double")
    found = lambda labelled: sorted(tuple(r) for r in series.frame_problems(rows, 1, 130.0, labelled).collect())
    assert found(None) == [(1, "warp"), (2, "warp")]
    assert found(spark.createDataFrame([(1,)], "frame int")) == [(2, "warp")]


def test_identity_document(spark):
    from matchgrid.operators import annotations as N

    docs = [
        (1, '{"cuts":{"1":[10]}}'), (2, '{"merges":[[[1,10],[2,0]]]}'), (3, '{"names":{"2_0":"second","7_0":"nobody"}}'), (4, '{"names":{"1_10":"late"}}'),
        (5, '{"geom":{"11_1":[1.0,2.0,3.0,4.0]}}'), (6, "broken"),
    ]
    rows = [(f, 1, 0.0, 0.0, 1.0, 1.0) for f in (9, 10, 11)] + [(20, 2, 0.0, 0.0, 1.0, 1.0), (1, 3, 0.0, 0.0, 1.0, 1.0)]
    tables = N.edit_tables(spark.createDataFrame(docs, "seq int, doc string"), "doc", "seq")
    found = {(r.frame, r.tid): r for r in N.identified(spark.createDataFrame(rows, "frame int, tid int, x1 double, y1 double, x2 double, y2 double"), tables).collect()}
    one = [found[k] for k in ((10, 1), (11, 1), (20, 2))]
    assert {(r.player_id, r.name) for r in one} == {(1, "second")} and [r.cut for r in one] == [10, 10, 0]
    assert (found[11, 1].x1, found[11, 1].y2) == (1.0, 4.0) and found[10, 1].x1 == 0.0
    assert (found[1, 3].player_id, found[1, 3].name) == (2, "") and (found[9, 1].player_id, found[9, 1].cut) == (3, 0)
