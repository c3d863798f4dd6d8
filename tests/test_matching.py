"""Matchers and trackers: ties, bounds and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchgrid.operators import matching as M


def best_cost(cost, left, right):
    """Most pairs, then least cost, by trying all choices."""
    pairs = list(zip(cost, left, right, strict=True))
    top = (0, 0.0)
    for n in range(1, min(len(set(left)), len(set(right))) + 1):
        for chosen in itertools.combinations(pairs, n):
            if len({p[1] for p in chosen}) == n == len({p[2] for p in chosen}):
                top = max(top, (n, -sum(p[0] for p in chosen)))
    return top


@pytest.mark.parametrize("seed", range(12))
def test_optimal_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cells = [(a, b) for a in range(4) for b in range(4) if rng.random() < 0.6]
    if not cells:
        return
    left, right = (np.array(x) for x in zip(*cells, strict=True))
    cost = rng.integers(1, 20, len(cells)).astype(float)
    taken = M.optimal(cost, left, right)
    assert len(set(left[taken])) == len(taken) == len(set(right[taken]))
    assert (len(taken), -cost[taken].sum()) == best_cost(cost.tolist(), left.tolist(), right.tolist())


def test_greedy_ties_and_exclusiveness():
    cost, left, right = np.array([2.0, 1.0, 1.0, 1.0]), np.array([0, 1, 0, 1]), np.array([1, 0, 0, 1])
    taken = M.greedy(cost, left, right)
    assert [(left[i], right[i]) for i in taken] == [(0, 0), (1, 1)]


def test_tracker_bounds():
    t = M.NearestTracker(max_distance=10, max_missed=2)
    assert t.frame(0, [(0, 0), (20, 0)]) == [(1, None), (2, None)]
    assert t.frame(1, [(10, 0)]) == [(3, None)]  # exactly the limit from both: not matched
    assert t.frame(3, [(0, 1)])[0][0] == 1  # gap of max_missed + 1
    assert t.frame(7, [(0, 1)])[0][0] == 4  # one frame more
    t = M.NearestTracker(max_distance=10, max_missed=2)
    t.frame(0, [(0, 0), (8, 0)])
    assert t.frame(1, [(4, 0)])[0][0] == 1  # equally near: the older track


def test_velocity_tracker_predicts():
    t = M.VelocityTracker(reach=3)
    a = [t.frame(f, [("A", 5.0 * f, 0.0)])[0] for f in (0, 1)]
    assert a[0] != a[1]  # a step beyond the reach
    t = M.VelocityTracker(reach=6)
    ids = [t.frame(f, [("A", 5.0 * f, 0.0)])[0] for f in (0, 1, 2)]
    assert len(set(ids)) == 1
    assert t.frame(5, [("A", 25.0, 0.0)])[0] == ids[0]
    assert t.frame(6, [("B", 30.0, 0.0)])[0] != ids[0]


def test_suppression(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 0.0, 15.0, 10.0), (1, 2, 14.0, 0.0, 18.0, 10.0), (2, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, id int, x1 double, y1 double, x2 double, y2 double")
    kept = {(r.frame, r.id) for r in M.suppressed(df, "frame", "id", 0.3).collect()}
    assert kept == {(1, 0), (1, 2), (2, 0)}
    assert {(r.frame, r.id) for r in M.suppressed(df, "frame", "id", 0.5).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_outer_match_keeps_everything(spark):
    left = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 50.0, 0.0)], "frame int, l int, lx double, ly double")
    right = spark.createDataFrame([(1, 0, 3.0, 0.0), (2, 5, 0.0, 0.0)], "frame int, r int, rx double, ry double")
    found = M.exclusive(M.candidate_pairs(left, right, "frame", M.foot_distance(), 3.0), "frame")
    rows = {(r.frame, r.l, r.r) for r in M.with_unmatched(found, left, right, "frame").collect()}
    assert rows == {(1, 0, 0), (1, 1, None), (2, None, 5)}


def test_stream_equals_batch(spark, sf_dir):
    from matchgrid.plans import registry

    q = registry.queries()
    batch = q["j01_nearest_tracker"](spark, sf_dir).select("clip", "frame", "detection_id", "track_id")
    live = q["x01_live_tracks"](spark, sf_dir).select("clip", "frame", "detection_id", "track_id")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, live.collect()))


def test_chain_takes_the_nearest_free_successor(spark):
    rows = [(0, 1, 0, 5, 0.0, 0.0, 1.0, 0.0, "A"), (0, 2, 7, 9, 2.0, 0.0, 3.0, 0.0, "A"), (0, 3, 7, 9, 1.5, 0.0, 9.0, 0.0, "B"), (0, 4, 20, 22, 3.0, 0.0, 3.0, 0.0, "A")]
    df = spark.createDataFrame(rows, "clip int, unit long, first int, last int, sx double, sy double, ex double, ey double, team string")
    assert {(r.a, r.b) for r in M.chain_merges(df, "clip").collect()} == {(1, 2), (2, 4)}
    assert M.chain_merges(df.limit(0), "clip").collect() == []


def test_pandas_order_does_not_matter(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"clip": 0, "frame": np.repeat(range(10), 3).astype("int32"), "k": np.tile(range(3), 10).astype("int32"), "foot_x": rng.random(30) * 50, "foot_y": rng.random(30)})
    df = spark.createDataFrame(pdf)
    a = M.track_nearest(df, "clip", "k").orderBy("frame", "k").collect()
    b = M.track_nearest(df.orderBy(F.rand(1)), "clip", "k").orderBy("frame", "k").collect()
    assert a == b
