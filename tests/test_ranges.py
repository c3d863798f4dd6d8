"""Running values over range partitions against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.operators import ranges


def table(n, seed=3):
    rng = random.Random(seed)
    at = rng.sample(range(10 * n or 1), n)
    return [(a, rng.choice([None, rng.randrange(100)])) for a in at]


@pytest.mark.parametrize("n", [0, 1, 500])
@pytest.mark.parametrize("down", [False, True])
def test_running_sums_and_places(spark, n, down):
    rows = table(n)
    df = spark.createDataFrame(rows, "t long, v long").repartition(5)
    order = F.desc("t") if down else F.asc("t")
    found = {r.t: (r.s, r.s_all) for r in ranges.running_sums(df, [order], {"s": F.col("v")}).collect()}
    places = {r.t: r.place for r in ranges.numbered(df, [order], "place").collect()}
    total, so_far, want = sum(v or 0 for _, v in rows), 0, {}
    for t, v in sorted(rows, reverse=down):
        so_far += v or 0
        want[t] = (so_far, total)
    assert found == want
    assert places == {t: i + 1 for i, t in enumerate(want)}


@pytest.mark.parametrize("n", [0, 1, 500])
@pytest.mark.parametrize("own", [False, True])
def test_carried_values(spark, n, own):
    # Long stretches without a value reach over whole partitions.
    rows = [(t, v if v is not None and v > 95 else None) for t, v in table(n)]
    df = spark.createDataFrame(rows, "t long, v long").repartition(5)
    found = {r.t: (r.a, r.b) for r in ranges.carried(df, "t", {"a": F.col("v")}, {"b": F.col("v")}, own).collect()}
    known = sorted((t, v) for t, v in rows if v is not None)
    before = lambda t: [v for k, v in known if k < t or (own and k == t)]
    after = lambda t: [v for k, v in known if k > t or (own and k == t)]
    assert found == {t: ((before(t) or [None])[-1], (after(t) or [None])[0]) for t, _ in rows}


@pytest.mark.parametrize("values", [[1.5], [1.0, 2.0], [5.0] * 400 + [float(i) for i in range(200)]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    found = ranges.percentiles(df, F.col("v"), [0.05, 0.5, 0.95]).first().p
    assert np.allclose(found, np.percentile(values, [5, 50, 95]))


def test_percentiles_without_values(spark):
    assert ranges.percentiles(spark.createDataFrame([], "v double"), F.col("v"), [0.5]).first().p == [None]
