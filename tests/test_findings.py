"""What failed on larger tables, in small."""

from __future__ import annotations

import pytest

from matchgrid.operators import masks
from matchgrid.plans import registry
from matchgrid.sources import adapters as A
from parity import assert_same


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def later_events(spark, sf_dir, tmp_path):
    """The events with ids from two millions on."""
    A.scan(spark, sf_dir, "events").selectExpr("event_id + 2000000 AS event_id", "* EXCEPT (event_id)").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def same_as_sql(name, spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert_same(registry.queries()[name](spark, folder), con, registry.oracle_sql()[name])


def test_runs_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 0, 5, 0, 9, 1.0), (1, 1, 5, 4, 20, 2.0)], "frame int, object int, y int, x1 int, x2 int, logit double")
    found = masks.exclusive_runs(rows.filter("frame > 0"))
    assert {(r.object, r.x1, r.x2) for r in found.collect()} == {(0, 0, 3), (1, 4, 20)}
    assert "BroadcastHashJoin" not in plan_of(found)


def test_boxes_are_shuffled_not_the_runs_of_their_masks(spark, later_events):
    name = "a16_exclusive_masks"
    plan = plan_of(registry.queries()[name](spark, later_events))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Generate" not in plan
    same_as_sql(name, spark, later_events)


def test_extents_of_many_runs_on_a_line(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(masks, "SHAPES", 50)
    rng = np.random.default_rng(5)
    shapes = []
    for frame, objects, wide in ((0, 300, 40), (1, 7, 9), (2, 60, 10**10), (3, 1, 5), (4, 2, 3)):
        for thing in range(objects):
            x = int(rng.integers(-wide, wide))
            live = frame != 4  # a frame without a pixel
            shapes.append((frame, thing, x, x + int(rng.integers(-1, 30)), int(rng.integers(-2, 3)), float(rng.integers(1, 4)) if live else -1.0))

    def runs_of(table):
        f, x1, x2, y, logit = (table.column(c).to_numpy() for c in ("frame", "x1", "x2", "y", "logit"))
        row = np.arange(len(f))
        return tuple(map(np.concatenate, ((row, row), (y, y + 1), (x1, x1 + 2), (x2, x2), (logit, logit - 1))))

    best = {}
    for frame, thing, x1, x2, y, logit in shapes:
        for line, left, sure in ((y, x1, logit), (y + 1, x1 + 2, logit - 1)):
            for x in range(left, x2 + 1) if sure > 0 else ():
                best[frame, line, x] = max(best.get((frame, line, x), (0, 0)), (sure, -thing))
    want = {}
    for (frame, y, x), (_, thing) in best.items():
        want.setdefault((frame, -thing), []).append((x, y))
    want = {(*k, min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), len(p)) for k, p in want.items() if len(p) >= 3}
    rows = spark.createDataFrame(shapes, "frame int, object int, x1 long, x2 long, y long, logit double").repartition(3)
    found = masks.exclusive_boxes(rows, runs_of, 3).collect()
    assert len(found) == len(want) and set(map(tuple, found)) == want
    assert masks.exclusive_boxes(rows.filter("frame = 4"), runs_of).count() == 0


def test_one_shuffle_for_runs_of_masks(spark):
    rows = [(0, i, 5, i // 2, 4000 - i // 2, float(i)) for i in range(3000)]  # one inside the other, the inner surer
    found = masks.exclusive_runs(spark.createDataFrame(rows, "frame int, object int, y int, x1 int, x2 int, logit double"))
    assert plan_of(found).count("Exchange") == 1
    got = [(x, r.object) for r in found.collect() for x in range(r.x1, r.x2 + 1)]
    assert sorted(got) == [(x, min(2 * min(x, 4000 - x) + 1, 2999)) for x in range(4001)]


def test_names_of_frames_beyond_five_digits(spark, later_events):
    same_as_sql("a17_segment_ingest", spark, later_events)


def test_no_window_runs_to_the_end_of_its_partition(spark):
    from matchgrid.operators.ranges import carried
    from pyspark.sql import functions as F

    rows = spark.range(50).select(F.col("id").alias("frame"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    found = carried(rows, "frame", {"a": F.col("v")}, {"b": F.col("v")}, own=False)
    assert {(r.frame, r.a, r.b) for r in found.collect()} == {(i, (i - 1) // 7 * 7 if i else None, (i // 7 + 1) * 7 if i < 49 else None) for i in range(50)}
    large = [line for line in plan_of(found).splitlines() if "windowspecdefinition(_part#" in line and "frame#" in line]
    assert large and not any("unboundedfollowing" in line.lower() for line in large)


def test_tiles_of_neighbours_find_the_same_in_little_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    from matchgrid.operators import models

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 99, 3).astype(float).tolist(), int(i % 2 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, team int")
    whole = sorted(map(tuple, models.knn(df, df, "id", "v", "team", 3, True).collect()))
    monkeypatch.setattr(models, "TILE", 7)
    assert sorted(map(tuple, models.knn(df, df, "id", "v", "team", 3, True).collect())) == whole
    tasks = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append((self, run)) or self)
    models.nearest(df, df, "id", "v", "team", 3, True)
    monkeypatch.setattr(models, "TILE", 64)
    batches = tasks[0][0].toArrow().to_batches()
    tracemalloc.start()
    list(tasks[0][1](batches))
    assert tracemalloc.get_traced_memory()[1] < 1_200_000  # the distances of all with all alone are 300 * 300 * 8 bytes, several times over


def test_many_frames_in_few_blocks(spark):
    """A frame costs no call of its own, frames that are dealt over several batches stay whole."""
    import numpy as np

    from matchgrid.operators import matching as M

    rng = np.random.default_rng(7)
    n = 30_000
    pdf = {"key": rng.integers(0, 3000, n), "l": rng.integers(0, 6, n), "r": rng.integers(0, 6, n), "cost": rng.integers(0, 50, n) / 4}
    rows = [tuple(v.item() for v in row) for row in {r[:3]: r for r in zip(*pdf.values(), strict=True)}.values()]
    df = spark.createDataFrame(rows, "key long, l long, r long, cost double")
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for solver, choose in (("greedy", M.greedy), ("optimal", M.optimal)):
        found = {}
        for r in M.exclusive(df, "key", solver).collect():
            found.setdefault(r.key, []).append(tuple(r))
        for key, part in groups.items():
            _, l, r, cost = map(np.array, zip(*part, strict=True))
            taken = [part[i] for i in choose(cost, l, r)]
            mine = found[key]
            assert len({m[1] for m in mine}) == len({m[2] for m in mine}) == len(mine)
            if solver == "greedy":
                assert sorted(mine) == sorted(taken)
            else:
                assert len(mine) == len(taken) and abs(sum(m[3] for m in mine) - sum(t[3] for t in taken)) < 1e-9


def test_borders_of_players_on_one_spot(spark):
    from matchgrid.operators import regions

    sites = [(1, 1, 20.0, 30.0), (1, 3, 33.333, 44.111), (1, 16, 33.333, 44.111), (1, 9, 71.7, 12.3), (1, 4, 55.1, 61.9)]
    df = spark.createDataFrame(sites, "frame int, who int, x_pitch double, y_pitch double")
    found = regions.cells(df, "frame", "who")
    assert {r.who: r.area for r in found.collect()}[16] == 0
    assert all(16 not in (r.a_id, r.b_id) for r in regions.ridges(found, "frame", "who").collect())


def test_identity_documents_are_parsed_and_placed_once(spark):
    from matchgrid.operators import annotations as N

    docs = spark.createDataFrame([(1, '{"cuts":{"1":[5]}}'), (2, '{"names":{"1_5":"late"}}'), (3, '{"geom":{"2_1":[1,2,3,4]}}'), (4, '{"merges":[[[1,5],[2,0]]]}')], "seq int, doc string")
    rows = spark.createDataFrame([(f, t, 0.0, 0.0, 9.0, 9.0) for f in (2, 5, 7) for t in (1, 2)], "frame int, tid int, x1 double, y1 double, x2 double, y2 double")
    tables = N.edit_tables(docs, "doc", "seq")
    found = N.identified(rows, tables)
    assert not any("from_json" in plan_of(t) for t in (*tables.values(), found)) and "windowspecdefinition(tid#" not in plan_of(found)
    assert {(r.frame, r.tid): (r.cut, r.player_id, r.name, r.x1) for r in found.collect()} == {
        (2, 1): (0, 2, "", 1.0), (5, 1): (5, 1, "late", 0.0), (7, 1): (5, 1, "late", 0.0), (2, 2): (0, 1, "late", 0.0), (5, 2): (0, 1, "late", 0.0), (7, 2): (0, 1, "late", 0.0),
    }


def test_tracks_are_projected_once(spark, sf_dir):
    """No filter before the window works out the projection anew."""
    scans = plan_of(A.tracks(spark, sf_dir)).rsplit("Window", 1)[1]
    assert "Filter" not in scans or "round" not in scans.split("Filter", 1)[1].split("\n", 1)[0]
