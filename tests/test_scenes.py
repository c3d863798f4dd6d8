"""Shot cover, saved differences and click logs against plain Python."""

import math
import random

import pytest

from matchgrid.operators import clicks, cover, editlog

SHOT = "k long, ball_x double, ball_y double, goal_x double"
DEFENDER = "k long, who long, x_pitch double, y_pitch double"


def plain_cover(ball, goal_x, defenders):
    """Shares by counting 200,000 rays through the goal mouth."""
    depth = goal_x - ball[0] if goal_x > 50 else ball[0]
    low, high = math.atan2(30.34 - ball[1], depth), math.atan2(37.66 - ball[1], depth)
    line = lambda x: goal_x - x if goal_x > 50 else x
    keeper = min(defenders, key=lambda d: (line(d[1]) ** 2 + (d[2] - 34) ** 2, d[0]))[0] if defenders else None
    spans = {True: [], False: []}
    for who, x, y in defenders:
        ahead, aside = depth - line(x), y - ball[1]
        wide = 1.2 if who == keeper else 0.35
        far = math.hypot(ahead, aside)
        half = math.asin(wide / far) if far > wide else math.pi / 2
        mid = math.atan2(aside, ahead)
        if ahead > 0 and line(x) >= 0 and min(high, mid + half) > max(low, mid - half):
            spans[who == keeper].append((mid - half, mid + half))
    n = 200_000
    counts, widest, run = {"wall_only": 0, "keeper_only": 0, "both": 0, "open": 0}, 0, 0
    for i in range(n):
        a = low + (high - low) * (i + 0.5) / n
        w, k = (any(s <= a <= e for s, e in spans[side]) for side in (False, True))
        counts["both" if w and k else "wall_only" if w else "keeper_only" if k else "open"] += 1
        run = 0 if w or k else run + 1
        widest = max(widest, run)
    return {k: v / n for k, v in counts.items()}, math.degrees((high - low) * widest / n), len(spans[False])


def test_shot_cover_equals_counted_rays(spark):
    rng = random.Random(2)
    shots, defenders = [], []
    for k in range(12):
        goal_x = rng.choice([0.0, 105.0])
        away = rng.uniform(2, 35)
        ball = (abs(goal_x - away), rng.uniform(20, 48))
        shots.append((k, *ball, goal_x))
        for who in range(rng.choice([0, 1, 4, 9])):
            near = rng.uniform(-1, away + 2)
            defenders.append((k, who, abs(goal_x - near), rng.uniform(28, 40)))
    found = cover.shot_cover(spark.createDataFrame(shots, SHOT), spark.createDataFrame(defenders, DEFENDER), "k").collect()
    assert len(found) == len(shots)
    for r in found:
        _, x, y, goal_x = shots[r.k]
        shares, widest, wall = plain_cover((x, y), goal_x, [d[1:] for d in defenders if d[0] == r.k])
        for name, share in shares.items():
            assert abs(r[name] - share) < 1e-4, (r.k, name)
        assert abs(r.widest_gap - widest) < 1e-3 * r.goal_angle and r.n_wall == wall
        assert abs(r.wall_only + r.keeper_only + r.both + r.open - 1) < 1e-9 and -1 <= r.gap_place <= 1 + 1e-9


def test_a_man_on_the_ball_hides_everything_and_behind_the_line_is_no_shot(spark):
    shots = spark.createDataFrame([(1, 90.0, 34.0, 105.0), (2, 105.0, 34.0, 105.0), (3, 106.0, 30.0, 105.0)], SHOT)
    defenders = spark.createDataFrame([(1, 1, 90.1, 34.0), (1, 2, 104.9, 34.0), (2, 1, 100.0, 34.0)], DEFENDER)
    (row,) = cover.shot_cover(shots, defenders, "k").collect()
    assert row.k == 1 and abs(row.open) < 1e-12 and abs(row.widest_gap) < 1e-9 and row.both > 0
    assert cover.shot_cover(shots.limit(0), defenders, "k").collect() == []


BOX = "frame int, box_key int, x1 double, y1 double, x2 double, y2 double, group int"


def boxes_of(df):
    return {(r.frame, r.box_key): (r.x1, r.y1, r.x2, r.y2, r.group) for r in df.collect()}


def test_replaying_the_difference_gives_the_edited_boxes(spark, sf_dir):
    from matchgrid.plans.joins import base_boxes
    from matchgrid.sources import adapters as A

    base = base_boxes(spark, sf_dir)
    edited = editlog.replay(base, A.edits(spark, sf_dir))
    log = editlog.difference(base, edited)
    assert boxes_of(editlog.replay(base, log)) == boxes_of(edited)
    assert boxes_of(editlog.replay(base, editlog.difference(base, base))) == boxes_of(base)
    seqs = [r.seq for r in log.orderBy("frame", "box_key", "seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1))


LOG = "seq long, frame int, box_key int, action string, x1 double, y1 double, x2 double, y2 double, group int"


def test_reset_frames_show_their_detections_again(spark, sf_dir):
    from matchgrid.plans.joins import base_boxes
    from matchgrid.sources import adapters as A

    base, log = base_boxes(spark, sf_dir), A.edits(spark, sf_dir)
    before, was, now = boxes_of(base), boxes_of(editlog.replay(base, log)), boxes_of(editlog.replay(base, editlog.reset(log, base.filter("frame < 10"))))
    assert now == {k: v for k, v in before.items() if k[0] < 10} | {k: v for k, v in was.items() if k[0] >= 10 or k[0] not in {f for f, _ in before}}
    odd = spark.createDataFrame([(1, None, 1, "delete", *[None] * 4, 1), (2, 5, 1, "delete", *[None] * 4, 1)], LOG)
    assert [r.seq for r in editlog.reset(odd, spark.createDataFrame([(5,), (5,), (None,)], "frame int")).collect()] == [1]


def test_frames_detected_anew_have_the_new_boxes_only(spark, sf_dir):
    from matchgrid.plans.joins import base_boxes
    from matchgrid.plans.scenes import found_anew
    from matchgrid.sources import adapters as A

    base, log = base_boxes(spark, sf_dir), A.edits(spark, sf_dir)
    new = editlog.redetected(base, log, base, found_anew(base), 20)
    was, now = boxes_of(editlog.replay(base, log)), boxes_of(editlog.replay(base, new))
    assert {k: v for k, v in now.items() if k[0] < 20} == {k: v for k, v in was.items() if k[0] < 20}
    wanted = sorted((r.frame, r.place, *(round(r[c], 1) for c in editlog.BOX), r.group) for r in found_anew(base).filter("frame >= 20").collect() if r.x2 - r.x1 >= 2 and r.y2 - r.y1 >= 2)
    later = sorted(((k[0], -k[1], *v) for k, v in now.items() if k[0] >= 20))
    assert later == [(w[0], i, *w[2:]) for i, w in enumerate(wanted, 1)] and len(later) > 100


def test_detecting_anew_in_order(spark):
    base = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0, 1), (2, 1, 0.0, 0.0, 9.0, 9.0, 1), (2, 0, 0.0, 0.0, 9.0, 9.0, 2), (3, 0, 0.0, 0.0, 9.0, 9.0, 1), (4, 0, 0.0, 0.0, 9.0, 9.0, 1)], BOX)
    log = spark.createDataFrame([(7, 1, -1, "add", 0.0, 0.0, 9.0, 9.0, 1), (8, 2, 0, "delete", *[None] * 4, 1), (9, 4, 0, "delete", *[None] * 4, 1)], LOG)
    frames = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "frame int")
    found = spark.createDataFrame([(2, 1, 1.04, 0.0, 3.04, 2.0, 1), (2, 0, 5.0, 0.0, 6.9, 8.0, 1), (2, 2, 5.0, 5.0, 8.0, 8.0, 3), (1, 0, 0.0, 0.0, 9.0, 9.0, 1), (4, 0, 0.0, 0.0, 9.0, 9.0, 1), (None, 0, 0.0, 0.0, 9.0, 9.0, 1)], "frame int, place int, x1 double, y1 double, x2 double, y2 double, group int")
    rows = sorted(tuple(r) for r in editlog.redetected(base, log, frames, found, 2).select("seq", "frame", "box_key", "action", "x1", "group").collect())
    assert rows == [(7, 1, -1, "add", 0.0, 1), (8, 2, 0, "delete", None, 2), (9, 2, 1, "delete", None, 1), (10, 2, -1, "add", 1.0, 1), (11, 2, -2, "add", 5.0, 3), (12, 3, 0, "delete", None, 1)]
    empty = editlog.redetected(base.limit(0), log.limit(0), frames.limit(0), found.limit(0), 2)
    assert empty.count() == 0 and empty.columns == ["seq", "frame", "box_key", "action", *editlog.BOX, "group"]


def test_difference_logs_each_change_once_and_in_order(spark):
    base = [(1, 0, 10.0, 10.0, 20.0, 20.0, 1), (1, 1, 0.0, 0.0, 5.0, 5.0, 2), (1, 2, 1.0, 1.0, 2.0, 2.0, 1), (2, 0, 3.0, 3.0, 4.0, 4.0, 3)]
    edited = [(1, 0, 11.0, 10.0, 20.0, 20.0, 2), (1, 1, 0.0, 0.0, 5.04, 5.0, 2), (2, 0, 3.0, 3.0, 4.0, 4.0, 1), (2, -1, 7.26, 8.0, 9.0, 10.0, 3)]
    log = editlog.difference(spark.createDataFrame(base, BOX), spark.createDataFrame(edited, BOX)).orderBy("seq").collect()
    assert [(r.frame, r.box_key, r.action) for r in log] == [(1, 0, "reassign"), (1, 0, "move"), (1, 2, "delete"), (2, -1, "add"), (2, 0, "reassign")]
    assert log[0].x1 is None and log[1].x1 == 11.0 and log[2].group == 1 and log[3].x1 == 7.3


def plain_stack(actions):
    points, saved, ignored, idle, refused = [], None, 0, 0, 0
    for kind, x, y in actions:
        if kind == "click":
            if len(points) < 4:
                points = [*points, (x, y)]
            else:
                ignored += 1
        elif kind == "undo":
            idle += not points
            points = points[:-1]
        elif kind == "reset":
            points = []
        elif kind == "save":
            if len(points) == 4:
                saved = points
            else:
                refused += 1
    return points, saved, ignored, idle, refused


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_click_logs_equal_a_plain_stack(spark, stretch):
    rng = random.Random(stretch)
    logs = {s: [(rng.choices(["click", "undo", "reset", "save", "zoom", None], [9, 4, 1, 3, 1, 1])[0], float(i), float(s)) for i in range(rng.choice([1, 5, 40]))] for s in range(25)}
    rows = [(s, i, *a) for s, log in logs.items() for i, a in enumerate(log)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session long, seq long, action string, x double, y double")
    found = clicks.point_stacks(df, "session", "seq", stretch=stretch).collect()
    assert len(found) == len(logs)
    for r in found:
        points, saved, *counts = plain_stack(logs[r.session])
        assert [tuple(p) for p in r.points] == points and [r.ignored, r.idle, r.refused] == counts and r.actions == len(logs[r.session])
        assert (r.saved and [tuple(p) for p in r.saved]) == saved
