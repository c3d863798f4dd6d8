"""Exclusive matching and tracking: greedy and optimal, one group at a time.

Matchings are keyed by frame and trackers by clip. Candidate pairs come from
plain joins; only the sequential choice within a group runs in Python, on blocks
of whole frames or a clip's detections in frame order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators.blocks import Padded, blocks, in_groups, numbers


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, distance: Column, tolerance: float, penalty: Column | None = None) -> DataFrame:
    """(key, l, r, cost) of pairs at a distance within the tolerance (inclusive); a penalty counts for the order only.

    ``left`` has key, l and its point lx, ly; ``right`` key, r, rx, ry.
    """
    cost = distance if penalty is None else distance + penalty
    return left.join(right, key).filter(distance <= tolerance).select(key, "l", "r", cost.alias("cost"))


def foot_distance() -> Column:
    return G.distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))


def greedy(cost: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of the pairs taken in the order of (cost, left, right), each side once."""
    taken, used_l, used_r = [], set(), set()
    for i in np.lexsort((right, left, cost)).tolist():
        a, b = left[i], right[i]
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            taken.append(i)
    return taken


def optimal(cost: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of the pairs of a matching of most pairs with the least total cost.

    Shortest augmenting paths with potentials over a square matrix; missing
    pairs cost more than all others together.
    """
    ls, rs = np.unique(left), np.unique(right)
    n = max(len(ls), len(rs))
    far = float(cost.sum()) + 1.0 if len(cost) else 1.0
    matrix, index = np.full((n, n), far), {}
    for i, (a, b) in enumerate(zip(np.searchsorted(ls, left), np.searchsorted(rs, right), strict=True)):
        if cost[i] < matrix[a, b]:
            matrix[a, b], index[a, b] = cost[i], i
    row_price, column_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for row in range(n):
        best, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        at, column = row, -1
        while True:
            reduced = matrix[at] - row_price[at] - column_price
            base = 0.0 if column < 0 else best[column]
            better = ~done & (base + reduced < best)
            best[better], came[better] = base + reduced[better], column
            column = int(np.where(done, np.inf, best).argmin())
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        reach = best[column]
        for c in np.flatnonzero(done):
            if c != column:
                row_price[owner[c]] += reach - best[c]
                column_price[c] -= reach - best[c]
        row_price[row] += reach
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    return [index[r, c] for c, r in enumerate(owner.tolist()) if (r, c) in index]


def ranked(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, equal ones for equal values."""
    return np.unique(values.to_numpy(), return_inverse=True)[1].astype(np.int64)


def greedy_in_groups(group: np.ndarray, cost: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What greedy() takes of each group, for many groups at once.

    A pair that comes before all others of both its sides is taken; without the pairs of these sides there are next ones, until none is left.
    """
    order = np.lexsort((right, left, cost, group))
    # Sides of different groups are different ones.
    l, r = (np.unique(group[order] * (side.max(initial=0) + 1) + side[order], return_inverse=True)[1] for side in (left, right))
    rest, taken = np.arange(len(order)), []
    while len(rest):
        a, b = l[rest], r[rest]
        first_l, first_r = np.full(l.max() + 1, len(order)), np.full(r.max() + 1, len(order))
        first_l[a[::-1]], first_r[b[::-1]] = rest[::-1], rest[::-1]  # the last one written, the first in the order, stays
        good = (first_l[a] == rest) & (first_r[b] == rest)
        taken.append(rest[good])
        used_l, used_r = np.zeros(l.max() + 1, bool), np.zeros(r.max() + 1, bool)
        used_l[a[good]], used_r[b[good]] = True, True
        rest = rest[~used_l[a] & ~used_r[b]]
    return order[np.concatenate(taken)] if taken else order


def optimal_in_groups(group: np.ndarray, cost: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What optimal() takes of each group, solved apart for each set of pairs that are connected by common sides."""
    l, r = (np.unique(group * (side.max(initial=0) + 1) + side, return_inverse=True)[1] for side in (left, right))
    label = np.arange(len(cost))
    while len(cost):
        least_l, least_r = np.full(l.max() + 1, len(cost)), np.full(r.max() + 1, len(cost))
        np.minimum.at(least_l, l, label)
        np.minimum.at(least_r, r, label)
        now = np.minimum(least_l[l], least_r[r])
        if (now == label).all():
            break
        label = now
    order = np.argsort(label, kind="stable")
    begins = np.flatnonzero(np.diff(label[order], prepend=-1))
    sizes = np.diff(begins, append=len(order))
    taken = order[begins[sizes == 1]].tolist()
    for begin, size in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        part = order[begin : begin + size]
        taken += part[optimal(cost[part], left[part], right[part])].tolist()
    return np.array(taken, np.int64)


def exclusive(pairs: DataFrame, key: str, solver: str = "greedy") -> DataFrame:
    """``pairs`` (key, l, r, cost) cut down to a one-to-one matching per key."""
    choose = optimal_in_groups if solver == "optimal" else greedy_in_groups

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=table.num_rows))
        return table.take(np.sort(choose(group, numbers(table, "cost"), ranked(table.column("l")), ranked(table.column("r")))))

    return in_groups(pairs, [key], [], work, pairs.schema)


def with_unmatched(matched: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A full outer matching: both sides' unmatched rows with a null partner."""
    only_left = left.select(key, "l").join(matched.select(key, "l"), [key, "l"], "left_anti")
    only_right = right.select(key, "r").join(matched.select(key, "r"), [key, "r"], "left_anti")
    return matched.select(key, "l", "r", "cost").unionByName(only_left, True).unionByName(only_right, True)


def suppressed(boxes: DataFrame, key: str, own: str, limit: float) -> DataFrame:
    """Greedy non-maximum suppression: by area, a box stays if it overlaps no kept one by more than ``limit``."""

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        corners, found = [numbers(table, c) for c in ("x1", "y1", "x2", "y2")], []
        for first, last in blocks(starts, table.num_rows):
            pad = Padded(starts, table.num_rows, first, last)
            x1, y1, x2, y2 = map(pad.of, corners)
            order = np.argsort(-(x2 - x1) * (y2 - y1), axis=1, kind="stable")  # rows are in the order of own, empty cells are last
            x1, y1, x2, y2 = (np.take_along_axis(v, order, 1) for v in (x1, y1, x2, y2))
            area, own_ = (x2 - x1) * (y2 - y1), np.take_along_axis(pad.own, order, 1)
            kept = np.zeros(own_.shape, bool)
            for i in range(own_.shape[1]):
                w = np.minimum(x2[:, i, None], x2[:, :i]) - np.maximum(x1[:, i, None], x1[:, :i])
                h = np.minimum(y2[:, i, None], y2[:, :i]) - np.maximum(y1[:, i, None], y1[:, :i])
                both = np.maximum(w, 0) * np.maximum(h, 0)
                kept[:, i] = own_[:, i] & ~(kept[:, :i] & (both > limit * np.minimum(area[:, i, None], area[:, :i]))).any(1)
            found.append(np.take_along_axis(pad.at, order, 1)[kept])
        return table.take(np.concatenate(found))

    return in_groups(boxes, [key], [own], work, boxes.schema)


class NearestTracker:
    """Greedy tracking box by box: the nearest live track not yet used in the frame, else a new one."""

    def __init__(self, max_distance: float, max_missed: int):
        self.max_distance, self.max_missed = max_distance, max_missed
        self.tracks: dict[int, tuple[float, float, int]] = {}
        self.next_id = 1

    def frame(self, frame: int, points: list[tuple[float, float]]) -> list[tuple[int, float | None]]:
        """Track id and distance of each detection, in order; tracks out of reach are forgotten."""
        self.tracks = {t: p for t, p in self.tracks.items() if frame - p[2] <= self.max_missed + 1}
        out, used = [], set()
        for x, y in points:
            best = None
            for t, (px, py, _) in self.tracks.items():  # in the order of their ids
                if t not in used:
                    d = ((x - px) ** 2 + (y - py) ** 2) ** 0.5
                    if d < self.max_distance and (best is None or d < best[1]):
                        best = (t, d)
            if best is None:
                best = (self.next_id, None)
                self.next_id += 1
            used.add(best[0])
            self.tracks[best[0]] = (x, y, frame)
            out.append(best)
        return out


class VelocityTracker:
    """Greedy tracking by predicted position, within a team, over all pairs of a frame."""

    def __init__(self, reach: float = 7.0, max_gap: int = 5):
        self.reach, self.max_gap = reach, max_gap
        self.tracks: dict[int, tuple] = {}  # team, last (x, y, frame), one before
        self.next_id = 0

    def frame(self, frame: int, points: list[tuple[str, float, float]]) -> list[int]:
        self.tracks = {t: v for t, v in self.tracks.items() if frame - v[1][2] <= self.max_gap}
        cost, left, right = [], [], []
        for t, (team, (x, y, at), before) in self.tracks.items():
            if before is not None:
                span = max(1, at - before[2])
                x, y = x + (x - before[0]) / span * (frame - at), y + (y - before[1]) / span * (frame - at)
            for i, (own, px, py) in enumerate(points):
                d = ((x - px) ** 2 + (y - py) ** 2) ** 0.5
                if own == team and d <= self.reach:
                    cost.append(d)
                    left.append(t)
                    right.append(i)
        found = {right[i]: left[i] for i in greedy(np.array(cost), np.array(left), np.array(right))}
        out = []
        for i, (team, x, y) in enumerate(points):
            t = found.get(i)
            if t is None:
                t = self.next_id
                self.next_id += 1
            self.tracks[t] = (team, (x, y, frame), self.tracks[t][1] if t in self.tracks else None)
            out.append(t)
        return out


def frames_of(rows: pd.DataFrame, order: str) -> Iterator[tuple[int, pd.DataFrame]]:
    for frame, part in rows.sort_values(["frame", order], kind="stable").groupby("frame", sort=True):
        yield int(frame), part


def track_nearest(detections: DataFrame, clip: str, order: str, max_distance: float = 90.0, max_missed: int = 4) -> DataFrame:
    """(clip, frame, order, track_id, track_distance) per clip; state runs through a clip's frames."""
    kind = dict(detections.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        tracker, out = NearestTracker(max_distance, max_missed), []
        for frame, part in frames_of(group, order):
            ids = tracker.frame(frame, list(zip(part.foot_x, part.foot_y, strict=True)))
            out.append(part.assign(track_id=[i for i, _ in ids], track_distance=np.array([d for _, d in ids], float)))
        return pd.concat(out)[[clip, "frame", order, "track_id", "track_distance"]]

    schema = f"{clip} {kind[clip]}, frame {kind['frame']}, {order} {kind[order]}, track_id long, track_distance double"
    return detections.select(clip, "frame", order, "foot_x", "foot_y").groupBy(clip).applyInPandas(one, schema)


def track_velocity(positions: DataFrame, clip: str, order: str, reach: float = 7.0, max_gap: int = 5) -> DataFrame:
    """(clip, frame, order, track_id) per clip, by predicted pitch position within a team."""
    kind = dict(positions.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        tracker, out = VelocityTracker(reach, max_gap), []
        for frame, part in frames_of(group, order):
            out.append(part.assign(track_id=tracker.frame(frame, list(zip(part.team, part.x_pitch, part.y_pitch, strict=True)))))
        return pd.concat(out)[[clip, "frame", order, "track_id"]]

    schema = f"{clip} {kind[clip]}, frame {kind['frame']}, {order} {kind[order]}, track_id long"
    return positions.select(clip, "frame", order, "team", "x_pitch", "y_pitch").groupBy(clip).applyInPandas(one, schema)


def chain_merges(units: DataFrame, clip: str, max_gap: int = 30, max_distance: float = 8.0) -> DataFrame:
    """(clip, a, b): greedy chains of fragments, in the order of their first frames.

    Each fragment takes as successor the cheapest later one that has no
    predecessor yet (distance + 0.1 a frame of gap), of its team or where either
    team is blank, and of another component. ``units`` may name the component that
    fragments have been merged to before (``component``); else each is its own.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        u = group.sort_values(["first", "unit"], kind="stable").reset_index(drop=True)
        team = u["team"].fillna("").to_numpy(str)
        unit, first, last, sx, sy, ex, ey = (u[c].to_numpy() for c in ("unit", "first", "last", "sx", "sy", "ex", "ey"))
        free, out, root = np.ones(len(u), bool), [], u["component" if "component" in u else "unit"].to_numpy(copy=True)
        lows, highs = np.searchsorted(first, last + 1), np.searchsorted(first, last + max_gap, "right")
        for i in range(len(u)):
            near = slice(lows[i], highs[i])  # first is in order, so these are all with a gap from 1 to max_gap
            gap, d = first[near] - last[i], np.hypot(sx[near] - ex[i], sy[near] - ey[i])
            own = (team[near] == team[i]) | (team[near] == "") | (team[i] == "")
            good = (d <= max_distance) & own & free[near] & (root[near] != root[i])
            if good.any():
                j = int(np.where(good, d + 0.1 * gap, np.inf).argmin()) + int(lows[i])
                free[j] = False
                root[root == root[j]] = root[i]
                out.append((u[clip][i], unit[i], unit[j]))
        return pd.DataFrame(out, columns=[clip, "a", "b"])

    kind = dict(units.dtypes)
    return units.groupBy(clip).applyInPandas(one, f"{clip} {kind[clip]}, a long, b long")
