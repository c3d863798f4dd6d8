"""Pairs of boxes, tracks and fragments: theta joins behind an equi-join on the frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators.blocks import CELLS, Padded, blocks, in_groups, numbers
from matchgrid.operators.temporal import range_join


def prefixed(df: DataFrame, prefix: str, columns: list[str]) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def near_any(left: DataFrame, right: DataFrame, key: str, tolerance: float, own: str) -> DataFrame:
    """Rows of ``left`` with a foot of another row of ``right`` within the tolerance (inclusive)."""
    b = right.select(key, *prefixed(right, "_", ["foot_x", "foot_y", own]))
    close = G.squared(left["foot_x"], left["foot_y"], b["_foot_x"], b["_foot_y"]) <= tolerance * tolerance
    return left.join(b, (left[key] == b[key]) & (left[own] != b[f"_{own}"]) & close, "left_semi")


def close_pairs(rows: DataFrame, key: str, own: str, limit: float) -> DataFrame:
    """(key, a_id, b_id, d2): pairs of a frame nearer than ``limit`` (exclusive) on the pitch."""
    fields = [own, "x_pitch", "y_pitch"]
    a, b = rows.select(key, *prefixed(rows, "a_", fields)), rows.select(key, *prefixed(rows, "b_", fields))
    d2 = G.squared(F.col("a_x_pitch"), F.col("a_y_pitch"), F.col("b_x_pitch"), F.col("b_y_pitch"))
    found = a.join(b, key).filter((F.col(f"a_{own}") < F.col(f"b_{own}")) & (d2 < limit * limit))
    return found.select(key, F.col(f"a_{own}").alias("a_id"), F.col(f"b_{own}").alias("b_id"), d2.alias("d2"))


def overlapping(rows: DataFrame, key: str, own: str, least: float) -> DataFrame:
    """(key, a_id, b_id, ratio): boxes of a frame whose overlap exceeds ``least``."""
    fields = [own, "x1", "y1", "x2", "y2"]
    a, b = rows.select(key, *prefixed(rows, "a_", fields)), rows.select(key, *prefixed(rows, "b_", fields))
    found = a.join(b, key).filter(F.col(f"a_{own}") < F.col(f"b_{own}")).withColumn("ratio", G.overlap("a_", "b_"))
    return found.filter(F.col("ratio") > least).select(key, F.col(f"a_{own}").alias("a_id"), F.col(f"b_{own}").alias("b_id"), "ratio")


def fragments(tracks: DataFrame, gap: int) -> DataFrame:
    """``tracks`` with ``unit``: a new one wherever a player's frames are more than ``gap`` apart."""
    order = Window.partitionBy("player_id").orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(order) > gap, 1).otherwise(0)
    return tracks.withColumn("_new", new).withColumn("unit", F.col("player_id").cast("long") * 1_000_000_000 + F.sum("_new").over(order)).drop("_new")


def units(rows: DataFrame) -> DataFrame:
    """One row per fragment: extent, end points and team of its first row."""
    return rows.groupBy("unit").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), F.min_by("x_pitch", "frame").alias("sx"), F.min_by("y_pitch", "frame").alias("sy"),
        F.max_by("x_pitch", "frame").alias("ex"), F.max_by("y_pitch", "frame").alias("ey"), F.min_by("team", "frame").alias("team"),
    )


def same_team(a: str, b: str):
    """Teams that do not contradict each other: equal ones, or one that is not known."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return blank(a) | blank(b) | (F.col(a) == F.col(b))


def merge_candidates(unit: DataFrame, max_gap: int = 72, max_distance: float = 14.0, max_predicted: float = 10.0, max_speed: float = 9.0, fps: float = 24.0) -> DataFrame:
    """(a_id, b_id, gap, end_dist, pred_dist, speed, score): a fragment and one that begins soon after, where it may have gone on.

    ``unit`` has also the velocities at both ends (vx0, vy0, vx1, vy1). As b begins after a ends, they share no frame.
    """
    a = unit.select(*prefixed(unit, "a_", ["unit", "last", "ex", "ey", "vx1", "vy1", "team"]))
    b = unit.select(*prefixed(unit, "b_", ["unit", "first", "sx", "sy", "vx0", "vy0", "team"]))
    c, gap = F.col, F.col("b_first") - F.col("a_last")
    found = range_join(a, b, "a_last", "b_first", 1, max_gap, same_team("a_team", "b_team") & (c("a_unit") != c("b_unit")))
    found = found.withColumn("end_dist", G.distance(c("a_ex"), c("a_ey"), c("b_sx"), c("b_sy"))).filter(c("end_dist") <= max_distance)
    at = [F.greatest(F.lit(0.0), F.least(F.lit(most), c(f"a_e{k}") + c(f"a_v{k}1") * gap)) for k, most in (("x", G.LENGTH), ("y", G.WIDTH))]
    found = found.withColumns({"pred_dist": G.distance(*at, c("b_sx"), c("b_sy")), "speed": c("end_dist") / F.greatest(gap / fps, F.lit(1 / fps))})
    turn = G.distance(c("a_vx1"), c("a_vy1"), c("b_vx0"), c("b_vy0")) * fps
    score = c("pred_dist") + c("end_dist") * 0.35 + gap * 0.04 + turn * 0.18
    good = found.filter((c("pred_dist") <= max_predicted) & (c("speed") <= max_speed))
    return good.select(c("a_unit").alias("a_id"), c("b_unit").alias("b_id"), gap.alias("gap"), "end_dist", "pred_dist", "speed", score.alias("score"))


def best_of_grid(sites: DataFrame, key: str, own: str, columns: int, rows: int, at, score) -> DataFrame:
    """(key, px, py, site, value): for every cell of a grid the ``own`` of the key's row with the least score, the smallest one on a tie.

    ``sites`` has key, own, x and y; those without a place do not count. ``at`` makes places of numbers of columns and of rows, ``score``
    is of the differences in x and y. A key's rows meet its cells in one array.
    """
    cells = columns * rows
    px, py = np.tile(np.arange(columns, dtype=np.int32), rows), np.repeat(np.arange(rows, dtype=np.int32), columns)
    cx, cy = (v.astype(float)[:, None] for v in at(px, py))

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        place, sites_, values = [numbers(table, c) for c in ("x", "y")], [], []
        for first, last in blocks(starts, table.num_rows, most=CELLS // cells):
            pad = Padded(starts, table.num_rows, first, last)
            x, y = (pad.of(v)[:, None, :] for v in place)
            found = score(cx - x, cy - y)
            found[np.isnan(found)] = np.inf
            best = found.argmin(2)  # rows are in the order of own
            values.append(np.take_along_axis(found, best[:, :, None], 2).ravel())
            sites_.append(np.take_along_axis(pad.at, best, 1).ravel())
        n = len(starts)
        keys, site = table.column(key).take(np.repeat(starts, cells)), table.column(own).take(np.concatenate(sites_))
        return pa.table([keys, np.tile(px, n), np.tile(py, n), site, np.concatenate(values)], [key, "px", "py", "site", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    known = sites.select(key, own, "x", "y").dropna(subset=["x", "y"])
    return in_groups(known, [key], [own], work, f"{key} {kinds[key]}, px int, py int, site {kinds[own]}, value double")


def nearest_site(sites: DataFrame, own: str, columns: int, rows: int, step_x: float, step_y: float) -> DataFrame:
    """(frame, px, py, site): the nearest of a frame's players for every cell of a grid, in every frame."""
    placed = sites.select("frame", own, F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))
    found = best_of_grid(placed, "frame", own, columns, rows, lambda px, py: (px * step_x, py * step_y), lambda dx, dy: dx * dx + dy * dy)
    return found.drop("value")


def shared_frames(tracks: DataFrame, own: str, limit: float) -> DataFrame:
    """(a_id, b_id, shared, mean, verdict): pairs that occur in the same frames and their mean distance."""
    fields = [own, "x_pitch", "y_pitch"]
    a, b = tracks.select("frame", *prefixed(tracks, "a_", fields)), tracks.select("frame", *prefixed(tracks, "b_", fields))
    d = G.distance(F.col("a_x_pitch"), F.col("a_y_pitch"), F.col("b_x_pitch"), F.col("b_y_pitch"))
    pairs = a.join(b, "frame").filter(F.col(f"a_{own}") < F.col(f"b_{own}"))
    found = pairs.groupBy(F.col(f"a_{own}").alias("a_id"), F.col(f"b_{own}").alias("b_id")).agg(F.count("*").alias("shared"), F.avg(d).alias("mean"))
    return found.withColumn("verdict", F.when(F.col("mean") <= limit, "duplicate").otherwise("different person"))


def starts(tracks: DataFrame) -> DataFrame:
    """Rows of players that are absent in the frame before."""
    before = F.lag("frame").over(Window.partitionBy("player_id").orderBy("frame"))
    return tracks.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col("frame") - 1)).drop("_before")


def next_starts(tracks: DataFrame, reach: int, scale: float = 1.0) -> DataFrame:
    """(player_id, team, next_id): the cheapest start of another player of the team soon after each end.

    The cost is the distance of the feet in the image, over its ``scale``, and 2 for every frame between; the earlier frame comes first on a tie.
    """
    ends = tracks.groupBy("player_id", "team").agg(F.max("frame").alias("last"), F.max_by("foot_x", "frame").alias("x"), F.max_by("foot_y", "frame").alias("y"))
    begin = starts(tracks).select(F.col("player_id").alias("s_id"), F.col("team").alias("s_team"), F.col("frame").alias("s_frame"), F.col("foot_x").alias("sx"), F.col("foot_y").alias("sy"))
    same = (F.col("team") == F.col("s_team")) & (F.col("player_id") != F.col("s_id"))
    found = range_join(ends, begin, "last", "s_frame", 1, reach, same)
    cost = F.round(G.distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) / scale + 2 * (F.col("s_frame") - F.col("last")), 6)
    return found.groupBy("player_id", "team").agg(F.min_by("s_id", F.struct(cost, "s_frame", "s_id")).alias("next_id"))


def duplicate_pairs(rows: DataFrame, own: str, limit: float = 2.0, least: int = 3) -> DataFrame:
    """(a_id, b_id, n, mean): fragments nearer than ``limit`` in at least ``least`` shared frames, with the mean distance there."""
    d = F.sqrt("d2")
    near = close_pairs(rows, "frame", own, limit).groupBy("a_id", "b_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean"))
    return near.filter((F.col("n") >= least) & (F.col("mean") < limit))


def in_betweens(rows: DataFrame, following: DataFrame, steps: int) -> DataFrame:
    """(player_id, frame, k, x, y): positions at k / steps on the way to the next frame; held if there is none."""
    b = following.select("player_id", (F.col("frame") - 1).alias("frame"), F.col("x_pitch").alias("bx"), F.col("y_pitch").alias("by"))
    joined = rows.join(b, ["player_id", "frame"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = lambda a, b: G.lerp(F.col(a), F.coalesce(b, a), F.col("k") / float(steps))
    return joined.select("player_id", "frame", "k", at("x_pitch", "bx").alias("x"), at("y_pitch", "by").alias("y"))
