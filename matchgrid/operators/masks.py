"""Exclusive object masks from overlapping run-length encoded ones.

The borders of all runs of a line cut it into stretches inside which no run begins or ends; each stretch has one winner, the run with the largest
logit, on a tie that of the smallest object.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators.blocks import blocks, in_groups

#: Shapes whose runs are made at once; more if a frame has more.
SHAPES = 400


def places(*values: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The values counted from their smallest, or their ranks if they lie far apart, and a number above all of them."""
    low, high = min(int(v.min()) for v in values), max(int(v.max()) for v in values)
    if high - low < 1 << 20:
        return [v - low for v in values], high - low + 1
    found, ranks = np.unique(np.concatenate(values), return_inverse=True)
    return np.split(ranks, len(values)), len(found)


def stretches(group: np.ndarray, thing: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, x1, x2, follows) of all stretches with a winner, by group, y and x: the winning run, its part of the line, and whether the stretch before ends at this one."""
    if not len(y):
        return y, x1, x2, y > 0
    weak = np.lexsort((-thing, logit))
    rank = np.empty(len(weak), np.int64)
    rank[weak] = np.arange(len(weak))
    (line,), height = places(y)
    (left, right), width = places(x1, x2 + 1)
    line = (group * height + line) * width
    cuts, at = np.unique(np.concatenate([line + left, line + right]), return_inverse=True)
    first, last = np.split(at, 2)
    # A run covers two ranges of 2^n stretches; from the longest on, the best of a range goes over to its two halves.
    power = np.frexp(last - first)[1] - 1
    best = np.full(len(cuts), -1)
    for n in range(int(power.max()), -1, -1):
        half = 1 << n
        best[half:] = np.maximum(best[half:], best[:-half])
        now = np.flatnonzero(power == n)
        np.maximum.at(best, first[now], rank[now])
        np.maximum.at(best, last[now] - half, rank[now])
    won = np.flatnonzero(best >= 0)
    place = np.empty(len(cuts), np.int64)
    place[first], place[last] = x1, x2 + 1
    return weak[best[won]], place[won], place[won + 1] - 1, np.diff(won, prepend=-2) == 1


def exclusive_runs(runs: DataFrame) -> DataFrame:
    """(frame, y, object, x1, x2): runs in which every pixel belongs to one object, the one with the largest logit.

    ``runs`` has frame, object (an integer), y, x1, x2 (inclusive) and logit; pixels whose largest logit is not positive belong to no object, on a tie the
    smallest object has the pixel. Neighbouring stretches of one object are joined. The runs of a line go through one task.
    """
    kinds = dict(runs.dtypes)

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=table.num_rows))
        thing, y, x1, x2 = (table.column(c).to_numpy().astype(np.int64) for c in ("object", "y", "x1", "x2"))
        row, x1, x2, follows = stretches(group, thing, y, x1, x2, table.column("logit").to_numpy())
        new = np.flatnonzero(~(follows & (np.diff(thing[row], prepend=0) == 0)))
        found = table.select(["frame", "y", "object"]).take(row[new])
        for name, values in (("x1", x1[new]), ("x2", x2[np.append(new[1:], len(row)) - 1])):
            found = found.append_column(name, pa.array(values).cast(table.schema.field(name).type))
        return found

    there = (F.col("logit") > 0) & (F.col("x2") >= F.col("x1")) & F.col("frame").isNotNull() & F.col("y").isNotNull()
    rows = runs.filter(there).select("frame", "y", "object", "x1", "x2", "logit")
    return in_groups(rows, ["frame", "y"], [], work, ", ".join(f"{c} {kinds[c]}" for c in ("frame", "y", "object", "x1", "x2")))


def mask_boxes(runs: DataFrame, least: int = 10) -> DataFrame:
    """(frame, object, x1, y1, x2, y2, pixels): the extents of exclusive runs; objects with fewer than ``least`` pixels are left out."""
    found = runs.groupBy("frame", "object").agg(
        F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2"), F.sum(F.col("x2") - F.col("x1") + 1).alias("pixels"),
    )
    return found.filter(F.col("pixels") >= least)


def exclusive_boxes(shapes: DataFrame, runs_of: Callable[[pa.Table], tuple[np.ndarray, ...]], least: int = 10) -> DataFrame:
    """mask_boxes() of the exclusive runs of ``shapes``, which are shuffled once by frame in place of their runs.

    ``shapes`` has frame, object (an integer) and what ``runs_of`` makes runs of: it gets a table of shapes and returns the arrays (row of the
    table, y, x1, x2, logit). Runs are made for some whole frames at a time in the task that gives the extents, so none of them is written or shuffled.
    """
    kinds = dict(shapes.dtypes)

    def extents(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        row, *run = runs_of(table)
        live = (run[3] > 0) & (run[2] >= run[1])
        row, *run = (v[live] for v in (row, *run))
        thing = table.column("object").to_numpy().astype(np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=table.num_rows))
        won, x1, x2, _ = stretches(group[row], thing[row], *run)
        (thing,), things = places(thing)
        order = np.argsort((group * things + thing)[row[won]], kind="stable")
        won, x1, x2 = won[order], x1[order], x2[order]
        row, y = row[won], run[0][won]
        first = np.flatnonzero(np.diff((group * things + thing)[row], prepend=-1))
        found = [np.minimum.reduceat(x1, first), np.minimum.reduceat(y, first), np.maximum.reduceat(x2, first), np.maximum.reduceat(y, first), np.add.reduceat(x2 - x1 + 1, first)]
        keep = found[-1] >= least
        return row[first[keep]], *(v[keep] for v in found)

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        total, found = table.num_rows, []
        for first, last in blocks(starts, total, 1, SHAPES):
            begin, end = int(starts[first]), int(starts[last]) if last < len(starts) else total
            row, *values = extents(table.slice(begin, end - begin), starts[first:last] - begin)
            found.append([row + begin, *values])
        row, *values = map(np.concatenate, zip(*found, strict=True))
        boxes = table.select(["frame", "object"]).take(row)
        for name, v in zip(("x1", "y1", "x2", "y2"), values, strict=False):
            boxes = boxes.append_column(name, pa.array(v))
        return boxes.append_column("pixels", pa.array(values[4]))

    return in_groups(shapes, ["frame"], [], work, f"frame {kinds['frame']}, object {kinds['object']}, x1 long, y1 long, x2 long, y2 long, pixels long")
