"""Whose part of the pitch it is: exact nearest-player cells, their borders, and who arrives first.

A border between two players of a frame is the stretch of their middle line on which no other player is nearer: every other player and
every side of the pitch bounds it by a linear inequality. The sides of a cell are such stretches, and those of the pitch's own sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G
from matchgrid.operators.blocks import CELLS, Padded, blocks, half_up, in_groups, numbers
from matchgrid.operators.pairs import best_of_grid

#: Sides of the pitch have negative numbers; a point and the direction of each, and what lies inside: sx * x + sy * y + c >= 0.
SIDES = (-1, -2, -3, -4)
SIDE_LINES = ((0.0, 0.0, 1.0, 0.0), (G.LENGTH, 0.0, 0.0, 1.0), (0.0, G.WIDTH, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))
INSIDE = ((1.0, 0.0, 0.0), (-1.0, 0.0, G.LENGTH), (0.0, 1.0, 0.0), (0.0, -1.0, G.WIDTH))
CELL = "array<struct<by:bigint,ax:double,ay:double,bx:double,by_:double,length:double>>"


def with_sides(players: np.ndarray, sides: list[float]) -> np.ndarray:
    """Something of the lines towards all players (frame, i, j), with that of the four sides behind."""
    return np.concatenate([players, np.broadcast_to(np.array(sides), (*players.shape[:2], 4))], 2)


def borders(x: np.ndarray, y: np.ndarray, i: slice) -> tuple[np.ndarray, ...]:
    """(ax, ay, bx, by, length, distance from i), each (frame, i, j), of the borders of the players ``i`` with every player and side; NaN where there is none.

    ``x``, ``y`` are (frame, player), NaN for no player.
    """
    n, xi, yi = x.shape[1], x[:, i, None], y[:, i, None]
    xj, yj = x[:, None, :], y[:, None, :]
    mx, my, ux, uy = (with_sides(v, [line[c] for line in SIDE_LINES]) for c, v in enumerate(((xi + xj) / 2, (yi + yj) / 2, yi - yj, xj - xi)))
    size = np.sqrt((xi - xj) * (xi - xj) + (yi - yj) * (yi - yj))
    far = np.concatenate([size / 2, np.abs((xi - mx[:, :, n:]) * uy[:, :, n:] - (yi - my[:, :, n:]) * ux[:, :, n:])], 2)
    size = with_sides(size, [1.0] * 4)
    low, high, never = np.full(mx.shape, -np.inf), np.full(mx.shape, np.inf), np.zeros(mx.shape, bool)

    def bound(a: np.ndarray, b: np.ndarray, also: np.ndarray | bool = True) -> None:
        t = -b / a
        np.maximum(low, np.where((a > 1e-9) & also, t, -np.inf).max(3), out=low)
        np.minimum(high, np.where((a < -1e-9) & also, t, np.inf).min(3), out=high)
        np.logical_or(never, ((np.abs(a) <= 1e-9) & (b < -1e-6) & also).any(3), out=never)

    line = [v[..., None] for v in (mx, my, ux, uy)]
    qx, qy, kx, ky = xi[..., None], yi[..., None], x[:, None, None, :], y[:, None, None, :]
    me, j, k = np.arange(n)[i][:, None, None], np.arange(n + 4)[:, None], np.arange(n)
    bound(2 * (line[2] * (qx - kx) + line[3] * (qy - ky)), 2 * (line[0] * (qx - kx) + line[1] * (qy - ky)) + kx * kx + ky * ky - qx * qx - qy * qy, (k != me) & (k != j))
    sx, sy, c = np.array(INSIDE).T
    bound(line[2] * sx + line[3] * sy, line[0] * sx + line[1] * sy + c)
    there = (high > low) & ~never & ~np.isnan(mx) & ~np.isnan(xi) & (np.arange(n + 4) != np.arange(n)[i][:, None])
    low, high = np.where(there, low, np.nan), np.where(there, high, np.nan)
    return mx + ux * low, my + uy * low, mx + ux * high, my + uy * high, (high - low) * size, far


def cells(sites: DataFrame, key: str, own: str) -> DataFrame:
    """(key, own, x, y, cell, area): the part of the pitch nearer to each player than to all others of the frame.

    ``sites`` has key, own (integer, unique in a frame), x_pitch and y_pitch. Of players on one spot the smallest ``own`` has the cell, the others have none. A cell is
    its sides, in no order; ``by`` is the player beyond, or negative for a side of the pitch.
    """

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        total, names, found, area = table.num_rows, table.column(own).to_numpy(), [], np.zeros(table.num_rows)
        place = [numbers(table, c) for c in ("x", "y")]
        for first, last in blocks(starts, total, 3):
            pad = Padded(starts, total, first, last)
            x, y = map(pad.of, place)
            n = x.shape[1]
            twin = (x[:, :, None] == x[:, None, :]) & (y[:, :, None] == y[:, None, :])
            later = (twin & np.tri(n, k=-1, dtype=bool)).any(2)  # rows are in the order of own
            x[later], y[later] = np.nan, np.nan
            beyond = np.concatenate([names[pad.at], np.broadcast_to(np.array(SIDES), (len(x), 4))], 1)
            step = max(1, CELLS // (len(x) * (n + 4) * n))
            for at in range(0, n, step):
                *ends, length, far = borders(x, y, slice(at, at + step))
                there = ~np.isnan(length)
                f, i, j = np.nonzero(there)
                row = pad.at[f, at + i]
                np.add.at(area, row, far[there] * length[there] / 2)
                found.append([row, beyond[f, j], *(v[there] for v in ends), length[there]])
        row, *fields = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        sides = pa.StructArray.from_arrays([pa.array(v[order]) for v in fields], ["by", "ax", "ay", "bx", "by_", "length"])
        cell = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(total + 1)).astype(np.int32)), sides)
        return table.append_column("cell", cell).append_column("area", pa.array(area))

    players = sites.select(key, F.col(own).cast("long").alias(own), F.col("x_pitch").alias("x"), F.col("y_pitch").alias("y"))

    def quiet(table: pa.Table, starts: np.ndarray) -> pa.Table:
        with np.errstate(divide="ignore", invalid="ignore"):
            return work(table, starts)

    return in_groups(players, [key], [own], quiet, f"{key} {dict(sites.dtypes)[key]}, {own} long, x double, y double, cell {CELL}, area double")


def ridges(found: DataFrame, key: str, own: str, least: float = 1e-3) -> DataFrame:
    """(key, a_id, b_id, x1, y1, x2, y2): the borders of cells() longer than ``least``, each once, from its smaller end (by x, then y, in mm)."""
    rows = found.select(key, F.col(own).cast("long").alias("a_id"), F.inline("cell")).filter((F.col("by") > F.col("a_id")) & (F.col("length") > least))

    def mm(c: str) -> Column:
        # Places of players are whole mm, so many corners lie on half a mm; the nudge lets them all fall on the same side.
        scaled = (F.col(c) + 1e-6) * 1000
        low = F.floor(scaled).cast("double")
        return (low + (scaled - low >= 0.5).cast("int")) / 1000.0

    first, last = F.struct(mm("ax").alias("x"), mm("ay").alias("y")), F.struct(mm("bx").alias("x"), mm("by_").alias("y"))
    rows = rows.select(key, "a_id", F.col("by").alias("b_id"), F.least(first, last).alias("p"), F.greatest(first, last).alias("q"))
    return rows.select(key, "a_id", "b_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def first_to_arrive(sites: DataFrame, key: str, own: str, columns: int, rows: int, reaction: float = 0.7, speed: float = 8.0) -> DataFrame:
    """(key, px, py, site, seconds): who of a frame reaches the middle of each grid cell first.

    A player runs on with vx, vy (metres a second, at most ``speed``) for the ``reaction`` time, then straight to the cell with full
    speed. Times are compared in microseconds, the smallest ``own`` on a tie.
    """
    fast = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    held = F.when(fast > speed, speed / fast).otherwise(1.0) * reaction
    ahead = sites.select(key, own, (F.col("x_pitch") + F.col("vx") * held).alias("x"), (F.col("y_pitch") + F.col("vy") * held).alias("y"))
    middle = lambda px, py: ((px + 0.5) * (G.LENGTH / columns), (py + 0.5) * (G.WIDTH / rows))
    time = lambda dx, dy: half_up(reaction + np.sqrt(dx * dx + dy * dy) / speed, 6)
    return best_of_grid(ahead, key, own, columns, rows, middle, time).withColumnRenamed("value", "seconds")
