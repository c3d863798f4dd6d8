"""Detection in overlapping tiles: which tiles see a box, and one box again from what they saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators.matching import suppressed


def tile_grid(width: int, height: int, columns: int, rows: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(tile, left, top, right, bottom): equal tiles, each reaching ``overlap`` pixels over its inner edges."""
    out = []
    for tile in range(columns * rows):
        i, j = tile % columns, tile // columns
        left, top = max(0, width * i // columns - overlap), max(0, height * j // rows - overlap)
        out.append((tile, left, top, min(width, width * (i + 1) // columns + overlap), min(height, height * (j + 1) // rows + overlap)))
    return out


def seen_in_tiles(boxes: DataFrame, grid: list[tuple[int, int, int, int, int]], least: float = 2.0) -> DataFrame:
    """``boxes`` as each tile sees them: cut to the tile, from its corner, at least ``least`` wide and high; ``tile`` says which."""
    tiles = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("tile", "l", "t", "r", "b"), tile, strict=True))) for tile in grid)))
    rows = boxes.withColumn("_t", tiles)
    x1, y1 = F.greatest("x1", "_t.l") - F.col("_t.l"), F.greatest("y1", "_t.t") - F.col("_t.t")
    x2, y2 = F.least("x2", "_t.r") - F.col("_t.l"), F.least("y2", "_t.b") - F.col("_t.t")
    cut = rows.select(*(c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")), F.col("_t.tile").alias("tile"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return cut.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def from_tiles(seen: DataFrame, grid: list[tuple[int, int, int, int, int]], key: str, limit: float = 0.6) -> DataFrame:
    """(key, own, x1..y2): what tiles have seen, back in the image, without what another tile has seen as well.

    ``seen`` has key, tile, an integer ``own`` unique in a tile of a key, and the box from the tile's corner. Of boxes that overlap by more than ``limit`` of the
    smaller one only the largest stays, so a box that an edge cuts gives way to the whole one of the tile beyond.
    """
    left = F.get(F.array(*(F.lit(t[1]) for t in grid)), F.col("tile"))
    top = F.get(F.array(*(F.lit(t[2]) for t in grid)), F.col("tile"))
    back = seen.select(key, (F.col("own") * len(grid) + F.col("tile")).alias("own"), (F.col("x1") + left).alias("x1"), (F.col("y1") + top).alias("y1"), (F.col("x2") + left).alias("x2"), (F.col("y2") + top).alias("y2"))
    return suppressed(back, key, "own", limit)
