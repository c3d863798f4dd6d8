"""Heat maps: Gaussian blur of sparse occupancy cells, normalised and cut off."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kernel(size: int) -> list[float]:
    """The weights of an odd number of taps, with the deviation that belongs to the size."""
    sigma, middle = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    weights = [math.exp(-((i - middle) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(weights) for w in weights]


def kernel_size(image_width: int) -> int:
    """The taps for an image: odd, 31 at least."""
    return max(31, int(image_width * 0.035) | 1)


def blurred_along(cells: DataFrame, axis: str, across: str, extent: int, weights: list[float], value: str, *by: str) -> DataFrame:
    """One pass of the blur: every cell is spread over its neighbours along the axis and the shares are summed.

    Beyond an edge the image goes on mirrored, without the edge itself a second time: a cell is spread from its mirror images as well.
    """
    half, at = len(weights) // 2, F.col(axis)
    images = F.array_distinct(F.array(at, -at, 2 * (extent - 1) - at))
    taps = F.array(*(F.struct(F.lit(i - half).alias("off"), F.lit(w).alias("w")) for i, w in enumerate(weights)))
    spread = cells.select(*by, across, value, F.explode(images).alias("_image")).select(*by, across, value, "_image", F.inline(taps))
    spread = spread.withColumn("_to", F.col("_image") + F.col("off")).filter(F.col("_to").between(0, extent - 1))
    return spread.groupBy(*by, F.col("_to").alias(axis), across).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def heat_map(cells: DataFrame, width: int, height: int, size: int, *by: str, floor: float = 0.03) -> DataFrame:
    """(by, px, py, heat, level): occupancy cells (px, py, n) blurred, as shares of the hottest and in 0..255; cells up to ``floor`` are left out."""
    if size % 2 == 0 or size // 2 >= min(width, height):
        raise ValueError("a kernel has an odd number of taps and reaches less far than the grid")
    weights = kernel(size)
    rows = cells.select(*by, "px", "py", F.col("n").cast("double").alias("heat"))
    rows = blurred_along(rows, "px", "py", width, weights, "heat", *by)
    rows = blurred_along(rows, "py", "px", height, weights, "heat", *by)
    top = rows.groupBy(*by).agg(F.max("heat").alias("_top"))
    joined = rows.join(top, list(by)) if by else rows.join(F.broadcast(top))  # one row
    share = F.round(F.col("heat") / F.col("_top"), 6)
    return joined.filter("_top > 0").withColumn("heat", share).filter(F.col("heat") > floor).select(*by, "px", "py", "heat", level(F.col("heat")).alias("level"))


def level(heat: Column) -> Column:
    return F.floor(heat * 255).cast("int")
