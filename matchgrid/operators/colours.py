"""Colours of small crops: LAB, a 42-value feature, and the dominant jersey colour.

Pixels are arrays of (r, g, b) in 0..255. HSV and LAB are in the 8-bit scales of image libraries: hue in 0..179,
L times 2.55, a and b plus 128, all rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.operators import models

# sRGB to XYZ, the white point, and the limits of the cube root.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
SMALL, SLOPE, LIFT = 0.008856, 7.787, 16 / 116
#: Bins of hue, saturation and value; fewest pixels of a crop; the grass in LAB.
BINS = (12, 6, 6)
FEWEST = 8
GRASS = (118.0, 114.0, 145.0)
CLUSTERS, ROUNDS, EPSILON = 3, 20, 1.0


def lab(p: Column) -> Column:
    """The 8-bit L, a, b of an RGB struct."""
    linear = lambda c: F.when(p[c] / 255.0 > 0.04045, F.pow((p[c] / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(p[c] / 255.0 / 12.92)
    rgb = [linear(c) for c in "rgb"]
    x, y, z = (sum(k * c for k, c in zip(row, rgb, strict=True)) / w for row, w in zip(XYZ, WHITE, strict=True))
    f = lambda t: F.when(t > SMALL, F.cbrt(t)).otherwise(SLOPE * t + LIFT)
    light = F.when(y > SMALL, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return F.struct(F.round(light * 2.55).alias("l"), F.round(500 * (f(x) - f(y)) + 128).alias("a"), F.round(200 * (f(y) - f(z)) + 128).alias("b"))


def eight_bit_hsv(p: Column) -> Column:
    """The 8-bit h, s, v of an RGB struct."""
    h, s, v = models.hsv(p)
    return F.struct((F.round(h / 2) % 180).alias("h"), F.round(s * 255).alias("s"), F.round(v * 255).alias("v"))


def pixel_columns(batch: pa.RecordBatch, column: str, fields: str) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of each row, and the fields of all pixels as columns."""
    lists = batch.column(column)
    sizes = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten()
    return sizes, np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in fields], 1) if len(flat) else np.zeros((0, len(fields)))


def colour_features(rows: DataFrame, px: str, fewest: int = FEWEST) -> DataFrame:
    """``rows`` with ``feature``, 42 values of an array of pixels: histograms of hue, saturation and value (12, 6, 6), mean and deviation of
    RGB and of LAB (as shares of 255), shares of green, dark and bright pixels, mean of green less red, green less blue and green over both.

    Null for fewer than ``fewest`` pixels. The pixels of a batch are folded together, a row's sums being slots of the fold.
    """
    new = T.StructField("feature", T.ArrayType(T.DoubleType()))
    keep = [f for f in rows.schema.fields if f.name != new.name]

    def run(batches):
        for batch in batches:
            sizes, rgb = pixel_columns(batch, "_rgb", "rgb")
            hsv, labs, green = (pixel_columns(batch, c, f)[1] for c, f in (("_hsv", "hsv"), ("_lab", "lab"), ("_green", "x")))
            n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            share = 1 / np.maximum(sizes, 1)
            mean = lambda v: np.bincount(row, v, n) * share

            def histogram(values: np.ndarray, top: int, bins: int) -> np.ndarray:
                place = np.minimum(values * bins // top, bins - 1).astype(int)
                return np.bincount(row * bins + place, minlength=n * bins).reshape(n, bins) * share[:, None]

            def moments(values: np.ndarray) -> list[np.ndarray]:
                means = np.stack([mean(v) for v in values.T], 1)
                return [means, np.sqrt(np.stack([mean(v) for v in ((values - means[row]) ** 2).T], 1))]

            r, g, b = (rgb / 255).T
            rest = [green[:, 0], (rgb < 0.25 * 255).all(1), (rgb > 0.75 * 255).any(1), g - r, g - b, g / (r + b + 1e-4)]
            found = np.hstack([
                histogram(hsv[:, 0], 180, BINS[0]), histogram(hsv[:, 1], 256, BINS[1]), histogram(hsv[:, 2], 256, BINS[2]),
                *moments(rgb / 255), *moments(labs / 255), np.stack([mean(v.astype(float)) for v in rest], 1),
            ])
            values = pa.array([f if k >= max(fewest, 1) else None for f, k in zip(found.tolist(), sizes, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [values], [*(f.name for f in keep), new.name])

    green = F.transform(px, lambda p: F.struct(models.is_green(p).cast("int").alias("x")))
    derived = rows.select(*rows.columns, F.col(px).alias("_rgb"), F.transform(px, eight_bit_hsv).alias("_hsv"), F.transform(px, lab).alias("_lab"), green.alias("_green"))
    return derived.mapInArrow(run, T.StructType([*keep, new]))


def small_means(points: np.ndarray, real: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (rows, clusters, 3) and sizes of k-means in every row of ``points`` (rows, pixels, 3) at once; ``real`` marks the pixels that count.

    A row starts from its pixel farthest from the grass and then, again and again, from the one farthest from the centres so far (the first
    on a tie). Empty clusters keep their centre. A row ends when no centre moves by more than EPSILON, or after ROUNDS.
    """
    gap = np.where(real, ((points - np.array(GRASS)) ** 2).sum(2), -1.0)
    centres = np.take_along_axis(points, gap.argmax(1)[:, None, None], 1)
    for _ in range(1, clusters):
        gap = np.where(real, ((points[:, :, None] - centres[:, None]) ** 2).sum(3).min(2), -1.0)
        centres = np.concatenate([centres, np.take_along_axis(points, gap.argmax(1)[:, None, None], 1)], 1)
    going = np.ones(len(points), bool)
    sizes = np.zeros((len(points), clusters))
    for _ in range(ROUNDS):
        at = going.nonzero()[0]
        if not len(at):
            break
        p, r = points[at], real[at]
        nearest = ((p[:, :, None] - centres[at][:, None]) ** 2).sum(3).argmin(2)
        member = (nearest[:, :, None] == np.arange(clusters)) & r[:, :, None]
        sizes[at] = member.sum(1)
        sums = np.einsum("npk,npc->nkc", member.astype(float), p)
        new = np.where(sizes[at][:, :, None] > 0, sums / np.maximum(sizes[at], 1)[:, :, None], centres[at])
        going[at] = np.sqrt(((new - centres[at]) ** 2).sum(2)).max(1) > EPSILON
        centres[at] = new
    return centres, sizes


def dominant_colour(rows: DataFrame, px: str, fewest: int = FEWEST) -> DataFrame:
    """``rows`` with jersey (l, a, b of its cluster's centre), jersey_pixels and jersey_score; null for fewer than ``fewest`` pixels.

    The pixels of each row fall into up to three clusters in LAB; the jersey is the one with the largest distance to
    the grass times pixels, the first on a tie. Rows of a batch are clustered together, padded to the most pixels.
    """
    new = T.StructType.fromDDL("jersey struct<l:double,a:double,b:double>, jersey_pixels long, jersey_score double")
    keep = [f for f in rows.schema.fields if f.name not in new.names]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes, values = pixel_columns(batch, "_lab", "lab")
                real = np.arange(max(1, sizes.max(initial=0)))[None] < sizes[:, None]
                points = np.zeros((*real.shape, 3))
                points[real] = values
                found = [None] * len(sizes)
                good = sizes >= max(fewest, 1)
                for k in range(1, CLUSTERS + 1):
                    at = (good & ((sizes >= k) if k == CLUSTERS else (sizes == k))).nonzero()[0]
                    if len(at):
                        centres, counts = small_means(points[at], real[at], k)
                        score = np.where(counts > 0, np.sqrt(((centres - np.array(GRASS)) ** 2).sum(2)) * counts, -1.0)
                        for i, row in enumerate(at):
                            best = int(score[i].argmax())
                            found[row] = (dict(zip("lab", centres[i, best].tolist(), strict=True)), int(counts[i, best]), float(score[i, best]))
                made = [pa.array([None if f is None else f[j] for f in found], to_arrow_type(t.dataType)) for j, t in enumerate(new.fields)]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + made, [*(f.name for f in keep), *new.names])

    return rows.withColumn("_lab", F.transform(px, lab)).mapInArrow(run, T.StructType([*keep, *new.fields]))
