"""Column functions of image and pitch geometry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 105.0, 68.0
BASIS = 1920.0

#: The four pitch corners in the image and on the pitch.
IMAGE_CORNERS = ((546.0, 685.5), (1428.0, 685.5), (1975.5, 912.0), (28.5, 892.5))
PITCH_CORNERS = ((0.0, 0.0), (LENGTH, 0.0), (LENGTH, WIDTH), (0.0, WIDTH))


def homography(image: Sequence, pitch: Sequence) -> list[float]:
    """The nine numbers that map four image points on four pitch points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(image, pitch, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows), np.array(right)).tolist(), 1.0]


CAMERA = homography(IMAGE_CORNERS, PITCH_CORNERS)


def projected(x: Column, y: Column, h: Sequence[float] = CAMERA) -> tuple[Column, Column]:
    """Pitch coordinates of an image point; null on the vanishing line."""
    depth = h[6] * x + h[7] * y + h[8]
    depth = F.when(depth != 0, depth)
    return (h[0] * x + h[1] * y + h[2]) / depth, (h[3] * x + h[4] * y + h[5]) / depth


def in_pitch(x: Column, y: Column, margin: float = 5.0) -> Column:
    """1 inside the pitch and its margin (bounds included), else 0; null is outside."""
    inside = x.between(-margin, LENGTH + margin) & y.between(-margin, WIDTH + margin)
    return F.when(inside, 1).otherwise(0)


def foot(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def to_pixel(x: Column, extent: float, pixels: int, margin: int) -> Column:
    """Drawing coordinate, cut toward zero."""
    return margin + (x / extent * pixels).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(squared(ax, ay, bx, by))


def area(b: str = "") -> Column:
    return (F.col(f"{b}x2") - F.col(f"{b}x1")) * (F.col(f"{b}y2") - F.col(f"{b}y1"))


def overlap(a: str = "", b: str = "") -> Column:
    """Intersection over the smaller area of two boxes with prefixed columns; 0 if disjoint."""
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    smaller = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (smaller > 0), w * h / smaller).otherwise(0.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rescaled(x: Column, native_width: Column | float, to_basis: bool = True) -> Column:
    """Native pixels to the 1920 basis, or back."""
    return x * BASIS / native_width if to_basis else x * native_width / BASIS


def size_score(height: Column, y_center: Column, slope: float, intercept: float, low: float, high: float) -> Column:
    """How well a box height fits the expected one at its place: 1 within [low, high]."""
    expected = slope * y_center + intercept
    ratio = height / F.when(expected > 0, expected)
    return F.when(expected <= 0, 1.0).when(ratio < low, ratio / low).when(ratio > high, F.lit(high) / ratio).otherwise(1.0)
