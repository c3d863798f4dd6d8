"""Detectors as a pluggable source: frames in, boxes out, one model per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

BOXES = "frame int, detection_id int, x1 double, y1 double, x2 double, y2 double, confidence double"


class Detector(Protocol):
    """Anything that finds boxes in an encoded image."""

    def __call__(self, frame: int, content: bytes) -> Iterable[tuple[float, float, float, float, float]]:
        """(x1, y1, x2, y2, confidence) of each person."""


class MockDetector:
    """Boxes derived from the frame number, for tests and pipelines without a model."""

    def __init__(self, n: int = 22):
        self.n = n

    def __call__(self, frame: int, content: bytes):
        for i in range(self.n):
            x, y = 60.0 + 80 * i + frame % 7, 300.0 + 90 * (i % 5)
            yield x, y, x + 30, y + 60, 0.5


def detected(frames: DataFrame, load: Callable[[], Detector], min_width: float = 2.0, min_height: float = 2.0) -> DataFrame:
    """Boxes of ``frames`` (frame, content), numbered within each frame; ``load`` runs once per task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for part in parts:
            rows = []
            for frame, content in zip(part["frame"], part["content"], strict=True):
                good = [b for b in detector(int(frame), content) if b[2] - b[0] >= min_width and b[3] - b[1] >= min_height]
                rows += [(frame, i, *map(float, b)) for i, b in enumerate(good)]
            yield pd.DataFrame(rows, columns=["frame", "detection_id", "x1", "y1", "x2", "y2", "confidence"])

    return frames.select("frame", "content").mapInPandas(run, BOXES)


def mask_boxes(masks: DataFrame, least: int = 10) -> DataFrame:
    """(frame, obj, x1, y1, x2, y2) of mask pixels (frame, obj, x, y); masks of fewer pixels are dropped."""
    from pyspark.sql import functions as F

    boxes = masks.groupBy("frame", "obj").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n"))
    return boxes.filter(F.col("n") >= least).drop("n")
