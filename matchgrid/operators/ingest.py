"""Scans, cleaning and first projections of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.operators.ranges import numbered


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, or an empty one if the path does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def typed(raw: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """String columns cast to ``types``: the rows where all casts hold, and the others as they were."""
    good = F.lit(True)
    for name, kind in types.items():
        good = good & F.col(name).try_cast(kind).isNotNull()
    cast = {name: F.col(name).try_cast(kind) for name, kind in types.items()}
    return raw.filter(good).withColumns(cast), raw.filter(~good)


def valid_boxes(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return df.filter((F.col("confidence") >= min_confidence) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def large_enough(df: DataFrame, width: float, height: float) -> DataFrame:
    return df.filter((F.col("x2") - F.col("x1") >= width) & (F.col("y2") - F.col("y1") >= height))


def default_team(df: DataFrame, middle: float = 540.0) -> DataFrame:
    """A blank team hint becomes A in the upper half of the image, else B."""
    hint = F.trim(F.coalesce("team_hint", F.lit("")))
    return df.withColumn("team_hint", F.when(hint != "", hint).when(F.col("center_y") < middle, "A").otherwise("B"))


def analysed(df: DataFrame) -> DataFrame:
    """Rows not marked as outside the pitch; without the mark every row counts."""
    if "in_pitch" not in df.columns:
        return df
    return df.filter(F.coalesce("in_pitch", F.lit(1)) != 0)


def intervals(text: str) -> list[tuple[int, int]]:
    """``10-30, 55`` as inclusive intervals."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out.append((int(low), int(high or low)))
    return out


def without_intervals(df: DataFrame, column: str, text: str) -> DataFrame:
    hit = F.lit(False)
    for low, high in intervals(text):
        hit = hit | F.col(column).between(low, high)
    return df.filter(~hit)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def frame_metadata(names: DataFrame, start: float, fps: float) -> DataFrame:
    """Index and time of each frame file, in the order of the names."""
    rows = numbered(names.select("filename"), ["filename"], "place").select("filename", (F.col("place") - 1).alias("frame_idx"))
    return rows.withColumn("timestamp", F.round(start + F.col("frame_idx") / fps, 3))


def effective_fps(frames: DataFrame, frame: str, time: str, default: float = 2.0) -> DataFrame:
    """Frames a second from the first two timestamps."""
    first = frames.orderBy(frame).limit(2).agg(F.min_by(time, frame).alias("a"), F.max_by(time, frame).alias("b"))
    step = F.col("b") - F.col("a")
    return first.select(F.round(F.when(step > 0, 1 / F.when(step > 0, step)).otherwise(default), 6).alias("fps"))


#: Where the mock players of a row stand, and the foot lines of the two rows, as shares of the image.
MOCK_X = (0.18, 0.28, 0.38, 0.48, 0.58, 0.68, 0.78, 0.24, 0.42, 0.62, 0.76)
MOCK_Y = (0.38, 0.62)


def mock_boxes(frames: DataFrame, width: float, height: float) -> DataFrame:
    """22 boxes a frame in two rows of 11 that stand on their foot lines, for pipelines without a detector."""
    i = F.col("detection_id")
    boxes = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("detection_id"))
    x = F.get(F.array(*map(F.lit, MOCK_X)), i % 11) * width
    y = (F.when(i < 11, MOCK_Y[0]).otherwise(MOCK_Y[1]) + ((i % 11) % 3 - 1) * 0.035) * height
    half = width * 0.018 / 2
    return boxes.select(
        "frame", "detection_id", (x - half).alias("x1"), (y - height * 0.055).alias("y1"), (x + half).alias("x2"), y.alias("y2"),
        F.lit(0.5).alias("confidence"), F.when(i < 11, "A").otherwise("B").alias("team_hint"),
    )


#: The names that detectors give to lists, boxes and corners.
LISTS = ("objects", "detections", "boxes", "results")
BOXES = ("bbox", "box", "bounding_box")
CORNERS = {"x1": ("x1", "left", "xmin", "x_min"), "y1": ("y1", "top", "ymin", "y_min"), "x2": ("x2", "right", "xmax", "x_max"), "y2": ("y2", "bottom", "ymax", "y_max")}


def detector_boxes(df: DataFrame, column: str, width: float, height: float) -> DataFrame:
    """One row per box of tolerant detector JSON, clamped to the image.

    The first non-empty list counts. A box is an object or a list of corners,
    its own or nested; corners up to 1.5 are relative. Boxes that miss a corner
    are left out.
    """
    lists = [F.from_json(F.get_json_object(column, f"$.{name}"), "array<string>") for name in LISTS]
    chosen = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    rows = df.withColumn("_list", chosen).select(*df.columns, F.posexplode("_list").alias("pos", "_item"))
    nested = F.coalesce(*(F.get_json_object("_item", f"$.{name}") for name in BOXES), F.col("_item"))
    rows = rows.withColumn("_box", nested)
    corner = {c: F.coalesce(*(F.get_json_object("_box", f"$.{n}") for n in names), F.get_json_object("_box", f"$[{i}]")).try_cast("double") for i, (c, names) in enumerate(CORNERS.items())}
    rows = rows.withColumns(corner).dropna(subset=list(CORNERS))
    relative = F.greatest(*CORNERS) <= 1.5
    sized = {c: F.greatest(F.lit(0.0), F.least(F.lit(full), F.when(relative, F.col(c) * full).otherwise(F.col(c)))) for c, full in zip(CORNERS, (width, height, width, height), strict=True)}
    confidence = F.coalesce(F.get_json_object("_item", "$.confidence"), F.get_json_object("_item", "$.score")).try_cast("double")
    return rows.withColumn("confidence", F.coalesce(confidence, F.lit(1.0))).withColumns(sized).drop("_list", "_item", "_box")
