"""As-of, range and nearest joins, as unions with windows or bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.ranges import carried


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], time: str, value: str, tie: str | None = None) -> DataFrame:
    """``rows`` with the value of the last event at or before each row's time, null if none.

    ``tie`` orders events of the same time, the first one written wins. Events
    and rows of a key meet in one sorted pass, so the cost does not depend on
    how many events a key has.
    """
    order = F.col(tie) if tie else F.lit(0)
    e = events.groupBy(*keys, time).agg(F.min_by(value, order).alias(value))
    e = e.select(*keys, time, F.lit(0).alias("_row"), F.lit(None).cast(struct_of(rows)).alias("_r"), value)
    r = rows.select(*keys, time, F.lit(1).alias("_row"), F.struct(*rows.columns).alias("_r"), F.lit(None).cast(e.schema[value].dataType).alias(value))
    before = Window.partitionBy(*keys).orderBy(time, "_row").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.unionByName(r).withColumn(value, F.last(value, ignorenulls=True).over(before)).filter("_row = 1")
    return seen.select("_r.*", value)


def struct_of(df: DataFrame) -> str:
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType.simpleString()


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, low: int, high: int, equal: Column | None = None) -> DataFrame:
    """Pairs with ``low <= right_at - left_at <= high``, joined on buckets of the range's width.

    Column names of the two sides must differ.
    """
    width = max(1, high - low)
    bucket = lambda c: F.floor(c / width).cast("long")
    reach = F.sequence(bucket(F.col(left_at) + low), bucket(F.col(left_at) + high))
    a = left.withColumn("_bucket", F.explode(reach))
    b = right.withColumn("_bucket", bucket(F.col(right_at)))
    gap = F.col(right_at) - F.col(left_at)
    joined = a.join(b, "_bucket").filter(gap.between(low, high))
    return (joined if equal is None else joined.filter(equal)).drop("_bucket")


def between_keyframes(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """(frame, x, y, is_key): positions on a frame spine from the keyframes around each frame.

    ``keys`` has frame, state (pos or none), image_x, image_y. A keyframe gives
    its own position; between two neighbouring keyframes of state pos the
    position is interpolated; elsewhere there is no row.
    """
    k = F.struct(F.col("key_frame"), "state", "image_x", "image_y")
    spine = frames.select("frame").join(keys.withColumn("key_frame", F.col("frame")), "frame", "full")
    spine = spine.withColumn("k", F.when(F.col("key_frame").isNotNull(), k))
    both = carried(spine.select("frame", "k"), "frame", {"a": F.col("k")}, {"b": F.col("k")})
    good = (F.col("a.state") == "pos") & (F.col("b.state") == "pos")
    span = F.col("b.key_frame") - F.col("a.key_frame")
    t = F.when(span == 0, 0.0).otherwise((F.col("frame") - F.col("a.key_frame")) / F.when(span != 0, span))
    at = {c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t for c in ("image_x", "image_y")}
    return both.filter(good).select("frame", at["image_x"].alias("x"), at["image_y"].alias("y"), (span == 0).cast("int").alias("is_key"))


def nearest_rows(rows: DataFrame, targets: DataFrame, keys: list[str], time: str, target: str) -> DataFrame:
    """For each target the row of its key nearest in time; of equals the earlier."""
    gap = F.abs(F.col(time) - F.col(target))
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(gap, time)).alias("_b")
    return targets.join(rows, keys).groupBy(*targets.columns).agg(best).select(*targets.columns, "_b.*")
