"""Repair and smoothing of per-track time series."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.ranges import carried, running_sums


def fill_gaps(tracks: DataFrame, values: list[str], max_gap: int = 5) -> DataFrame:
    """Rows for the missing frames of gaps of at most ``max_gap``, interpolated; ``is_filled`` tells them."""
    order = Window.partitionBy("player_id").orderBy("frame")
    rows = tracks.select("player_id", "frame", *values, F.lead("frame").over(order).alias("_f"), *(F.lead(v).over(order).alias(f"_{v}") for v in values))
    gap = F.col("_f") - F.col("frame")
    last = F.when((gap > 1) & (gap <= max_gap), F.col("_f") - 1).otherwise(F.col("frame"))
    each = rows.withColumn("_at", F.explode(F.sequence("frame", last)))
    t = (F.col("_at") - F.col("frame")) / gap
    at = lambda v: F.when(F.col("_at") == F.col("frame"), F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * t)
    return each.select("player_id", F.col("_at").alias("frame"), *(at(v).alias(v) for v in values), (F.col("_at") != F.col("frame")).alias("is_filled"))


def ema(tracks: DataFrame, value: str, alpha: float = 0.5) -> DataFrame:
    """(player_id, frame, value): exponential smoothing along each track, seeded with its first value.

    Tracks lie in order in their partitions and stream through a task, which
    carries the last value on; no track is gathered.
    """
    rows = tracks.select("player_id", "frame", F.col(value).cast("double").alias(value))
    ordered = rows.repartition("player_id").sortWithinPartitions("player_id", "frame")

    def run(batches):
        who, last = object(), 0.0
        for batch in batches:
            out = []
            for own, x in zip(batch.column("player_id").to_pylist(), batch.column(value).to_pylist(), strict=True):
                last = x if own != who else alpha * x + (1 - alpha) * last
                who = own
                out.append(last)
            yield batch.set_column(2, value, pa.array(out, pa.float64()))

    return ordered.mapInArrow(run, ordered.schema)


def moving_average(rows: DataFrame, key: str, value: str, reach: int = 1) -> DataFrame:
    """Mean over the rows around each row, nulls left out."""
    around = Window.partitionBy(key).orderBy("frame").rowsBetween(-reach, reach)
    return rows.withColumn(value, F.avg(value).over(around))


def majority_vote(rows: DataFrame, key: str, flag: Column, reach: int = 2) -> DataFrame:
    """``rows`` with ``vote``: more than half of the rows around have the flag."""
    around = Window.partitionBy(key).orderBy("frame").rowsBetween(-reach, reach)
    return rows.withColumn("vote", 2 * F.sum(flag.cast("int")).over(around) > F.count("*").over(around))


def islands(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive frames."""
    order = Window.partitionBy(*keys).orderBy("frame")
    run = frames.select(*keys, "frame").distinct().withColumn("_run", F.col("frame") - F.row_number().over(order))
    return run.groupBy(*keys, "_run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).drop("_run")


def edge_velocity(rows: DataFrame, key: str, lookback: int = 8) -> DataFrame:
    """(key, vx0, vy0, vx1, vy1): velocity over the first and over the last rows of each key; 0 with one row."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"_a": F.row_number().over(by.orderBy("frame")), "_z": F.row_number().over(by.orderBy(F.desc("frame")))})
    out = []
    for i, rank in enumerate(("_a", "_z")):
        part = F.col(rank) <= lookback
        on = lambda f, c, p=part: f(F.when(p, F.col(c)), F.when(p, F.col("frame")))
        span = F.greatest(F.lit(1), F.max(F.when(part, F.col("frame"))) - F.min(F.when(part, F.col("frame"))))
        for axis, c in (("x", "x_pitch"), ("y", "y_pitch")):
            out.append(((on(F.max_by, c) - on(F.min_by, c)) / span).alias(f"v{axis}{i}"))
    return ranked.groupBy(key).agg(*out)


def count_changes(rows: DataFrame) -> DataFrame:
    """(frame, n, change): difference of each frame's count to the frame before."""
    counts = rows.groupBy("frame").agg(F.count("*").alias("n"))
    return carried(counts, "frame", {"before": F.col("n")}, own=False).select("frame", "n", (F.col("n") - F.col("before")).alias("change"))


def systematic(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Every k-th row of each key, k = max(1, count div n), at most n rows."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"_i": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count("*").over(by)})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return ranked.filter((F.col("_i") % k == 0) & (F.floor(F.col("_i") / k) < n)).drop("_i", "_n")


def stepped(frames: DataFrame, flagged: DataFrame) -> DataFrame:
    """(frame, previous, next): for each frame the flagged frames around it, itself excepted; past the last one it goes on from the first, and back.

    With one flagged frame that is the frame itself, too; without any both are null.
    """
    rows = frames.select("frame").distinct().join(flagged.select("frame").distinct().withColumn("_f", F.col("frame")), "frame", "left")
    flags = rows.union(flagged.select("frame").distinct().join(frames, "frame", "left_anti").select("frame", "frame")).toDF("frame", "_f")
    found = carried(flags, "frame", {"previous": F.col("_f")}, {"next": F.col("_f")}, own=False)
    ends = flagged.agg(F.min("frame").alias("_first"), F.max("frame").alias("_last"))
    around = found.join(F.broadcast(ends))  # one row
    return around.join(frames.select("frame"), "frame", "left_semi").select("frame", F.coalesce("previous", "_last").alias("previous"), F.coalesce("next", "_first").alias("next"))


def between_samples(samples: DataFrame, key: str, frames: DataFrame, values: list[str], held: list[str]) -> DataFrame:
    """(frame, key, values, held): for each of ``frames`` strictly between two neighbouring samples of a key, the values on the line
    between them and the ``held`` columns of the earlier one. Nothing is extrapolated.
    """
    order = Window.partitionBy(key).orderBy("frame")
    gaps = samples.withColumns({f"_{c}": F.lead(c).over(order) for c in ("frame", *values)}).filter(F.col("_frame") - F.col("frame") > 1)
    each = gaps.withColumn("_at", F.explode(F.sequence(F.col("frame") + 1, F.col("_frame") - 1)))
    wanted = each.join(frames.select(F.col("frame").alias("_at")).distinct(), "_at", "left_semi")
    share = (F.col("_at") - F.col("frame")) / (F.col("_frame") - F.col("frame"))
    return wanted.select(F.col("_at").alias("frame"), key, *((F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).alias(c) for c in values), *held)


def tail_split(rows: DataFrame, order: str, share: float = 0.18) -> DataFrame:
    """``rows`` with ``split``: the last max(1, share) of the ordered rows are val."""
    n = F.col("_place_all")
    last = F.col("_place") > n - F.greatest(F.lit(1), F.floor(n * share))
    placed = running_sums(rows, [order], {"_place": F.lit(1).cast("long")})
    return placed.select(*rows.columns, F.when(last, "val").otherwise("train").alias("split"))


def frame_problems(rows: DataFrame, full: int, warp: float, labelled: DataFrame | None = None) -> DataFrame:
    """(frame, problem): duplicate ids, wrong counts, jumps and id swaps against the frame before that exists.

    Frames in ``labelled`` have been dealt with: they have no problems, but are still what the next frame is held against.
    """
    frames = carried(rows.select("frame").distinct(), "frame", {"before": F.col("frame")}, own=False)
    twice = rows.groupBy("frame", "player_id").count().filter("count > 1").select("frame", F.lit("duplicate").alias("problem")).distinct()
    counts = rows.groupBy("frame").agg(F.count("*").alias("n")).filter(F.col("n") != full).select("frame", F.lit("count").alias("problem"))
    ids = rows.groupBy("frame", "player_id").agg(F.min("foot_x").alias("x"), F.min("foot_y").alias("y"))
    now = ids.join(frames.filter("before is not null"), "frame")
    old = ids.select(F.col("frame").alias("before"), "player_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    moved = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) > warp * warp
    jumps = now.join(old, ["before", "player_id"]).filter(moved).select("frame", F.lit("warp").alias("problem")).distinct()
    new = now.join(old, ["before", "player_id"], "left_anti").select("frame").distinct()
    after = old.join(frames, "before")
    gone = after.join(ids.select("frame", "player_id"), ["frame", "player_id"], "left_anti").select("frame").distinct()
    swaps = new.join(gone, "frame").select("frame", F.lit("swap").alias("problem"))
    found = twice.unionByName(counts).unionByName(jumps).unionByName(swaps)
    return found if labelled is None else found.join(labelled.select("frame").distinct(), "frame", "left_anti")
