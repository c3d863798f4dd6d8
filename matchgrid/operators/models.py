"""Colour features and small models: thresholds, kNN, regression, clusters."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.ranges import carried, percentiles, running_sums


def share_of(px: str, test) -> Column:
    """The share of an array of RGB structs that passes ``test``."""
    return F.size(F.filter(px, test)) / F.when(F.size(px) > 0, F.size(px))


def green_dominant(p: Column) -> Column:
    return (p["g"] > p["r"] + 5) & (p["g"] > p["b"] - 5)


def hsv(p: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of an RGB struct."""
    r, g, b = (p[c].cast("double") for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    c = F.when(high > low, high - low)
    hue = F.when(high == r, F.pmod((g - b) / c, F.lit(6.0))).when(high == g, (b - r) / c + 2).otherwise((r - g) / c + 4) * 60
    return F.coalesce(hue, F.lit(0.0)), F.when(high > 0, (high - low) / F.when(high > 0, high)).otherwise(0.0), high / 255.0


def is_green(p: Column) -> Column:
    h, s, v = hsv(p)
    return h.between(65.0, 165.0) & (s >= 0.25) & (v >= 0.18) & green_dominant(p)


def hue_bins(px: str, bins: int) -> Column:
    """Normalised hue histogram of an array of RGB structs."""
    hues = F.transform(px, lambda p: F.least(F.lit(bins - 1), F.floor(hsv(p)[0] / (360.0 / bins)).cast("int")))
    one = lambda i: F.size(F.filter(hues, lambda h: h == i)) / F.size(px)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)


def regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and the 5 and 95 % points of actual over expected."""
    fit = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    ratio = F.col(y) / (F.col("slope") * F.col(x) + F.col("intercept"))
    spread = percentiles(rows.join(F.broadcast(fit)), ratio, [0.05, 0.95])  # fit is one row
    return fit.join(F.broadcast(spread)).select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n",
        F.round(F.get("p", F.lit(0)), 4).alias("p5"), F.round(F.get("p", F.lit(1)), 4).alias("p95"),
    )


def value_counts(rows: DataFrame, value: str, positive: Column) -> DataFrame:
    """(v, pos, neg) per distinct value: all that threshold searches need."""
    return rows.groupBy(F.col(value).alias("v")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def f1_threshold(rows: DataFrame, value: str, positive: Column) -> DataFrame:
    """(threshold, f1): an inclusive lower bound of the positives; null if one of the classes is missing.

    If all positives are above all negatives it is the middle between them, else the value that maximises F1, the least on a
    tie. Running sums over the distinct values take the place of a threshold x row product.
    """
    seen = running_sums(value_counts(rows, value, positive), [F.desc("v")], {"tp": F.col("pos"), "fp": F.col("neg")})
    f1 = F.round(2 * F.col("tp") / F.greatest(F.lit(1), F.col("tp_all") + F.col("tp") + F.col("fp")), 6)
    best = seen.withColumn("f1", f1).agg(
        F.max_by(F.struct("v", "f1"), F.struct("f1", -F.col("v"))).alias("b"), F.min(F.when(F.col("pos") > 0, F.col("v"))).alias("low"), F.max(F.when(F.col("neg") > 0, F.col("v"))).alias("high")
    )
    apart = F.col("low") > F.col("high")
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    return best.select(
        F.when(both, F.when(apart, (F.col("low") + F.col("high")) / 2).otherwise(F.col("b.v"))).cast("double").alias("threshold"), F.when(both, F.when(apart, 1.0).otherwise(F.col("b.f1"))).alias("f1")
    )


#: How far the outermost thresholds lie beyond the values.
BEYOND = 1e-6


def accuracy_threshold(rows: DataFrame, value: str, positive: Column) -> DataFrame:
    """(threshold, high_is_positive, accuracy): the best threshold among the middles between neighbouring values and one beyond each end.

    Of equally good ones the high direction and then the least threshold comes first. A single value gives none.
    """
    counts = carried(value_counts(rows, value, positive), "v", {"below": F.col("v")}, own=False)
    seen = running_sums(counts, [F.desc("v")], {"tp": F.col("pos"), "fp": F.col("neg")})
    middle = F.coalesce((F.col("below") + F.col("v")) / 2, F.col("v") - BEYOND)
    above = seen.agg((F.max("v") + BEYOND).alias("t"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("tp_all").alias("tp_all"), F.max("fp_all").alias("fp_all"))
    cuts = seen.select(middle.cast("double").alias("t"), "tp", "fp", "tp_all", "fp_all").unionByName(above)
    right = F.col("tp") + F.col("fp_all") - F.col("fp")
    total = F.col("tp_all") + F.col("fp_all")
    grid = F.array(F.struct(F.lit(1).alias("high"), right.alias("ok")), F.struct(F.lit(0).alias("high"), (total - right).alias("ok")))
    each = cuts.select("t", total.alias("total"), F.inline(grid))
    best = each.agg(F.max_by(F.struct("t", "high", "ok", "total"), F.struct("ok", "high", -F.col("t"))).alias("b"), F.count_distinct("t").alias("n"))
    some = lambda c: F.when(F.col("n") > 2, c)  # noqa: E731  two cuts are beyond the ends
    return best.select(some(F.col("b.t")).alias("threshold"), some(F.col("b.high")).alias("high_is_positive"), F.round(some(F.col("b.ok") / F.col("b.total")), 6).alias("accuracy"))


def otsu(rows: DataFrame, value: str) -> DataFrame:
    """(threshold, between): the split of sorted values with the largest between-class variance, the first on a tie."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    sums = running_sums(counts, ["v"], {"n0": F.col("c"), "s0": F.col("v") * F.col("c")})
    s = sums.withColumnsRenamed({"n0_all": "n", "s0_all": "s"}).filter("n0 < n")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    between = F.round(F.col("n0") * (F.col("n") - F.col("n0")) * gap * gap / (F.col("n") * F.col("n")), 4)
    return s.withColumn("between", between).agg(F.max_by(F.struct("v", "between"), F.struct("between", -F.col("v"))).alias("b")).select(F.col("b.v").alias("threshold"), F.col("b.between").alias("between"))


def two_means(rows: DataFrame, value: str, rounds: int = 200, tolerance: float = 1e-7) -> tuple[float, float] | None:
    """Centres of 1-D 2-means from the extremes; a distributed sum each round."""
    first = rows.agg(F.min(value), F.max(value)).first()
    if first[0] is None:
        return None
    a, b = float(first[0]), float(first[1])
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).cache()
    for _ in range(rounds):
        low = F.abs(F.col("v") - a) <= F.abs(F.col("v") - b)
        m = counts.agg(*(F.sum(F.when(t, F.col("v") * F.col("c"))) / F.sum(F.when(t, F.col("c"))) for t in (low, ~low))).first()
        new = (a if m[0] is None else float(m[0]), b if m[1] is None else float(m[1]))
        done = abs(new[0] - a) + abs(new[1] - b) < tolerance
        a, b = new
        if done:
            break
    counts.unpersist()
    return a, b


def fused_threshold(k_means: float, otsu_value: float) -> float:
    """The mean of two thresholds that agree, else the smaller one."""
    return (k_means + otsu_value) / 2 if abs(k_means - otsu_value) < 0.04 else min(k_means, otsu_value)


def element_stats(rows: DataFrame, vector: str) -> DataFrame:
    """(i, mean, std) of each element over all rows (population; tiny deviations count as 1)."""
    each = rows.select(F.posexplode(vector).alias("i", "x"))
    std = F.stddev_pop("x")
    return each.groupBy("i").agg(F.avg("x").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def balanced(rows: DataFrame, label: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` (two or more) rows per label: of more, those nearest to ``limit`` evenly spaced places from the first to the last by ``order``."""
    by = Window.partitionBy(label)
    ranked = rows.withColumns({"_i": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count("*").over(by)})
    step = (F.col("_n") - 1) / (limit - 1)
    # Row i is taken if one of the places around it rounds (half to even) to i.
    near = F.floor(F.col("_i") / step)
    taken = F.lit(False)
    for k in (near, near + 1):
        taken = taken | ((F.rint(k * step) == F.col("_i")) & (k < limit))
    return ranked.filter((F.col("_n") <= limit) | taken).drop("_i", "_n")


#: Queries of one pass over the model.
QUERY_BLOCK = 20_000
#: Queries and rows of the model whose distances are in memory at once.
TILE = 1024


def z_scored(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with each element of ``vector`` less its mean, in standard deviations."""
    stats = element_stats(rows, vector).agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("stats"))
    scaled = F.zip_with(vector, "stats", lambda x, s: (x - s["mean"]) / s["std"])
    return rows.join(F.broadcast(stats)).withColumn(vector, scaled).drop("stats")  # stats is one row, an entry for each element


def knn(queries: DataFrame, model: DataFrame, own: str, vector: str, label: str, k: int = 7, exclude_self: bool = False) -> DataFrame:
    """(own, label, predicted): inverse-distance vote of the k nearest rows of the model (label 1 on a tie).

    Queries are broadcast in blocks of ``QUERY_BLOCK``; in a pass each task keeps the k
    nearest of its part of the model, and the parts' best are merged. ``own`` is unique.
    """
    queries, blocks = queries.select(own, vector, label), 1 + queries.count() // QUERY_BLOCK
    passes = [nearest(queries.filter(F.pmod(F.xxhash64(own), F.lit(blocks)) == b), model, own, vector, label, k, exclude_self) for b in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, passes)
    best = F.row_number().over(Window.partitionBy(own).orderBy("d2", "near_id"))
    weight = 1.0 / (F.sqrt("d2") + 1e-6)
    vote = F.sum(F.when(F.col("near_label") == 1, weight).otherwise(-weight))
    voted = found.withColumn("best", best).filter(F.col("best") <= k).groupBy(own).agg(vote.alias("vote"))
    return queries.join(voted, own).select(own, label, F.when(F.round("vote", 9) >= 0, 1).otherwise(2).alias("predicted"))


def nearest(queries: DataFrame, model: DataFrame, own: str, vector: str, label: str, k: int, exclude_self: bool) -> DataFrame:
    """(own, d2, near_id, near_label): the k nearest model rows of each query, of every part of the model."""
    rows = queries.select(own, vector).collect()
    if not rows:
        return queries.sparkSession.createDataFrame([], f"{own} long, d2 double, near_id long, near_label int")
    sent = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)))

    def run(batches):
        ids, points = sent.value
        best = [np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int32)]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                x = np.stack(part.column("m").to_numpy(zero_copy_only=False)).astype(float)
                near, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                for first in range(0, len(ids), TILE):
                    tile = slice(first, first + TILE)
                    d2 = np.maximum((points[tile] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * points[tile] @ x.T, 0.0)
                    if exclude_self:
                        d2[ids[tile, None] == near[None, :]] = np.inf
                    every = [np.hstack([best[0][tile], d2]), np.hstack([best[1][tile], np.broadcast_to(near, d2.shape)]), np.hstack([best[2][tile], np.broadcast_to(labels, d2.shape)])]
                    at = np.argpartition(every[0], k - 1, axis=1)[:, :k]
                    for kept, v in zip(best, every, strict=True):
                        kept[tile] = np.take_along_axis(v, at, 1)
        good = np.isfinite(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], good.shape)[good]), pa.array(best[0][good]), pa.array(best[1][good]), pa.array(best[2][good])], [own, "d2", "near_id", "near_label"])

    model = model.select(F.col(own).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("m"), F.col(label).cast("int").alias("label"))
    return model.mapInArrow(run, f"{own} long, d2 double, near_id long, near_label int")
