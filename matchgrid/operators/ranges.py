"""Running values over a total order without a one-task window.

Rows are range-partitioned by the order. Every partition is worked on by itself,
and what the partitions before (or after) it hold reaches it as one summary row
a partition. The partitioned rows are written to the shared folder, because the
bounds of a range partitioning are drawn anew each time it is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.sources.store import stored

PART = "_part"


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with the number of their range partition; rows of equal order share one."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each entry, its sum up to the row and, as ``<name>_all``, over all rows.

    Of rows with equal order any may come first. A null adds nothing.
    """
    parts = ranged(rows, *order)
    own = parts.groupBy(PART).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()))
    # The windows over the summary see a row each partition.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = [PART]
    for name in sums:
        summary += [F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}"), F.sum(name).over(every).alias(f"{name}_all")]
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = {name: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{name}") for name, c in sums.items()}
    joined = parts.join(F.broadcast(own.select(*summary)), PART)
    return joined.select(*rows.columns, *(c.alias(name) for name, c in found.items()), *(f"{name}_all" for name in sums))


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place, 1.., in the order."""
    return running_sums(rows, order, {name: F.lit(1).cast("long")}).drop(f"{name}_all")


def carried(rows: DataFrame, order: str, back: dict[str, Column], ahead: dict[str, Column] | None = None, own: bool = True) -> DataFrame:
    """``rows`` with the last non-null value of each ``back`` entry up to the row and the first of each ``ahead`` entry from it on.

    With ``own`` false the row itself does not count. Without such a value: null.
    """
    ahead, by = ahead or {}, Window.partitionBy(PART).orderBy(order)
    parts = ranged(rows, order)
    known = lambda c: F.when(c.isNotNull(), F.col(order))
    edges = [F.max_by(c, known(c)).alias(f"_{n}") for n, c in back.items()] + [F.min_by(c, known(c)).alias(f"_{n}") for n, c in ahead.items()]
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # over summaries, as above
    after = Window.orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    summary = [F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}") for n in back] + [F.first(f"_{n}", ignorenulls=True).over(after).alias(f"_{n}") for n in ahead]
    away = parts.groupBy(PART).agg(*edges).select(PART, *summary)
    # What is ahead is what lies behind in the falling order: a frame up to the partition's end is summed anew for every row.
    falling = Window.partitionBy(PART).orderBy(F.desc(order))
    past, future = (w.rowsBetween(Window.unboundedPreceding, 0 if own else -1) for w in (by, falling))
    found = {n: F.coalesce(F.last(c, ignorenulls=True).over(past), f"_{n}") for n, c in back.items()}
    found |= {n: F.coalesce(F.last(c, ignorenulls=True).over(future), f"_{n}") for n, c in ahead.items()}
    return parts.join(F.broadcast(away), PART).select(*rows.columns, *(c.alias(n) for n, c in found.items()))


def percentiles(rows: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """(p): one row with the exact percentiles of ``value``, linear between neighbours; null without values.

    Equal values are counted before they are sorted.
    """
    counts = rows.select(value.alias("v")).dropna().groupBy("v").agg(F.count("*").alias("c"))
    upto = running_sums(counts, ["v"], {"seen": F.col("c")})
    at = lambda rank: F.min(F.when(F.col("seen") > rank, F.col("v")))
    points = []
    for share in shares:
        place = (F.col("seen_all") - 1) * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        points.append(low + (high - low) * F.max(place - F.floor(place)))
    return upto.agg(F.array(*points).alias("p"))
