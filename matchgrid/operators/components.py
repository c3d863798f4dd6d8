"""Connected components by alternating star contractions.

Every round is a few grouped minima and joins over the edges, so no group is
gathered in a task; the edges of a round are written to the shared folder, and
those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.sources.store import discard, stored


def stars(pairs: DataFrame, toward_smaller_only: bool) -> DataFrame:
    """Hang the neighbours (u, v) of each u on the least of them and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if toward_smaller_only:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(v, root) for every vertex of ``edges`` but the roots themselves; a root is its component's least vertex."""
    a, b = F.col(left), F.col(right)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen, before = None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = stored(stars(stars(both, False), True), "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None:
            discard(before)
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen, before = mark, now
