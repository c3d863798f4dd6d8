"""Identities: relabelling, keys, components of merges, names and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.components import components as contracted
from matchgrid.operators.ranges import numbered


def relabel(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, new_id): 1.. by descending number of rows, of equals the one seen first."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return numbered(sizes, [F.desc("n"), "first"], "new_id").select(key, "new_id")


def stable_ids(rows: DataFrame, known: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, id): known ids stay, others follow the largest by size."""
    fresh = relabel(rows.join(known, key, "left_anti"), key, seq)
    top = known.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
    numbered = fresh.join(F.broadcast(top)).select(key, (F.col("top") + F.col("new_id")).alias("id"))  # top is one row
    return known.select(key, "id").unionByName(numbered)


def negative_keys(rows: DataFrame, lowest: Column, frame: str, order: str) -> DataFrame:
    """New boxes get the keys below the lowest one of their frame."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(order))
    return rows.withColumn("box_key", (lowest - place).cast("long"))


def split_teams(rows: DataFrame, full: int, half: int) -> DataFrame:
    """In frames with ``full`` boxes the ``half`` with the best score are team A, the others B."""
    by = Window.partitionBy("frame")
    ranked = rows.withColumns({"_n": F.count("*").over(by), "_r": F.row_number().over(by.orderBy(F.desc("confidence"), "detection_id"))})
    return ranked.filter(F.col("_n") == full).withColumn("team", F.when(F.col("_r") <= half, "A").otherwise("B")).drop("_n", "_r")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): every vertex of the edges with the least vertex of its component."""
    found = contracted(edges, a, b)
    alone = edges.select(F.explode(F.array(a, b)).alias("v")).distinct().join(found, "v", "left_anti")
    return found.unionByName(alone.select("v", F.col("v").alias("root")))


def decision_edges(decisions: DataFrame) -> DataFrame:
    """(a, b): the first member of a with every other member of both sides of an accepted merge."""
    members = F.array_distinct(F.concat("a_members", "b_members"))
    rows = decisions.filter("decision = 'yes'").select(F.element_at("a_members", 1).alias("a"), F.explode(members).alias("b"))
    return rows.filter("a <> b").distinct()


def names_by_component(names: DataFrame, labels: DataFrame, priority: str) -> DataFrame:
    """(root, name): of a component's names the one with the least priority."""
    return names.join(labels, "v").groupBy("root").agg(F.min_by("name", priority).alias("name"))
