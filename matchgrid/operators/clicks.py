"""Replay of a click log with undo, reset and save, as a composition of bounded stack changes.

A click puts a point on the stack unless it is full, an undo takes the last one
back, a reset empties it and a save keeps its points if it is full. What a stretch of
actions does depends only on how many points were there before, so it is known by
one small summary for each possible depth. Sessions are cut into stretches of bounded length,
each is summed up by itself, and the summaries are applied in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Corners of a pitch, and actions in one stretch.
POINTS, STRETCH = 4, 1000

POINT = "struct<x:double,y:double>"
#: What a stretch does: how many of the old points are left, the new ones on top, clicks that found a full stack, undos that found an empty
#: one, saves that found too few points, and what the last good save kept.
CHANGE = f"struct<kept:int,points:array<{POINT}>,ignored:bigint,idle:bigint,refused:bigint,saved:struct<kept:int,points:array<{POINT}>>>"


def stretch_change(actions: Column, depth: Column, points: int) -> Column:
    """The CHANGE of an array of actions (action, x, y) on a stack of ``depth`` points."""
    zero = F.struct(
        depth.cast("int").alias("kept"), F.array().cast(f"array<{POINT}>").alias("points"), F.lit(0).cast("bigint").alias("ignored"),
        F.lit(0).cast("bigint").alias("idle"), F.lit(0).cast("bigint").alias("refused"), F.lit(None).cast(f"struct<kept:int,points:array<{POINT}>>").alias("saved"),
    )

    def one(s: Column, a: Column) -> Column:
        size = s["kept"] + F.size(s["points"])
        click, undo, reset, save = (a["action"] == k for k in ("click", "undo", "reset", "save"))
        has = F.size(s["points"]) > 0
        kept = F.when(reset, 0).when(undo & ~has, F.greatest(F.lit(0), s["kept"] - 1)).otherwise(s["kept"])
        top = F.when(reset, F.array().cast(f"array<{POINT}>")).when(undo & has, F.slice(s["points"], F.lit(1), F.size(s["points"]) - 1))
        top = top.when(click & (size < points), F.concat(s["points"], F.array(F.struct(a["x"], a["y"])))).otherwise(s["points"])
        plus = lambda name, when: (s[name] + F.when(when, 1).otherwise(0)).cast("bigint").alias(name)
        good = save & (size == points)
        saved = F.when(good, F.struct(s["kept"].alias("kept"), s["points"].alias("points"))).otherwise(s["saved"])
        return F.struct(
            kept.cast("int").alias("kept"), top.alias("points"), plus("ignored", click & (size >= points)), plus("idle", undo & (size == 0)), plus("refused", save & (size < points)), saved.alias("saved"),
        ).cast(CHANGE)

    return F.aggregate(actions, zero.cast(CHANGE), one)


def point_stacks(log: DataFrame, session: str, order: str, points: int = POINTS, stretch: int = STRETCH) -> DataFrame:
    """(session, points, saved, actions, ignored, idle, refused): what each session's log leaves.

    ``log`` has session, a unique ``order``, action (click, undo, reset or save; others do nothing), x and y. ``points`` are those on the
    stack at the end, ``saved`` those of the last save that found a full stack, or null.
    """
    place = F.row_number().over(Window.partitionBy(session).orderBy(order))
    rows = log.select(session, place.alias("_place"), F.struct("action", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("a"))
    cut = rows.groupBy(session, F.floor((F.col("_place") - 1) / stretch).alias("_cut")).agg(F.array_sort(F.collect_list(F.struct("_place", "a"))).alias("a"))
    actions = F.transform("a", lambda r: r["a"])
    changes = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda d: stretch_change(actions, d, points))
    summed = cut.select(session, "_cut", F.size("a").cast("long").alias("n"), changes.alias("c"))
    each = summed.groupBy(session).agg(F.sum("n").alias("actions"), F.array_sort(F.collect_list(F.struct("_cut", "c"))).alias("parts"))

    def apply(s: Column, part: Column) -> Column:
        c = F.get(part["c"], F.size(s["points"]))
        under = lambda n: F.slice(s["points"], F.lit(1), n)
        saved = F.when(c["saved"].isNotNull(), F.concat(under(c["saved"]["kept"]), c["saved"]["points"])).otherwise(s["saved"])
        plus = lambda name: (s[name] + c[name]).alias(name)
        return F.struct(F.concat(under(c["kept"]), c["points"]).alias("points"), saved.alias("saved"), plus("ignored"), plus("idle"), plus("refused"))

    none = F.array().cast(f"array<{POINT}>")
    count = lambda name: F.lit(0).cast("bigint").alias(name)
    start = F.struct(none.alias("points"), F.lit(None).cast(f"array<{POINT}>").alias("saved"), count("ignored"), count("idle"), count("refused"))
    return each.select(session, "actions", F.aggregate("parts", start, apply).alias("s")).select(session, "actions", "s.*")
