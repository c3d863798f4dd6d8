"""Replay of box edits and geometry overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def latest(log: DataFrame, actions: list[str], fields: list[str]) -> DataFrame:
    """The last edit of the given kinds per box."""
    rows = log.filter(F.col("action").isin(*actions))
    best = rows.groupBy("frame", "box_key").agg(F.max_by(F.struct(*fields), "seq").alias("e"))
    return best.select("frame", "box_key", *(F.col(f"e.{f}").alias(f"new_{f}") for f in fields))


def replay(base: DataFrame, log: DataFrame, move_sets_group: bool = False) -> DataFrame:
    """Boxes after all edits: (frame, box_key, x1..y2, group, origin).

    ``base`` has frame, box_key, the box and group. A delete hides its box for
    good; the last move and the last reassign of a box count; edits of unknown
    boxes do nothing; the last add of a key gives a box, unless it is deleted.
    """
    moved = latest(log, ["move"], [*BOX, "group"])
    grouped = latest(log, ["reassign"], ["group"]).withColumnRenamed("new_group", "re_group")
    added = latest(log, ["add"], [*BOX, "group"]).select("frame", "box_key", *(F.col(f"new_{c}").alias(c) for c in [*BOX, "group"]))
    rows = base.select("frame", "box_key", *BOX, "group", F.lit("base").alias("origin")).unionByName(added.withColumn("origin", F.lit("added")))
    gone = log.filter("action = 'delete'").select("frame", "box_key").distinct()
    keys = ["frame", "box_key"]
    alive = rows.join(gone, keys, "left_anti").join(moved, keys, "left").join(grouped, keys, "left")
    group = F.coalesce("re_group", *(["new_group"] if move_sets_group else []), "group")
    return alive.select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in BOX), group.alias("group"), "origin")


def with_geometry(boxes: DataFrame, geometry: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with their corners replaced where ``geometry`` has new ones."""
    new = geometry.select(*keys, *(F.col(c).alias(f"new_{c}") for c in BOX))
    joined = boxes.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in BOX}).drop(*(f"new_{c}" for c in BOX))


def difference(base: DataFrame, edited: DataFrame) -> DataFrame:
    """The shortest log that turns ``base`` into ``edited``: (seq, frame, box_key, action, x1..y2, group).

    Both have frame, box_key, the box and group, at most one row a key. A box that is only in ``edited`` is an add,
    one that is only in ``base`` a delete; another group is a reassign, corners that differ when
    rounded to tenths a move, and both are logged if both changed, the reassign first. A box that was added and
    deleted again is in neither table, so it leaves nothing. Only adds and moves have corners. ``seq`` counts by frame, key and action.
    """
    from matchgrid.operators.ranges import numbered

    keys, fields = ["frame", "box_key"], [*BOX, "group"]
    old = base.select(*keys, F.struct(*fields).alias("a"))
    new = edited.select(*keys, F.struct(*fields).alias("b"))
    both = old.join(new, keys, "full")
    tenth = lambda side, c: F.round(F.col(f"{side}.{c}"), 1)
    moved = F.lit(False)
    for c in BOX:
        moved = moved | ~tenth("a", c).eqNullSafe(tenth("b", c))
    one = lambda when, name, place: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(name).alias("action")))
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    actions = F.array_compact(F.array(
        one(F.col("a").isNull(), "add", 0), one(F.col("b").isNull(), "delete", 1),
        one(here & ~F.col("a.group").eqNullSafe(F.col("b.group")), "reassign", 2), one(here & moved, "move", 3),
    ))
    rows = both.select(*keys, "a", "b", F.inline(actions))
    corner = lambda c: F.when(F.col("action").isin("add", "move"), tenth("b", c)).alias(c)
    log = rows.select(*keys, "place", "action", *map(corner, BOX), F.coalesce("b.group", "a.group").alias("group"))
    return numbered(log, ["frame", "box_key", "place"], "seq").select("seq", *keys, "action", *fields)


def reset(log: DataFrame, frames: DataFrame) -> DataFrame:
    """The log without the edits of ``frames`` (frame): their boxes are the original detections again.

    Repeated and null frames reset nothing more. Edits without a frame stay.
    """
    return log.join(frames.select("frame").distinct(), "frame", "left_anti").select(*log.columns)


def redetected(base: DataFrame, log: DataFrame, frames: DataFrame, found: DataFrame, start: int, least: float = 2.0) -> DataFrame:
    """The log after detecting the boxes of ``frames`` (frame) from ``start`` on anew: (seq, frame, box_key, action, x1..y2, group).

    Edits before ``start`` stay as they are, later ones go, also those of frames that were not looked at. In every frame that was, each box of
    ``base`` is deleted, and each of ``found`` (frame, place, box, group) that is at least ``least`` wide and high is
    added, its corners rounded to tenths, under the next key of -1, -2, ... over all frames. The new
    rows follow on the old ones by frame, deletes by key before adds by place. Frames where nothing is found lose their boxes;
    what is found in other frames, or has no frame, is left out.
    """
    from matchgrid.operators.ranges import numbered

    fields = ["frame", "box_key", "action", *BOX, "group"]
    kept = log.filter(F.col("frame") < start).select("seq", *fields)
    looked = frames.filter(F.col("frame") >= start).select("frame").distinct()
    gone = base.join(looked, "frame", "left_semi").select("frame", "box_key", F.lit("delete").alias("action"), *(F.lit(None).cast("double").alias(c) for c in BOX), "group")
    whole = found.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least)).join(looked, "frame", "left_semi")
    new = numbered(whole.select("frame", "place", *(F.round(c, 1).alias(c) for c in BOX), "group"), ["frame", "place", *BOX, "group"], "n")
    added = new.select("frame", (-F.col("n")).cast("int").alias("box_key"), F.lit("add").alias("action"), *BOX, "group")
    order = [F.col("frame"), F.col("action").desc(), F.abs("box_key"), F.col("box_key")]
    last = kept.agg(F.max("seq")).first()[0] or 0
    rows = numbered(gone.unionByName(added), order, "seq").select((F.col("seq") + last).alias("seq"), *fields)
    return kept.unionByName(rows)
