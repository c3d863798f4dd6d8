"""State changes of annotation tools as logs, and the state that a log leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.temporal import as_of
from matchgrid.sources.store import stored

#: The nested document of identity edits.
EDIT_SCHEMA = "cuts map<string,array<int>>, merges array<array<array<int>>>, names map<string,string>, frame_labels map<string,string>, geom map<string,array<double>>"


def edit_tables(documents: DataFrame, column: str, order: str | None = None) -> dict[str, DataFrame]:
    """Identity edit documents as flat tables: cuts, merges, names (with their place, by ``order`` of the documents), frame labels and geometry.

    The documents are parsed once, into the shared folder; each table reads its own column of that.
    """
    parsed = documents.select(F.from_json(column, EDIT_SCHEMA).alias("d"), F.lit(0) if order is None else F.col(order)).toDF("d", "_doc")
    doc = stored(parsed.select("d.*", "_doc"), "edits")
    pair = F.col("p")
    key = F.split("k", "_")
    return {
        "cuts": doc.select(F.explode("cuts").alias("k", "fs")).select(F.col("k").cast("int").alias("tid"), F.explode("fs").alias("cut")),
        "merges": doc.select(F.explode("merges").alias("p")).select(pair[0][0].alias("a_tid"), pair[0][1].alias("a_cut"), pair[1][0].alias("b_tid"), pair[1][1].alias("b_cut")),
        "names": doc.select("_doc", F.posexplode("names").alias("_pos", "k", "name")).select(key[0].cast("int").alias("tid"), key[1].cast("int").alias("cut"), "name", F.struct("_doc", "_pos").alias("place")),
        "geom": doc.select(F.explode("geom").alias("k", "g")).select(key[0].cast("int").alias("frame"), key[1].cast("int").alias("tid"), *(F.get("g", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2")))),
        "frame_labels": doc.select(F.explode("frame_labels").alias("k", "label")).select(F.col("k").cast("int").alias("frame"), "label"),
    }


def sub_ids(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (tid, frame) with the greatest cut of their track at or before the frame, else 0."""
    events = cuts.select("tid", F.col("cut").alias("frame"), "cut")
    return as_of(rows, events, ["tid"], "frame", "cut").withColumn("cut", F.coalesce("cut", F.lit(0)))


def node(tid: Column, cut: Column) -> Column:
    """One number for a track from a cut on."""
    return tid.cast("long") * (1 << 31) + cut


def identified(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``rows`` (frame, tid, x1..y2) after all edits of a document: with cut, player_id and name, and the corners it has moved.

    A track's parts between cuts, as merged, are a player. Players are numbered 1.. by the number of their rows (then by first frame, then by the
    smallest part). A name given to any part names the whole player, the first in the document if there are several; without one it is empty.
    """
    from matchgrid.operators.components import components
    from matchgrid.operators.editlog import with_geometry
    from matchgrid.operators.ranges import numbered

    placed = sub_ids(with_geometry(rows, tables["geom"], ["frame", "tid"]), tables["cuts"]).withColumn("_node", node(F.col("tid"), F.col("cut")))
    merges = tables["merges"].select(node(F.col("a_tid"), F.col("a_cut")).alias("a"), node(F.col("b_tid"), F.col("b_cut")).alias("b")).filter("a <> b")
    roots = components(merges, "a", "b").select(F.col("v").alias("_node"), F.col("root").alias("_root"))
    rooted = lambda df: df.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    named = rooted(tables["names"].withColumn("_node", node(F.col("tid"), F.col("cut")))).groupBy("_root").agg(F.min_by("name", "place").alias("name"))
    # Written once: the numbering below reads it several times (to draw bounds, to write, for the result).
    found = stored(rooted(placed).drop("_node"), "identified")
    sizes = found.groupBy("_root").agg((-F.count("*")).alias("_n"), F.min("frame").alias("_first"))
    players = numbered(sizes, ["_n", "_first", "_root"], "player_id").select("_root", "player_id")
    return found.join(players, "_root").join(named, "_root", "left").withColumn("name", F.coalesce("name", F.lit(""))).drop("_root")


def assigned(log: DataFrame) -> DataFrame:
    """(tid, name, kind, frame): what a log of base, override and unassign actions leaves.

    A base assignment or an unassign clears all earlier overrides of its track.
    """
    resets = log.filter(F.col("kind").isin("base", "unassign")).groupBy("tid").agg(F.max_by(F.struct("seq", "kind", "name"), "seq").alias("r"))
    base = resets.filter("r.kind = 'base'").select("tid", F.col("r.name").alias("name"), F.lit("base").alias("kind"), F.lit(-1).alias("frame"))
    later = log.filter("kind = 'override'").join(resets, "tid", "left").filter(F.col("seq") > F.coalesce("r.seq", F.lit(-1)))
    return base.unionByName(later.select("tid", "name", "kind", "frame"))


def swapped_from(names: DataFrame, a: int, b: int, frame: int, seq: int) -> DataFrame:
    """The two overrides that exchange the names of tracks a and b from a frame on; none if one is unnamed."""
    pair = names.filter(F.col("tid").isin(a, b) & F.col("name").isNotNull() & (F.col("name") != "__reject__"))
    other = F.when(F.col("tid") == a, b).otherwise(a)
    both = Window.partitionBy(F.lit(0))  # at most two rows
    rows = pair.withColumn("n", F.count("*").over(both)).filter("n = 2")
    return rows.select(other.cast("int").alias("tid"), F.lit(frame).alias("frame"), "name", (F.lit(seq) + (F.col("tid") == b).cast("int")).cast("long").alias("seq"))


def upserted(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """``base`` with the last change per key in place of its row; a change marked ``cleared`` removes it."""
    last = changes.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("_rn = 1")
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("not cleared").select(*base.columns))


def trimmed(df: DataFrame, frame: str, start: int, end: int) -> DataFrame:
    """Frames of a trim range, its ends in either order."""
    return df.filter(F.col(frame).between(min(start, end), max(start, end)))


def renamed(names: DataFrame, old: str, new: str) -> DataFrame:
    return names.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def roster_added(roster: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``roster`` with the rows of ``new`` whose name it does not have; of equal new names the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(order))
    fresh = new.withColumn("_rn", rank).filter("_rn = 1").join(roster.select("name"), "name", "left_anti")
    return roster.unionByName(fresh.select(*roster.columns))


def granted(roster: DataFrame, renames: DataFrame, order: str) -> DataFrame:
    """(old, new): the renames (old, new) that are possible: old is in the roster, new is not and is claimed by no earlier rename; each old name once."""
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(order))
    names = roster.select("name").distinct()
    good = renames.filter("old <> new").join(names.withColumnRenamed("name", "old"), "old", "left_semi").join(names.withColumnRenamed("name", "new"), "new", "left_anti")
    once = good.withColumn("_rn", first("old")).filter("_rn = 1")
    return once.withColumn("_rn", first("new")).filter("_rn = 1").select("old", "new")


def cascaded(table: DataFrame, renames: DataFrame) -> DataFrame:
    """A table with a name column (roster, base names or overrides) after renames that were granted()."""
    joined = table.join(renames, table["name"] == renames["old"], "left")
    return joined.select(*(F.coalesce("new", "name").alias("name") if c == "name" else table[c] for c in table.columns))


def candidate_score(predicted: Column, end: Column, gap: Column, turn: Column) -> Column:
    """Cost of joining two fragments."""
    return predicted + 0.35 * end + 0.04 * gap + 0.18 * turn


def required_speed(end: Column, gap: Column, fps: float) -> Column:
    return end / F.greatest(gap / fps, F.lit(1 / fps))


def visible_angle(x: Column, y: Column, goal_x: float, low: float, high: float) -> Column:
    """The angle in degrees under which a goal mouth is seen from a point."""
    a, b = F.atan2(F.lit(low) - y, F.lit(goal_x) - x), F.atan2(F.lit(high) - y, F.lit(goal_x) - x)
    return F.abs(F.degrees(b - a))
