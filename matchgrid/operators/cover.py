"""How much of a goal mouth, seen from the ball, is hidden by the wall and the keeper.

Every defender between ball and goal line hides an interval of angles. The
covered share is the length of the union of these intervals; what is left open are the gaps between them.
Intervals of a shot are sorted and merged by a window, so no shot's players are gathered in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G

#: The goal mouth is 7.32 m wide, in the middle of the goal line.
POSTS = (G.WIDTH / 2 - 3.66, G.WIDTH / 2 + 3.66)
#: Half widths in metres of what a defender's body and a keeper's reach hide.
BODY, REACH = 0.35, 1.2


def mirrored(x: Column, goal_x: Column) -> Column:
    """Distance from the goal line: both goals then lie in the same direction."""
    return F.when(goal_x > G.LENGTH / 2, goal_x - x).otherwise(x - goal_x)


def hidden_angles(shots: DataFrame, defenders: DataFrame, key: str, body: float = BODY, reach: float = REACH) -> DataFrame:
    """(key, low, high, lo, hi, keeper): the goal mouth of each shot and the part of it that each defender hides.

    ``shots`` has key, ball_x, ball_y and goal_x, ``defenders`` key, who, x_pitch and y_pitch. The keeper is the defender
    nearest to the middle of the goal, the smallest ``who`` on a tie. Shots from the goal line or behind it see no mouth and are left out; shots
    without a defender in front stay, with null ``lo``.
    """
    ball = shots.select(key, F.col("ball_y").alias("_y"), mirrored(F.col("ball_x"), F.col("goal_x")).alias("_depth"), "goal_x").filter("_depth > 0")
    ball = ball.withColumns({"low": F.atan2(F.lit(POSTS[0]) - F.col("_y"), F.col("_depth")), "high": F.atan2(F.lit(POSTS[1]) - F.col("_y"), F.col("_depth"))})
    rows = ball.join(defenders.select(key, "who", "x_pitch", "y_pitch"), key, "left")
    rows = rows.withColumn("_from_line", mirrored(F.col("x_pitch"), F.col("goal_x")))
    middle = F.lit(G.WIDTH / 2)
    to_goal = G.squared(F.col("_from_line"), F.col("y_pitch"), F.lit(0.0), middle)
    rows = rows.withColumn("keeper", F.row_number().over(Window.partitionBy(key).orderBy(to_goal, "who")) == 1)
    ahead, aside = F.col("_depth") - F.col("_from_line"), F.col("y_pitch") - F.col("_y")
    far, wide = F.sqrt(ahead * ahead + aside * aside), F.when(F.col("keeper"), reach).otherwise(body)
    half = F.when(far > wide, F.asin(wide / far)).otherwise(F.pi() / 2)
    between = (ahead > 0) & (F.col("_from_line") >= 0)
    lo = F.greatest("low", F.atan2(aside, ahead) - half)
    hi = F.least("high", F.atan2(aside, ahead) + half)
    rows = rows.withColumns({"lo": F.when(between & (hi > lo), lo), "hi": F.when(between & (hi > lo), hi)})
    return rows.select(key, "low", "high", "lo", "hi", "keeper")


def uncovered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_lo, gap_hi, total): the stretches between low and high that no interval [lo, hi] of a key covers.

    Null intervals cover nothing. Each key gets an empty interval at its upper end, before which its last gap lies.
    """
    ends = intervals.select(*keys, "low", "high").groupBy(*keys).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    stops = ends.select(*keys, "low", "high", F.col("high").alias("lo"), F.col("high").alias("hi"))
    rows = intervals.filter("lo is not null").select(*keys, "low", "high", "lo", "hi").unionByName(stops)
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("gap_lo", F.coalesce(F.max("hi").over(before), F.col("low")))
    return reached.select(*keys, "gap_lo", F.greatest("gap_lo", "lo").alias("gap_hi"), (F.col("high") - F.col("low")).alias("total"))


def shot_cover(shots: DataFrame, defenders: DataFrame, key: str, body: float = BODY, reach: float = REACH) -> DataFrame:
    """Per shot: the angle of the goal mouth in degrees, the shares that only the wall, only the keeper, both and nobody
    cover, how many of the wall stand in front of it, and the widest open gap (degrees; its middle from -1 at the first post to 1).
    """
    hidden = hidden_angles(shots, defenders, key, body, reach)
    kinds = F.when(F.col("lo").isNull(), F.array(F.lit("wall"), F.lit("keeper"), F.lit("all"))).otherwise(F.array(F.when(F.col("keeper"), "keeper").otherwise("wall"), F.lit("all")))
    # Every kind of every shot needs a row, also where it covers nothing.
    blank = hidden.groupBy(key).agg(F.max("low").alias("low"), F.max("high").alias("high")).select(key, "low", "high", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("keeper"))
    each = hidden.filter("lo is not null").unionByName(blank).withColumn("kind", F.explode(kinds))
    gaps = uncovered(each, [key, "kind"]).withColumn("gap", F.col("gap_hi") - F.col("gap_lo"))
    open_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("gap")))
    widest = F.max_by(F.struct("gap", ((F.col("gap_lo") + F.col("gap_hi")) / 2).alias("mid")), F.when(F.col("kind") == "all", F.struct(F.round("gap", 9), -F.round("gap_lo", 9))))
    found = gaps.groupBy(key).agg(F.max("total").alias("_total"), open_of("wall").alias("_w"), open_of("keeper").alias("_k"), open_of("all").alias("_o"), widest.alias("_widest"))
    walls = hidden.groupBy(key).agg(F.max("low").alias("_low"), F.count_if(F.col("lo").isNotNull() & ~F.col("keeper")).alias("n_wall"))
    share = lambda c: c / F.col("_total")
    return found.join(walls, key).select(
        key, F.degrees("_total").alias("goal_angle"), share(F.col("_k") - F.col("_o")).alias("wall_only"), share(F.col("_w") - F.col("_o")).alias("keeper_only"),
        share(F.col("_total") - F.col("_w") - F.col("_k") + F.col("_o")).alias("both"), share(F.col("_o")).alias("open"), "n_wall",
        F.degrees("_widest.gap").alias("widest_gap"), ((F.col("_widest.mid") - F.col("_low")) * 2 / F.col("_total") - 1).alias("gap_place"),
    )
