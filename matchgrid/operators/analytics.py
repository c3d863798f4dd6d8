"""Movement, team shape, attack direction and offside from pitch positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import geometry as G


def steps(tracks: DataFrame) -> DataFrame:
    """``tracks`` with the step from each player's sample before: mm (long) and seconds."""
    order = Window.partitionBy("player_id").orderBy("time", "frame")
    before = lambda c: F.lag(c).over(order)
    metres = G.distance(F.col("x_pitch"), F.col("y_pitch"), before("x_pitch"), before("y_pitch"))
    return tracks.withColumns({"step_mm": F.round(metres * 1000).cast("long"), "dt": F.col("time") - before("time")})


def movement(tracks: DataFrame) -> DataFrame:
    """Per player: team of the first sample, samples, distance and top speed."""
    speed = F.col("step_mm") / 1000 / F.greatest(F.lit(1e-6), F.col("dt"))
    return steps(tracks).groupBy("player_id").agg(
        F.min_by("team", F.struct("time", "frame")).alias("team"), F.count("*").alias("samples"),
        F.round(F.coalesce(F.sum("step_mm"), F.lit(0)) / 1000, 2).alias("distance_m"), F.round(F.coalesce(F.max(speed), F.lit(0.0)), 2).alias("max_speed_mps"),
    )


def centroids(tracks: DataFrame) -> DataFrame:
    """Per frame and team: players and mean position. Sums are in mm, so order does not matter."""
    mean = lambda c: F.sum(F.round(F.col(c) * 1000).cast("long")) / F.count("*") / 1000
    return tracks.groupBy("frame", "team").agg(F.min("time").alias("time"), F.count("*").alias("players"), mean("x_pitch").alias("centroid_x"), mean("y_pitch").alias("centroid_y"))


def heat_cells(tracks: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """Occupancy of a pixel grid over the pitch, outside cells dropped."""
    px, py = G.to_pixel(F.col("x_pitch"), G.LENGTH, width, 0), G.to_pixel(F.col("y_pitch"), G.WIDTH, height, 0)
    cells = tracks.select(*by, px.alias("px"), py.alias("py")).filter((F.col("px").between(0, width - 1)) & (F.col("py").between(0, height - 1)))
    return cells.groupBy(*by, "px", "py").agg(F.count("*").alias("n"))


def majority(rows: DataFrame, key: str, value: str, order: str, ignore: tuple[str, ...] = ("", "?")) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    seen = rows.filter(~F.col(value).isin(*ignore)).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return seen.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value))


def attack_directions(tracks: DataFrame, *by: str) -> DataFrame:
    """(team, direction): +1 if the team's players stand nearer to the goal at 0, over frames with three or more.

    If both teams agree, the one with the smaller margin turns, B on a tie.
    """
    frames = tracks.groupBy(*by, "frame", "team").agg(F.count("*").alias("n"), F.min("x_pitch").alias("low"), F.max("x_pitch").alias("high")).filter("n >= 3")
    zero = F.count_if(F.col("low") < G.LENGTH - F.col("high"))
    votes = frames.groupBy(*by, "team").agg((2 * zero - F.count("*")).alias("margin"))
    both = votes.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("team") == t, F.col("margin"))), F.lit(0)).alias(t) for t in ("A", "B")))
    sign = {t: F.when(F.col(t) >= 0, 1).otherwise(-1) for t in ("A", "B")}
    turn_b = F.abs("B") <= F.abs("A")
    same = sign["A"] == sign["B"]
    a = F.when(same & ~turn_b, -sign["A"]).otherwise(sign["A"])
    b = F.when(same & turn_b, -sign["B"]).otherwise(sign["B"])
    teams = F.array(F.struct(F.lit("A").alias("team"), a.alias("direction")), F.struct(F.lit("B").alias("team"), b.alias("direction")))
    return both.select(*by, F.inline(teams))


def defence_lines(tracks: DataFrame, directions: DataFrame) -> DataFrame:
    """(frame, team, line_x): the second-last defender of the team that the other one attacks."""
    attack = directions.select(F.when(F.col("team") == "A", "B").otherwise("A").alias("team"), "direction")
    rows = tracks.join(F.broadcast(attack), "team")  # two rows
    deep = Window.partitionBy("frame", "team").orderBy((F.col("direction") * F.col("x_pitch")).desc(), "player_id")
    second = rows.withColumn("rn", F.row_number().over(deep)).filter("rn = 2")
    return second.select("frame", "team", F.col("x_pitch").alias("line_x"), "direction")


def offside(tracks: DataFrame, lines: DataFrame, margin: float = 0.6) -> DataFrame:
    """Attackers beyond half-way and beyond the line by more than ``margin``."""
    other = lines.select("frame", F.when(F.col("team") == "A", "B").otherwise("A").alias("team"), "line_x", "direction")
    ahead = F.col("direction") * F.col("x_pitch")
    beyond = (ahead > F.col("direction") * (G.LENGTH / 2)) & (ahead > F.col("direction") * F.col("line_x") + margin)
    return tracks.join(other, ["frame", "team"]).filter(beyond)


def fill_report(boxes: DataFrame, least_fill: float, least_score: float, full: int) -> DataFrame:
    """(frame, fill, boxes, found, colour_only, phantom, missing) of frames whose mean score is below ``least_fill``.

    ``boxes`` has frame, score and whether a detection matched. A box below ``least_score`` is a phantom, one at or above it without a detection is there by its
    colour only; missing is what the others lack of ``full``. A frame without boxes counts as filled.
    """
    good = F.col("score") >= least_score
    each = boxes.groupBy("frame").agg(
        F.round(F.avg("score"), 6).alias("fill"), F.count("*").alias("boxes"), F.count_if("matched").alias("found"), F.count_if(~F.col("matched") & good).alias("colour_only"),
        F.count_if(~good).alias("phantom"), F.greatest(F.lit(0), full - F.count_if(good)).alias("missing"),
    )
    return each.filter(F.col("fill") < least_fill)


def team_extent(tracks: DataFrame) -> DataFrame:
    """Width and depth of each team in each frame."""
    return tracks.groupBy("frame", "team").agg(F.round(F.max("x_pitch") - F.min("x_pitch"), 3).alias("depth"), F.round(F.max("y_pitch") - F.min("y_pitch"), 3).alias("width"))


def sprints(tracks: DataFrame, fast: float, slow: float) -> DataFrame:
    """Per player: average speed, stopped seconds and runs of consecutive fast steps."""
    order = Window.partitionBy("player_id").orderBy("time", "frame")
    rows = steps(tracks).filter("step_mm is not null and dt > 0").withColumn("speed", F.col("step_mm") / 1000 / F.col("dt"))
    is_fast = F.col("speed") > fast
    begun = is_fast & ~F.coalesce(F.lag(is_fast).over(order), F.lit(False))
    rows = rows.withColumn("begun", begun)
    return rows.groupBy("player_id").agg(
        F.round(F.sum("step_mm") / 1000 / F.sum("dt"), 3).alias("avg_speed"), F.round(F.sum(F.when(F.col("speed") < slow, F.col("dt")).otherwise(0.0)), 3).alias("stopped_s"), F.count_if("begun").alias("sprints"))


def lane_openness(rows: DataFrame) -> DataFrame:
    """For passes within a frame and team: the least distance of an opponent to the segment."""
    a = rows.select("frame", F.col("team"), F.col("player_id").alias("a_id"), F.col("x_pitch").alias("ax"), F.col("y_pitch").alias("ay"))
    b = rows.select("frame", F.col("team"), F.col("player_id").alias("b_id"), F.col("x_pitch").alias("bx"), F.col("y_pitch").alias("by"))
    o = rows.select("frame", F.col("team").alias("o_team"), F.col("x_pitch").alias("ox"), F.col("y_pitch").alias("oy"))
    passes = a.join(b, ["frame", "team"]).filter("a_id < b_id").join(o, "frame").filter("o_team <> team")
    return passes.groupBy("frame", "team", "a_id", "b_id").agg(F.min(to_segment(*map(F.col, ("ox", "oy", "ax", "ay", "bx", "by")))).alias("openness"))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = G.squared(ax, ay, bx, by)
    t = F.when(length > 0, G.clamp(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(length > 0, length), 0.0, 1.0)).otherwise(0.0)
    return G.distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))
