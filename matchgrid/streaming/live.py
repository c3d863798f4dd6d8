"""Live tracking: the stateful operators as Structured Streaming queries.

All state ends with event time: windows when the watermark passes them, trackers by timers.
Rows that come too late are part of the output, marked as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from matchgrid.operators.matching import NearestTracker, frames_of

TRACKED = "clip int, frame int, detection_id int, track_id long, track_distance double, late boolean"
SMOOTHED = "player_id int, frame int, x double, late boolean"

#: How far the watermark stays behind the newest event, and how long after its last event a key's state is kept.
LATE, IDLE = "10 minutes", "30 minutes"
#: Timers and named state need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def milliseconds(length: str) -> int:
    """The length of an interval of fixed units."""
    return int(pd.Timedelta(length).total_seconds() * 1000)


class Expiring(StatefulProcessor):
    """State per key (its last fields are the newest frame and the time of the last event) that an event-time timer ends.

    Every row comes out. Late rows, marked as such, are those not newer than their key's newest frame or, for a key
    without state, not newer than the watermark. ``SCHEMA`` is that of the state, ``take`` works on the rows in time.
    """

    SCHEMA = ""

    def __init__(self, idle: str):
        self.idle = milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.SCHEMA)

    def take(self, key: tuple, old: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """The new state without its last two fields, and the rows as they come out."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[-1] + self.idle < watermark:
            old = None  # its timer is due in this batch
        rows = pd.concat(list(rows))
        late = rows.ms <= watermark if old is None else rows.frame <= old[-2]
        good = rows[~late]
        if late.any():
            yield self.late(rows[late])
        if len(good):
            value, out = self.take(key, old, good)
            last = max(int(good.ms.max()), 0 if old is None else old[-1])
            self.state.update((*value, int(good.frame.max()), last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last + self.idle, watermark) + 1)
            yield out

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class LiveTracker(Expiring):
    """The nearest tracker; the state holds a clip's live tracks."""

    SCHEMA = "next_id long, ids array<long>, xs array<double>, ys array<double>, frames array<int>, newest int, latest long"
    COLUMNS = ["clip", "frame", "detection_id", "track_id", "track_distance", "late"]

    def __init__(self, idle: str, max_distance: float, max_missed: int):
        super().__init__(idle)
        self.limits = max_distance, max_missed

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(track_id=pd.array([None] * len(rows), "Int64"), track_distance=np.nan, late=True)[self.COLUMNS]

    def take(self, key: tuple, old: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        tracker, out = NearestTracker(*self.limits), []
        if old is not None:
            tracker.next_id, ids, xs, ys, frames = old[:5]
            tracker.tracks = {int(i): (x, y, int(f)) for i, x, y, f in zip(ids, xs, ys, frames, strict=True)}
        for frame, part in frames_of(rows, "detection_id"):
            found = tracker.frame(frame, list(zip(part.foot_x, part.foot_y, strict=True)))
            out.append(part.assign(track_id=pd.array([i for i, _ in found], "Int64"), track_distance=np.array([d for _, d in found], float), late=False))
        live = tracker.tracks
        state = (tracker.next_id, list(live), [p[0] for p in live.values()], [p[1] for p in live.values()], [p[2] for p in live.values()])
        return state, pd.concat(out)[self.COLUMNS]


class Smoother(Expiring):
    """Exponential smoothing; the state is a player's last value. Of several rows of a frame the first counts, the others are late."""

    SCHEMA = "value double, newest int, latest long"
    COLUMNS = ["player_id", "frame", "x", "late"]

    def __init__(self, idle: str, alpha: float):
        super().__init__(idle)
        self.alpha = alpha

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(late=True)[self.COLUMNS]

    def take(self, key: tuple, old: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        rows = rows.sort_values(["frame", "place"], kind="stable")
        again = rows.frame.duplicated()
        good = rows[~again]
        values = good.x.to_numpy(float)
        if old is not None:
            values = np.concatenate([[old[0]], values])
        smooth = pd.Series(values).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[-len(good) :]
        return (float(smooth[-1]),), pd.concat([good.assign(x=smooth, late=False), rows[again].assign(late=True)])[self.COLUMNS]


def timed(rows: DataFrame, late: str, *columns: str) -> DataFrame:
    """``columns`` and the event time in milliseconds, under a watermark. The time column itself goes, so that Spark does not drop late rows unseen."""
    return rows.withWatermark("ts", late).select(*columns, F.unix_millis("ts").alias("ms"))


def live_tracks(detections: DataFrame, max_distance: float = 90.0, max_missed: int = 4, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """The nearest tracker over a stream of detections (with ``ts``), one state per clip, frames of a micro-batch in order.

    A clip's state ends once the watermark is ``idle`` past its last detection. Late rows come out without a track.
    """
    rows = timed(detections, late, "clip", "frame", "detection_id", "foot_x", "foot_y")
    return rows.groupBy("clip").transformWithStateInPandas(LiveTracker(idle, max_distance, max_missed), TRACKED, "append", "eventTime")


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Boxes and mean position per tumbling window and team, late rows dropped by watermark."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "team")
        .agg(F.count("*").alias("n"), F.avg("foot_x").alias("x")).select(F.col("w.start").alias("start"), "team", "n", "x")
    )


def presence_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of time in which a player is seen without a longer gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "player_id")
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "player_id", "n")
    )


def reseed_blocks(events: DataFrame, every: int = 8, late: str = LATE) -> DataFrame:
    """Rows and frames of each stretch between two seedings, ``every`` frames apart, with the keyframe that seeds it.

    The stretch is an event-time window as long as ``every`` frames, so the watermark drops its state.
    """
    seed = F.floor(F.col("frame") / every).cast("long")
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), seed.alias("seed"))
    return rows.agg(F.count("*").alias("n"), F.min("frame").alias("keyframe"), F.bit_or(F.expr(f"shiftleft(1L, cast(frame % {every} as int))")).alias("seen")).select(F.col("w.start").alias("day"), "seed", "n", "keyframe", "seen")


def live_ema(points: DataFrame, alpha: float = 0.5, late: str = LATE, idle: str = "1 day") -> DataFrame:
    """Exponential smoothing of each player's position over a stream (with ``ts`` and the ``place`` of a row in its frame).

    A player not seen for ``idle`` starts anew. Late rows come out unsmoothed.
    """
    rows = timed(points, late, "player_id", "frame", "place", "x")
    return rows.groupBy("player_id").transformWithStateInPandas(Smoother(idle, alpha), SMOOTHED, "append", "eventTime")
