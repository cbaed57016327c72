"""Streams that keep more than a last row: possession with delayed confirmation, speed over a sliding window, and a tracker.

All keep their state in a store (values and lists, RocksDB) by clip, resume from the query's checkpoint after a restart and give the rows of their batch
forms however the stream is cut into batches. Rows of a key must come in frame order from batch to batch; within a batch they are sorted.
A key that has been silent for `idle` seconds of processing time is closed by a timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from frameflow.operators import tracker
from frameflow.operators.kinematics import FPS, MAX_GAP, SPEED_WINDOW
from frameflow.operators.possession import HOLD, NOBODY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "clip_no int, frame_idx int, holder int"
SPEED = "clip_no int, track_id int, frame_idx int, gap int, step_m double, total_m double, speed double, suppressed boolean"
#: Long enough for a pause between batches; a clip's own end mark closes it at once.
IDLE_S = 3_600.0


class Closing(StatefulProcessor):
    """What both share: a timer that is moved on with every batch of a key."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def wait(self, timer_values) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timer_values.getCurrentProcessingTimeInMs() + int(self.idle * 1000)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def rest(self) -> None:
        """The key is closed; its timer goes with it."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def close(self) -> None:
        pass


class Possession(Closing):
    """A clip's streak of one candidate. Frames of a streak that may yet be confirmed wait in a list; they go out as held when it is, as nobody's when it breaks or the
    clip ends. So a frame is late by its streak's length before confirmation at most, and the list is empty outside such a streak."""

    def __init__(self, hold: int, idle: float):
        super().__init__(idle)
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.streak = handle.getValueState("streak", "player int, length int, anchored boolean, sure boolean")
        self.waiting = handle.getListState("waiting", "frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        ended = bool(pdf["frame_idx"].isna().any())
        pdf = pdf[pdf["frame_idx"].notna()].sort_values("frame_idx")
        player, length, anchored, sure = self.streak.get() if self.streak.exists() else (NOBODY, 0, False, False)
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        had = bool(waiting)
        out: list[tuple[int, int]] = []
        for f, c, conf in zip(pdf["frame_idx"].astype(int).tolist(), pdf["candidate"].tolist(), pdf["confidence"].tolist(), strict=True):
            if pd.isna(c):  # no ball: part of a streak that may be confirmed, else nobody's
                if player != NOBODY and not sure:
                    waiting.append(f)
                else:
                    out.append((f, NOBODY))
                continue
            c = int(c)
            if c != player:
                out += [(w, NOBODY) for w in waiting]
                player, length, anchored, sure, waiting = c, 0, False, False, []
            if c == NOBODY:
                out.append((f, NOBODY))
                continue
            length, anchored = length + 1, anchored or conf > 0
            if sure:
                out.append((f, c))
                continue
            waiting.append(f)
            if length >= self.hold and anchored:
                out += [(w, c) for w in waiting]
                sure, waiting = True, []
        if ended:
            out += [(w, NOBODY) for w in waiting]
            self.forget()
        else:
            self.streak.update((player, length, bool(anchored), sure))
            if waiting:
                self.waiting.put([(w,) for w in waiting])
            elif had:
                self.waiting.clear()
            self.wait(timerValues)
        yield pd.DataFrame({"clip_no": key[0], "frame_idx": [f for f, _ in out], "holder": [h for _, h in out]}).astype("int32")

    def forget(self) -> None:
        self.streak.clear()
        self.waiting.clear()
        self.rest()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        self.due.clear()
        self.forget()
        yield pd.DataFrame({"clip_no": key[0], "frame_idx": waiting, "holder": NOBODY}).astype("int32")


class Speed(Closing):
    """The last sighting of each of a clip's tracks, its distance so far and the steps of its last few frames. The state is by clip: what a key costs (its state read and written, its timer, its
    frame of rows) is paid once for all of its tracks."""

    def __init__(self, window: int, max_gap: int, fps: float, idle: float):
        super().__init__(idle)
        self.window, self.max_gap, self.fps = window, max_gap, fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "track int, frame int, x double, y double, total double")
        self.steps = handle.getListState("steps", "track int, begin int, frame int, step double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = {r[0]: tuple(r)[1:] for r in self.last.get()} if self.last.exists() else {}
        steps: dict[int, list[tuple[int, int, float]]] = {}
        had = self.steps.exists()
        for r in self.steps.get() if had else ():
            steps.setdefault(r[0], []).append(tuple(r)[1:])
        pdf = pd.concat(list(rows)).sort_values(["track_id", "frame_idx"])
        out = []
        for track, f, x, y in zip(pdf["track_id"].tolist(), pdf["frame_idx"].tolist(), pdf["x_m"].tolist(), pdf["y_m"].tolist(), strict=True):
            before, gap, step, speed, total, far = last.get(track), None, None, None, 0.0, False
            if before is not None:
                gap, step = f - before[0], ((x - before[1]) ** 2 + (y - before[2]) ** 2) ** 0.5
                total, far = before[3] + step, gap > self.max_gap
                if far:
                    steps.pop(track, None)
                else:
                    near = steps[track] = [s for s in [*steps.get(track, ()), (before[0], f, step)] if s[1] > f - self.window]
                    speed = sum(s[2] for s in near) * self.fps / max(1, f - min(s[0] for s in near))
            out.append((track, f, gap, step, total, speed, far))
            last[track] = (f, x, y, total)
        self.last.put([(t, *v) for t, v in last.items()])
        kept = [(t, *s) for t, own in steps.items() for s in own]
        if kept:
            self.steps.put(kept)
        elif had:
            self.steps.clear()
        self.wait(timerValues)
        names = ["track_id", "frame_idx", "gap", "step_m", "total_m", "speed", "suppressed"]
        found = pd.DataFrame(out, columns=names).astype({"track_id": "int32", "frame_idx": "int32", "gap": "Int32", "step_m": "Float64", "speed": "Float64"})
        found.insert(0, "clip_no", pd.Series(key[0], index=found.index, dtype="int32"))
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        self.last.clear()
        self.steps.clear()
        yield pd.DataFrame({"clip_no": [], "track_id": [], "frame_idx": [], "gap": [], "step_m": [], "total_m": [], "speed": [], "suppressed": []}).astype(
            {"clip_no": "int32", "track_id": "int32", "frame_idx": "int32", "gap": "Int32", "step_m": "Float64", "total_m": "float64", "speed": "Float64", "suppressed": "bool"})


class Tracks(Closing):
    """A clip's tracker, kept whole between batches (tracks seen within the buffer, with their filters)."""

    def __init__(self, settings: dict, idle: float):
        super().__init__(idle)
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("tracker", "bytes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        one = pickle.loads(self.kept.get()[0]) if self.kept.exists() else tracker.Tracker(**self.settings)
        out = tracker.fold(one, int(key[0]), pd.concat(list(rows)))
        self.kept.update((pickle.dumps(one),))
        self.wait(timerValues)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        self.kept.clear()
        yield pd.DataFrame([], columns=tracker.NAMES).astype({c: "int32" for c in tracker.NAMES[:3]} | {c: "float64" for c in tracker.NAMES[3:]})


def tracked(detections: DataFrame, idle: float = IDLE_S, **settings) -> DataFrame:
    """tracker.track() for a stream of detections."""
    rows = detections.select("clip_no", "frame_idx", "det_order", "x1", "y1", "x2", "y2", "confidence")
    return rows.groupBy("clip_no").transformWithStateInPandas(Tracks(settings, idle), tracker.TRACKED, "append", "processingTime")


def possession(candidates: DataFrame, hold: int = HOLD, idle: float = IDLE_S) -> DataFrame:
    """The confirmed holder of every frame of a stream of (clip_no, frame_idx, candidate, confidence). candidate: a track, nobody (-1), or null on a frame without a ball. A row with a null
    frame_idx ends its clip. Each frame goes out once, when its holder is sure."""
    rows = candidates.select("clip_no", "frame_idx", "candidate", "confidence")
    return rows.groupBy("clip_no").transformWithStateInPandas(Possession(hold, idle), HELD, "append", "processingTime")


def speeds(positions: DataFrame, window: int = SPEED_WINDOW, max_gap: int = MAX_GAP, fps: float = FPS, idle: float = IDLE_S) -> DataFrame:
    """kinematics() for a stream of (clip_no, track_id, frame_idx, x_m, y_m). A track is forgotten with its clip, which is closed once none of its tracks has been seen for `idle` seconds."""
    rows = positions.select("clip_no", "track_id", "frame_idx", "x_m", "y_m")
    return rows.groupBy("clip_no").transformWithStateInPandas(Speed(window, max_gap, fps, idle), SPEED, "append", "processingTime")


def drained(made: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns the rows that it has written under path so far; another call with the same path goes on where
    this one ended. The state store is the one that lists and timers need, with as many parts as `partitions` (fixed by the first run)."""
    spark: SparkSession = made.sparkSession
    # without new rows a batch could only wait for timers, for ever; timers that are due run with the next rows
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = made.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(made.schema).parquet(f"{path}/rows")


def replayed(rows: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, cuts: list[int], partitions: int | None = None) -> DataFrame:
    """A stored table as a stream: its frames are added to a folder part by part, cut before the given frames (rows without a frame come last), and after each part
    the stream is started again from its checkpoint and runs over what is new. The result's rows are those of the batch operator."""
    spark = rows.sparkSession
    part = sum((F.when(F.col("frame_idx") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows.withColumn("part", F.when(F.col("frame_idx").isNull(), len(cuts)).otherwise(part)).write.partitionBy("part").parquet(f"{path}/parts")
    kept = spark.read.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).parquet(f"{path}/parts")
    out = None
    for k in range(len(cuts) + 1):
        kept.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/new")
        out = drained(make(spark.readStream.schema(rows.schema).parquet(f"{path}/new")), path, partitions)
    return out
