"""Distance and speed of tracks on the court. A speed that cannot be measured is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEED_WINDOW, MAX_GAP, FPS = 5, 5, 30.0


#: Positions of an average task, where their number is known: their rows take few bytes in a shuffle and many times that when sorted.
ROWS = 500_000


def spread(positions: DataFrame, most: int) -> DataFrame:
    """Positions dealt by clip and track to as many tasks as their number (at most `most`) takes, and no fewer than there are cores."""
    parts = max(positions.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS))
    return positions.repartition(parts, "clip_no", "track_id")


def kinematics(positions: DataFrame, window: int = SPEED_WINDOW, max_gap: int = MAX_GAP, fps: float = FPS) -> DataFrame:
    """For each sighting: the gap and distance since the last one, the distance so far (all gaps count), and the speed over the
    last `window` frames. A gap of more than max_gap frames starts a new history and leaves that row without a speed. One shuffle, by
    clip and track, serves all windows."""
    order = Window.partitionBy("clip_no", "track_id").orderBy("frame_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    dx, dy = F.col("x_m") - F.lag("x_m").over(order), F.col("y_m") - F.lag("y_m").over(order)
    rows = positions.select("clip_no", "frame_idx", "track_id", "x_m", "y_m", (F.col("frame_idx") - F.lag("frame_idx").over(order)).alias("gap"), F.lag("frame_idx").over(order).alias("from_frame"), F.sqrt(dx * dx + dy * dy).alias("step_m"))
    long = F.col("gap") > max_gap
    rows = rows.select("*", F.coalesce(F.sum("step_m").over(so_far), F.lit(0.0)).alias("total_m"), F.sum(F.when(long, 1).otherwise(0)).over(so_far).alias("history"))
    near = Window.partitionBy("clip_no", "track_id", "history").orderBy("frame_idx").rangeBetween(-(window - 1), 0)
    kept = F.when(F.col("gap") <= max_gap, F.col("step_m"))
    begin = F.min(F.when(F.col("gap") <= max_gap, F.col("from_frame"))).over(near)
    speed = F.sum(kept).over(near) * F.lit(fps) / F.greatest(F.lit(1), F.col("frame_idx") - begin)
    return rows.select("clip_no", "frame_idx", "track_id", "gap", "step_m", "total_m", F.when(F.col("gap") <= max_gap, speed).alias("speed"), F.coalesce(long, F.lit(False)).alias("suppressed"))


def totals(moved: DataFrame) -> DataFrame:
    """Counts by clip and over all (clip_no null, tracks null there, as track ids mean nothing across clips)."""
    count = lambda c: F.count_if(c).cast("long")
    out = moved.rollup("clip_no").agg(
        F.grouping("clip_no").alias("all"), F.countDistinct("track_id").alias("n"), count(F.col("gap").isNotNull()).alias("displacements"),
        count(F.col("speed").isNotNull()).alias("speeds"), count(F.col("suppressed")).alias("suppressed_rows"))
    return out.select("clip_no", F.when(F.col("all") == 0, F.col("n")).cast("long").alias("tracks"), "displacements", "speeds", "suppressed_rows",
                      F.round(F.try_divide(F.col("speeds").cast("double"), F.col("displacements")), 6).alias("rate"))


def distances(moved: DataFrame) -> DataFrame:
    return moved.groupBy("clip_no", "track_id").agg(F.round(F.max("total_m"), 4).alias("distance_m"), F.count("*").cast("long").alias("sightings"))


def runs(flags: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """Maximal runs of consecutive frames on which the flag holds: clip (and further keys), first and last frame, length."""
    order = Window.partitionBy("clip_no", *keys).orderBy("frame_idx")
    islands = flags.where(flag).select("clip_no", *keys, "frame_idx", (F.col("frame_idx") - F.row_number().over(order)).alias("island"))
    return islands.groupBy("clip_no", *keys, "island").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").cast("long").alias("length")).drop("island")
