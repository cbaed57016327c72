"""Queries that run a stream over the scene, part by part with a restart between parts: J09, J10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.operators import possession
from frameflow.plans.game import FULL, PLACED, placed, rounded
from frameflow.plans.registry import query
from frameflow.sources import scene, store
from frameflow.streaming import stateful

#: Frames before which the streams are cut: within streaks and windows.
CUTS = [113, 338]
#: Parts of the state at least; on more cores as many as those, so that none of them waits.
PARTITIONS = 8


def parts(spark: SparkSession) -> int:
    return max(PARTITIONS, spark.sparkContext.defaultParallelism)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of every frame, null on frames without a ball, and an end mark for every clip."""
    frames = scene.frames(spark, sf_dir).select("clip_no", "frame_idx")
    found = possession.holders(possession.fill(frames, scene.ball(spark, sf_dir)), scene.players(spark, sf_dir))
    rows = frames.join(found, ["clip_no", "frame_idx"], "left").select("clip_no", "frame_idx", "candidate", "confidence")
    return rows.unionByName(frames.select("clip_no").distinct().selectExpr("clip_no", "cast(null as int) as frame_idx", "cast(null as int) as candidate", "cast(null as double) as confidence"))


@query(FULL + "SELECT clip_no, frame_idx, holder FROM possession")
def j09_streamed_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f09_possession from a stream in three parts, started anew for each: held-back frames wait in the state store in between."""
    return stateful.replayed(candidates(spark, sf_dir), stateful.possession, store.workplace(spark, "possession"), CUTS, parts(spark))


@query(PLACED + "SELECT clip_no, frame_idx, track_id, gap, round(step_m, 4) AS step_m, round(total_m, 4) AS total_m, round(speed, 4) AS speed, suppressed FROM moved")
def j10_streamed_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f02_f04_kinematics from a stream in three parts."""
    return rounded(stateful.replayed(placed(spark, sf_dir), stateful.speeds, store.workplace(spark, "speeds"), CUTS, parts(spark)), 4)
