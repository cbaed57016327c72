"""Gap filling, holders, possession and its shares. Windows and grouped minima by clip; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.boxes import Box, closest, containment

HALF = 6.0
OVERLAP, REACH, HOLD = 0.8, 50.0, 5
NOBODY = -1


def fill(frames: DataFrame, ball: DataFrame) -> DataFrame:
    """A ball for every frame of a clip that has one at all: linear between detections, the nearest one before the first and after
    the last. Made-up rows have confidence 0. Genuine rows stay as they are."""
    rows = frames.select("clip_no", "frame_idx").join(ball.select("clip_no", "frame_idx", "cx", "cy", "confidence"), ["clip_no", "frame_idx"], "left")
    order = Window.partitionBy("clip_no").orderBy("frame_idx")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    seen = lambda c: F.when(F.col("confidence").isNotNull(), c)
    both = rows.select(
        "*", *[F.last(seen(F.col(c)), ignorenulls=True).over(back).alias(f"{c}_0") for c in ("frame_idx", "cx", "cy")],
        *[F.first(seen(F.col(c)), ignorenulls=True).over(ahead).alias(f"{c}_1") for c in ("frame_idx", "cx", "cy")])

    def value(c: str):
        a, b, f0, f1 = F.col(f"{c}_0"), F.col(f"{c}_1"), F.col("frame_idx_0"), F.col("frame_idx_1")
        inside = a + (b - a) * (F.col("frame_idx") - f0) / (f1 - f0)
        return F.coalesce(F.col(c), F.when(f0.isNotNull() & f1.isNotNull(), inside), a, b).alias(c)

    return both.select("clip_no", "frame_idx", value("cx"), value("cy"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                       F.col("confidence").isNotNull().alias("is_real")).where("cx is not null")


def holders(ball: DataFrame, players: DataFrame, overlap: float = OVERLAP, reach: float = REACH) -> DataFrame:
    """For each ball its holder: the player who contains most of it (over `overlap`), else the closest (under `reach`), else nobody.
    Ties go to the player listed first. One equi-join and one grouped minimum, pre-aggregated before its shuffle."""
    near = ball.join(players.select("clip_no", "frame_idx", "track_id", "det_order", "x1", "y1", "x2", "y2"), ["clip_no", "frame_idx"], "left")
    own, box = Box.of(), Box.around(F.col("cx"), F.col("cy"), HALF)
    inside, far = containment(own, box), closest(own, F.col("cx"), F.col("cy"))
    rank = F.when(F.col("x1").isNotNull() & (inside > overlap), F.struct(F.lit(0).alias("tier"), (-inside).alias("score"), "det_order", "track_id")).when(
        F.col("x1").isNotNull() & (far < reach), F.struct(F.lit(1).alias("tier"), far.alias("score"), "det_order", "track_id"))
    best = near.groupBy("clip_no", "frame_idx", "confidence").agg(F.min(rank).alias("best"))
    return best.select("clip_no", "frame_idx", "confidence", F.coalesce("best.track_id", F.lit(NOBODY)).alias("candidate"))


def possession(frames: DataFrame, candidates: DataFrame, hold: int = HOLD) -> DataFrame:
    """The confirmed holder of every frame. A streak of one candidate over the frames with a ball is confirmed at the first
    frame that is at least its hold-th and has a genuine detection somewhere in the streak before it; the holder then counts from the streak's start,
    frames without a ball included, and after confirmation on frames with a ball."""
    order = Window.partitionBy("clip_no").orderBy("frame_idx")
    changed = F.when(F.lag("candidate").over(order) == F.col("candidate"), 0).otherwise(1)
    runs = candidates.withColumn("run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("clip_no", "run").orderBy("frame_idx")
    whole = Window.partitionBy("clip_no", "run")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    known = runs.select("*", F.row_number().over(within).alias("place"), F.max(F.when(F.col("confidence") > 0, 1).otherwise(0)).over(so_far).alias("anchored"), F.min("frame_idx").over(whole).alias("begin"))
    sure = known.withColumn("confirmed", F.min(F.when((F.col("candidate") != NOBODY) & (F.col("place") >= hold) & (F.col("anchored") == 1), F.col("frame_idx"))).over(whole))
    later = sure.where("frame_idx > confirmed").select("clip_no", "frame_idx", F.col("candidate").alias("holder"))
    spans = sure.where("frame_idx = confirmed").select("clip_no", F.explode(F.sequence("begin", "confirmed")).alias("frame_idx"), F.col("candidate").alias("holder"))
    held = later.unionByName(spans)
    return frames.select("clip_no", "frame_idx").join(held, ["clip_no", "frame_idx"], "left").select("clip_no", "frame_idx", F.coalesce("holder", F.lit(NOBODY)).alias("holder"))


def share(possessed: DataFrame, teams: DataFrame) -> DataFrame:
    """Frames by team of the holder, with rates over the frames that have a team; null where there are none."""
    team = teams.select("clip_no", "frame_idx", F.col("track_id").alias("holder"), "team")
    rows = possessed.join(team, ["clip_no", "frame_idx", "holder"], "left")
    count = lambda c: F.count_if(c).cast("long")
    held = F.col("holder") != NOBODY
    out = rows.groupBy("clip_no").agg(
        F.count("*").cast("long").alias("n_frames"), count(held & (F.col("team") == 1)).alias("team_1"), count(held & (F.col("team") == 2)).alias("team_2"),
        count(~held).alias("no_holder"), count(held & ~F.coalesce(F.col("team").isin(1, 2), F.lit(False))).alias("unlabelled"))
    both = F.col("team_1") + F.col("team_2")
    return out.select("*", F.round(F.try_divide("team_1", both), 6).alias("share_1"), F.round(F.try_divide(both, F.col("n_frames") - F.col("no_holder")), 6).alias("attributed"))
