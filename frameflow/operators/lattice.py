"""Possession under a lattice of settings (hold, reach, overlap), and the choice of settings by leaving one group out.

A frame's candidate is a step function of two limits: the player who holds most of the ball while that share is over the overlap limit, else the nearest
one while it is within reach. So a frame is four values whatever the lattice, and limits between which no frame of a clip steps give equal candidates. Runs are
found once for each distinct sequence of a clip. The hold needs no runs of its own: a run is confirmed if it has at least as many frames with a ball as the hold
and as its first genuine detection need, and all holds are counted in one grouping. The scene is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.boxes import Box, closest, containment
from frameflow.operators.possession import HALF, NOBODY

HOLDS, REACHES, OVERLAPS = (1, 2, 3, 4, 5, 6, 8, 10), (20.0, 30.0, 40.0, 50.0, 60.0, 80.0), (0.3, 0.5, 0.7, 0.8, 0.9)
COUNTS = ("n_right", "right_held", "right_empty", "right_real")


def steps(ball: DataFrame, players: DataFrame, reaches: Sequence[float], overlaps: Sequence[float]) -> DataFrame:
    """For each frame with a ball: the player with most of it and how many overlap limits are below that share (upper), and the nearest
    player and the number of the first reach beyond its distance (lower; as many as there are reaches if none is)."""
    near = ball.join(players.select("clip_no", "frame_idx", "track_id", "det_order", "x1", "y1", "x2", "y2"), ["clip_no", "frame_idx"], "left")
    own, box = Box.of(), Box.around(F.col("cx"), F.col("cy"), HALF)
    here = F.col("x1").isNotNull()
    most = F.min(F.when(here, F.struct((-containment(own, box)).alias("s"), "det_order", "track_id")))
    next_ = F.min(F.when(here, F.struct(closest(own, F.col("cx"), F.col("cy")).alias("s"), "det_order", "track_id")))
    best = near.groupBy("clip_no", "frame_idx", "confidence").agg(most.alias("a"), next_.alias("b"))
    count = lambda conditions: sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    return best.select("clip_no", "frame_idx", "confidence", F.col("a.track_id").alias("most_id"), count(-F.col("a.s") > v for v in overlaps).alias("upper"),
                       F.col("b.track_id").alias("near_id"), count(~F.coalesce(F.col("b.s") < v, F.lit(False)) for v in reaches).alias("lower"))


def sequences(found: DataFrame, n_reaches: int, n_overlaps: int) -> DataFrame:
    """For each clip and pair of limits (i, j) the first pair with the same candidates on all frames (first_i, first_j)."""
    present = found.groupBy("clip_no").agg(F.collect_set("upper").alias("us"), F.collect_set("lower").alias("ls"))
    last = lambda levels, k: F.coalesce(F.array_max(F.filter(levels, lambda v: v <= k)), F.lit(0))
    pairs = present.select("clip_no", "us", "ls", F.explode(F.sequence(F.lit(0), F.lit(n_overlaps - 1))).alias("i")).select("clip_no", "us", "ls", "i", F.explode(F.sequence(F.lit(0), F.lit(n_reaches - 1))).alias("j"))
    return pairs.select("clip_no", "i", "j", last(F.col("us"), F.col("i")).alias("first_i"), last(F.col("ls"), F.col("j")).alias("first_j"))


def lattice(frames: DataFrame, ball: DataFrame, players: DataFrame, truth: DataFrame, holds: Sequence[int] = HOLDS, reaches: Sequence[float] = REACHES, overlaps: Sequence[float] = OVERLAPS) -> DataFrame:
    """For each clip and setting: frames with a truth (n; n_held with a holder, n_empty without, n_real with a genuine detection) and how many of each are right. truth: clip_no,
    frame_idx, truth (nobody is -1); frames without a row there are not judged, but count for runs. Limits go in rising order."""
    holds, reaches, overlaps = sorted(holds), sorted(map(float, reaches)), sorted(map(float, overlaps))
    found = steps(ball, players, reaches, overlaps)
    pairs = sequences(found, len(reaches), len(overlaps))
    distinct = pairs.groupBy("clip_no").agg(F.collect_set(F.struct("first_i", "first_j")).alias("firsts"))
    spine = frames.select("clip_no", "frame_idx").join(found, ["clip_no", "frame_idx"], "left").join(truth.select("clip_no", "frame_idx", "truth"), ["clip_no", "frame_idx"], "left")
    # a clip without any ball has one sequence, of nobody
    none = F.array(F.struct(F.lit(0).alias("first_i"), F.lit(0).alias("first_j")))
    rows = spine.join(distinct, "clip_no", "left").select("*", F.explode(F.coalesce("firsts", none)).alias("f")).select("clip_no", "frame_idx", "truth", "confidence", "f.first_i", "f.first_j", F.when(
        F.col("confidence").isNotNull(), F.when(F.col("upper") > F.col("f.first_i"), F.col("most_id")).when(F.col("lower") <= F.col("f.first_j"), F.col("near_id")).otherwise(F.lit(NOBODY))).alias("c"))
    key = ["clip_no", "first_i", "first_j"]
    order = Window.partitionBy(*key).orderBy("frame_idx")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("c", ignorenulls=True).over(back)
    new = F.when(F.col("c").isNotNull() & ~F.col("c").eqNullSafe(before), 1).otherwise(0)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*key, "run")
    placed = runs.withColumn("place", F.count("c").over(whole.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)))
    known = placed.select(*key, "truth", "confidence", "c", "place", F.first("c", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("player"),
                          F.min(F.when(F.col("confidence") > 0, F.col("place"))).over(whole).alias("anchor"), F.count("c").over(whole).alias("size"))

    def counts(hold: int):
        need = F.greatest(F.lit(hold), F.col("anchor"))
        held = F.col("anchor").isNotNull() & (F.col("player") != NOBODY) & (F.col("size") >= need) & (F.col("c").isNotNull() | (F.col("place") < need))
        right = F.when(F.coalesce(held, F.lit(False)), F.col("player")).otherwise(F.lit(NOBODY)) == F.col("truth")
        own = {"n_right": right, "right_held": right & (F.col("truth") != NOBODY), "right_empty": right & (F.col("truth") == NOBODY), "right_real": right & (F.col("confidence") > 0)}
        return F.struct(F.lit(hold).alias("hold"), *[F.count_if(own[name]).alias(name) for name in COUNTS])

    judged = known.where("truth is not null").groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(F.col("truth") != NOBODY).alias("n_held"), F.count_if(F.col("confidence") > 0).alias("n_real"), F.array(*map(counts, holds)).alias("by_hold"))
    value = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    some = pairs.join(judged, key).select("clip_no", "i", "j", "n", "n_held", "n_real", "by_hold")
    empty = judged.join(pairs.select("clip_no").distinct(), "clip_no", "left_anti").select(
        "clip_no", F.explode(F.sequence(F.lit(0), F.lit(len(overlaps) - 1))).alias("i"), "n", "n_held", "n_real", "by_hold").select("clip_no", "i", F.explode(F.sequence(F.lit(0), F.lit(len(reaches) - 1))).alias("j"), "n", "n_held", "n_real", "by_hold")
    out = some.unionByName(empty).select("clip_no", value(overlaps, F.col("i")).alias("overlap"), value(reaches, F.col("j")).alias("reach"), "n", "n_held", "n_real", F.explode("by_hold").alias("h"))
    return out.select("clip_no", F.col("h.hold").alias("hold"), "reach", "overlap", "n", "n_held", "n_real", *[F.col(f"h.{c}").alias(c) for c in COUNTS])


def rates(scores: DataFrame) -> DataFrame:
    """Accuracies of lattice() as rates; null where there is nothing to judge."""
    c = F.col
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    empty = c("n") - c("n_held")
    return scores.select("clip_no", "hold", "reach", "overlap", "n", rate(c("n_right"), c("n")).alias("accuracy"), rate(c("right_held"), c("n_held")).alias("recall_held"), rate(c("right_empty"), empty).alias("spec_nobody"),
                         rate(empty - c("right_empty"), empty).alias("false_pos"), rate(c("right_real"), c("n_real")).alias("accuracy_real"), rate(c("n_right") - c("right_real"), c("n") - c("n_real")).alias("accuracy_filled"))


def leave_one_out(scores: DataFrame, fold: str, keys: Sequence[str], score: str) -> DataFrame:
    """For each fold the setting with the best mean score over the other folds (the first in key order on a tie), that mean, and the setting's own score on the fold.
    A mean over the others is the total less the fold's own: one pass, whatever the number of folds. Settings that a fold has no score for don't count there."""
    total = scores.groupBy(*keys).agg(F.sum(score).alias("t_sum"), F.count(score).alias("t_n"))
    same = None
    for k in keys:
        same = (F.col(f"t_{k}") == F.col(k)) if same is None else same & (F.col(f"t_{k}") == F.col(k))
    rows = scores.join(total.select(*[F.col(k).alias(f"t_{k}") for k in keys], "t_sum", "t_n"), same)
    # nine digits: sums in another order must not decide ties
    train = F.round(F.try_divide(F.col("t_sum") - F.coalesce(F.col(score), F.lit(0.0)), F.col("t_n") - F.when(F.col(score).isNotNull(), 1).otherwise(0)), 9)
    trained = rows.select(fold, *keys, F.col(score).alias("own"), train.alias("train")).where("train is not null")
    best = trained.groupBy(fold).agg(F.min(F.struct((-F.col("train")).alias("lost"), *keys, "own")).alias("b"))
    return best.select(fold, *[F.col(f"b.{k}").alias(k) for k in keys], F.round(-F.col("b.lost"), 6).alias("train_score"), F.round(F.col("b.own"), 6).alias("test_score"))
