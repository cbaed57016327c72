"""Passes and interceptions from possession, and their scoring against labelled events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP, TOLERANCE = 30, 10
#: Labelled event types and the kind a detector can find; other types are left out of the score.
KINDS = {"pass": "pass", "interception": "interception", "steal": "interception"}
PREDICTED = "clip_no int, frame_idx int, kind string, team int, from_track_id int, to_track_id int"


def resolved(team: Column) -> Column:
    """1, 2 or 0 for all else."""
    return F.when(team.isin(1, 2), team).otherwise(F.lit(0))


def classified(from_team: Column, to_team: Column) -> Column:
    return F.when((from_team == 0) | (to_team == 0), "unclassified").when(from_team == to_team, "pass").otherwise("interception")


def transitions(possessed: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Changes of holder with at most max_gap frames between; a longer silence makes the new holder known without an event."""
    order = Window.partitionBy("clip_no").orderBy("frame_idx")
    held = possessed.where("holder <> -1").select("clip_no", "frame_idx", "holder", F.lag("holder").over(order).alias("from_track_id"), F.lag("frame_idx").over(order).alias("last_frame"))
    return held.where((F.col("holder") != F.col("from_track_id")) & (F.col("frame_idx") - F.col("last_frame") <= max_gap)).select("clip_no", "frame_idx", "last_frame", "from_track_id", F.col("holder").alias("to_track_id"))


def detected(changes: DataFrame, teams: DataFrame) -> DataFrame:
    """Changes with both teams: the old holder's where it was last seen, the new one's now; kind by them."""
    t = teams.select("clip_no", "frame_idx", "track_id", "team")
    old = t.select("clip_no", F.col("frame_idx").alias("last_frame"), F.col("track_id").alias("from_track_id"), resolved(F.col("team")).alias("from_team"))
    new = t.select("clip_no", "frame_idx", F.col("track_id").alias("to_track_id"), resolved(F.col("team")).alias("to_team"))
    rows = changes.join(old, ["clip_no", "last_frame", "from_track_id"], "left").join(new, ["clip_no", "frame_idx", "to_track_id"], "left").na.fill(0, ["from_team", "to_team"])
    return rows.select("clip_no", "frame_idx", classified(F.col("from_team"), F.col("to_team")).alias("kind"), "from_track_id", "to_track_id", "from_team", "to_team")


def labelled(labels: DataFrame) -> DataFrame:
    """Labels as comparable columns: kind (null: not scored), team credited (null: unclear), ids (null: unknown)."""
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("event_type")]
    team = F.when(F.col("event_type").isin("interception", "steal"), F.col("to_team")).otherwise(F.col("from_team"))
    return labels.select("clip_no", "start_frame", "end_frame", "event_type", kind.alias("kind"), team.try_cast("int").alias("team"), F.col("from_track_id").try_cast("int").alias("from_id"), F.col("to_track_id").try_cast("int").alias("to_id"))


def choices(settings: tuple[tuple[int, bool], ...]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("tolerance"), F.lit(s).alias("strict")) for t, s in settings])


def candidates(labels: DataFrame, found: DataFrame, settings: tuple[tuple[int, bool], ...] = ((TOLERANCE, False),)) -> DataFrame:
    """Pairs of a scored label and an event of its kind and team within its frames and the tolerance: an equi-join on clip,
    kind and a bucket of frames (each label stands in all buckets it reaches), not a product. settings: tolerances, each with
    whether known ids must agree; labels stand once for each, so that a sweep reads its input once."""
    width = 64
    l = labelled(labels).where("kind is not null").withColumn("label_no", F.row_number().over(Window.partitionBy("clip_no").orderBy("start_frame", "end_frame", "event_type", "from_id", "to_id")))  # noqa: E741
    each = l.withColumn("s", F.explode(choices(settings))).select("*", "s.*")
    tolerance = F.col("tolerance")
    reach = each.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start_frame") - tolerance) / width), F.floor((F.col("end_frame") + tolerance) / width))))
    p = found.where("kind <> 'unclassified'").select("clip_no", "kind", "frame_idx", F.when(F.col("kind") == "pass", F.col("from_team")).otherwise(F.col("to_team")).alias("p_team"), "from_track_id", "to_track_id", F.floor(F.col("frame_idx") / width).alias("bucket"))
    near = (F.col("frame_idx") >= F.col("start_frame") - tolerance) & (F.col("frame_idx") <= F.col("end_frame") + tolerance)
    same = F.col("team").isNull() | (F.col("team") == F.col("p_team"))
    ids = ~F.col("strict") | (F.col("from_id").isNull() | (F.col("from_id") == F.col("from_track_id"))) & (F.col("to_id").isNull() | (F.col("to_id") == F.col("to_track_id")))
    pairs = reach.join(p, ["clip_no", "kind", "bucket"]).where(near & same & ids)
    away = F.greatest(F.col("start_frame") - F.col("frame_idx"), F.col("frame_idx") - F.col("end_frame"), F.lit(0))
    return pairs.select("clip_no", "tolerance", "strict", "label_no", "start_frame", "end_frame", "kind", "frame_idx", "from_track_id", "to_track_id", away.alias("away"))


def matched(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment: labels in order, each takes the nearest event left (the earlier on a tie). Only candidate pairs reach the fold."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for _, group in pdf.sort_values(["label_no", "away", "frame_idx", "from_track_id", "to_track_id"]).groupby("label_no", sort=True):
            for row in group.itertuples():
                if (row.frame_idx, row.kind) not in used:
                    used.add((row.frame_idx, row.kind))
                    keep.append(row.Index)
                    break
        return pdf.loc[keep]

    return pairs.groupBy("clip_no", "tolerance", "strict").applyInPandas(one, pairs.schema)


def scores(labels: DataFrame, found: DataFrame, tolerance: int = TOLERANCE, strict_ids: bool = False) -> DataFrame:
    return sweep(labels, found, ((tolerance, strict_ids),)).drop("strict")


def sweep(labels: DataFrame, found: DataFrame, settings: tuple[tuple[int, bool], ...]) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 by clip and setting (null where nothing is to divide by)."""
    n_labels = labelled(labels).groupBy("clip_no").agg(F.count_if(F.col("kind").isNotNull()).cast("long").alias("n_labels"))
    n_found = found.groupBy("clip_no").agg(F.count_if(F.col("kind") != "unclassified").cast("long").alias("n_found"))
    hits = matched(candidates(labels, found, settings)).groupBy("clip_no", "tolerance", "strict").agg(F.count("*").cast("long").alias("tp"))
    each = n_labels.join(n_found, "clip_no", "full").withColumn("s", F.explode(choices(settings))).select("clip_no", "n_labels", "n_found", "s.*")
    rows = each.join(hits, ["clip_no", "tolerance", "strict"], "left").na.fill(0)
    tp, n, m = F.col("tp"), F.col("n_labels"), F.col("n_found")
    return rows.select("clip_no", "tolerance", "strict", "tp", (m - tp).alias("fp"), (n - tp).alias("fn"), F.round(F.try_divide(tp.cast("double"), m), 3).alias("precision"),
                       F.round(F.try_divide(tp.cast("double"), n), 3).alias("recall"), F.round(F.try_divide(2.0 * tp, n + m), 3).alias("f1"))
