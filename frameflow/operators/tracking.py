"""Multi-object tracking metrics: box candidates, association, CLEAR and identity metrics. The tracker is in tracker.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.functions.boxes import Box, iou
from frameflow.sources.store import table

LEAST = 0.5


def pairs(labels: DataFrame, tracks: DataFrame, least: float = LEAST) -> DataFrame:
    """Label and track boxes of one frame that overlap enough: an equi-join on clip and frame."""
    g = labels.select("clip_no", "frame_idx", "gt_id", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    t = tracks.select("clip_no", "frame_idx", "track_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    return g.join(t, ["clip_no", "frame_idx"]).select("clip_no", "frame_idx", "gt_id", "track_id", iou(Box.of("g_"), Box.of("t_")).alias("overlap")).where(F.col("overlap") >= least)


#: By how much a cost must be below all others of its row to be its one choice, whatever the last digits of the sums.
CLEAR = 1e-6


def outright(cost: np.ndarray) -> list[tuple[int, int]] | None:
    """The assignment if each row that has a finite cost has one that is clearly the cheapest and no two have it in the same column: nothing else is as cheap then. Else None."""
    first = cost.argmin(1)
    least = cost[np.arange(len(cost)), first]
    rows = np.flatnonzero(np.isfinite(least))
    own = first[rows]
    if len(set(own.tolist())) < len(rows) or (cost[rows] < least[rows, None] + CLEAR).sum() > len(rows):
        return None
    return list(zip(rows.tolist(), own.tolist(), strict=True))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns (shortest augmenting paths); infinite costs are never taken."""
    n, m = cost.shape
    if not n or not m:
        return []
    found = outright(cost)
    if found is None and (found := outright(cost.T)) is not None:
        found = sorted((b, a) for a, b in found)
    if found is not None:
        return found
    big = 1e6
    c = np.where(np.isfinite(cost), cost, big)
    flip = n > m
    c = c.T if flip else c
    n, m = c.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0, low, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = c[p[j0] - 1, free - 1] - u[p[j0]] - v[free]
            better = now < low[free]
            low[free[better]], way[free[better]] = now[better], j0
            j1 = free[int(np.argmin(low[free]))]
            d = low[j1]
            u[p[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [(int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j]]
    return sorted((b, a) if flip else (a, b) for a, b in out if c[a, b] < big)


ASSOCIATED = "clip_no int, frame_idx int, gt_id int, track_id int, overlap double, switched boolean"


def associate(candidates: DataFrame) -> DataFrame:
    """CLEAR association frame by frame: a label keeps its last track if they still overlap, the rest are assigned at least cost. A switch is a
    match with another track than the label's last one. Only candidate pairs reach the fold, one group a clip."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[int, int] = {}
        out = []
        for frame, rows in pdf.sort_values(["frame_idx", "gt_id", "track_id"]).groupby("frame_idx", sort=True):
            table = {(g, t): o for g, t, o in zip(rows["gt_id"], rows["track_id"], rows["overlap"], strict=True)}
            kept = {g: t for g, t in last.items() if (g, t) in table}
            gs, ts = sorted({g for g, _ in table} - kept.keys()), sorted({t for _, t in table} - set(kept.values()))
            cost = np.array([[1 - table[g, t] if (g, t) in table else np.inf for t in ts] for g in gs]).reshape(len(gs), len(ts))
            new = {gs[a]: ts[b] for a, b in assign(cost)}
            for g, t in sorted((kept | new).items()):
                out.append((key[0], frame, g, t, table[g, t], g in last and last[g] != t))
            last |= kept | new
        return pd.DataFrame(out, columns=["clip_no", "frame_idx", "gt_id", "track_id", "overlap", "switched"])

    return candidates.groupBy("clip_no").applyInPandas(one, ASSOCIATED)


def identities(candidates: DataFrame) -> DataFrame:
    """Frames correctly identified under the best one-to-one naming of labels and tracks, by clip."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gs, ts = sorted(pdf["gt_id"].unique()), sorted(pdf["track_id"].unique())
        cost = np.zeros((len(gs), len(ts)))
        for g, t, n in zip(pdf["gt_id"], pdf["track_id"], pdf["n"], strict=True):
            cost[gs.index(g), ts.index(t)] = -n
        return pd.DataFrame({"clip_no": [key[0]], "idtp": [int(-sum(cost[a, b] for a, b in assign(cost)))]})

    counts = candidates.groupBy("clip_no", "gt_id", "track_id").agg(F.count("*").alias("n"))
    return counts.groupBy("clip_no").applyInPandas(one, "clip_no int, idtp long")


def metrics(labels: DataFrame, tracks: DataFrame, least: float = LEAST, pooled: bool = False) -> DataFrame:
    """MOTA, MOTP (mean overlap), IDF1, switches, false positives, misses, precision and recall by clip, or over all
    clips from summed counts. Only labelled frames count; labels without any give zeros."""
    marked = labels.select("clip_no", "frame_idx").distinct()
    near = table(pairs(labels, tracks, least), "pairs")  # association and naming both read it
    count = lambda c: F.count(c).cast("long")
    n = labels.groupBy("clip_no").agg(count("*").alias("objects"))
    m = tracks.join(marked, ["clip_no", "frame_idx"], "left_semi").groupBy("clip_no").agg(count("*").alias("hypotheses"))
    a = associate(near).groupBy("clip_no").agg(count("*").alias("matches"), F.sum("overlap").alias("overlap"), F.count_if("switched").cast("long").alias("switches"))
    rows = n.join(m, "clip_no", "left").join(a, "clip_no", "left").join(identities(near), "clip_no", "left").na.fill(0)
    if pooled:
        rows = rows.agg(*[F.sum(c).alias(c) for c in rows.columns if c != "clip_no"]).select(F.lit(None).cast("int").alias("clip_no"), "*")
    c = F.col
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    misses, extra = c("objects") - c("matches"), c("hypotheses") - c("matches")
    return rows.select("clip_no", "objects", "matches", "switches", misses.alias("misses"), extra.alias("false_positives"), rate(c("objects") - misses - extra - c("switches"), c("objects")).alias("mota"),
                       rate(c("overlap"), c("matches")).alias("motp"), rate(2 * c("idtp"), c("objects") + c("hypotheses")).alias("idf1"), rate(c("matches"), c("hypotheses")).alias("precision"), rate(c("matches"), c("objects")).alias("recall"))
