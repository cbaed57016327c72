"""Camera motion from frame to frame: a similarity (scale, rotation, shift) between the landmarks of successive frames, robust against outliers.

Points are complex numbers, so a similarity is z -> m z + t. Each pair of points proposes one; the proposal with most points within the threshold wins (the smaller sum of
their squared errors on a tie), and is fitted again to those points by least squares. Up to SAMPLES pairs all are tried, so that no seed matters; beyond
that pairs are drawn by a generator seeded with the clip and frame, so that a lost task gives the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.court import by_size

#: Fewest matched points, error of an inlier in pixels, proposals for one pair of frames, rows that are fitted at a time.
FEWEST, NEAR_PX, SAMPLES, STACK = 4, 3.0, 300, 256
SHIFT_PX = 10.0
MOTION = "clip_no int, frame_idx int, last_frame int, n int, status string, inliers int, dx double, dy double, scale double, angle double"


def matched(keypoints: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each frame but a clip's first: the frame before it and the landmarks that are confident in both, as an array of idx, from and to places (empty if there are none). The frame before
    is the last one that the clip has, next to it or not."""
    order = Window.partitionBy("clip_no").orderBy("frame_idx")
    pairs = keypoints.select("clip_no", "frame_idx").distinct().withColumn("last_frame", F.lag("frame_idx").over(order)).where("last_frame is not null")
    good = keypoints.where((F.col("confidence") >= threshold) & F.col("x").isNotNull() & F.col("y").isNotNull())
    now = good.select("clip_no", "frame_idx", "idx", F.col("x").alias("u"), F.col("y").alias("v")).join(pairs, ["clip_no", "frame_idx"])
    before = good.select("clip_no", F.col("frame_idx").alias("last_frame"), "idx", "x", "y")
    points = now.join(before, ["clip_no", "last_frame", "idx"]).groupBy("clip_no", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "u", "v"))).alias("points"))
    none = F.expr("cast(array() as array<struct<idx:int,x:double,y:double,u:double,v:double>>)")
    return pairs.join(points, ["clip_no", "frame_idx"], "left").select("clip_no", "frame_idx", "last_frame", F.coalesce("points", none).alias("points"))


def proposals(n: int, seeds: list[tuple[int, int]]) -> np.ndarray:
    """Pairs of points for each row: all of them, or as many drawn ones."""
    if n * (n - 1) // 2 <= SAMPLES:
        return np.broadcast_to(np.array(list(combinations(range(n), 2))), (len(seeds), n * (n - 1) // 2, 2))
    out = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, n, SAMPLES)
        out.append(np.stack([a, (a + rng.integers(1, n, SAMPLES)) % n], 1))
    return np.array(out)


def fit_similarities(z: np.ndarray, w: np.ndarray, pairs: np.ndarray, near: float = NEAR_PX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """m, t and inliers (rows x points) of each row; m is NaN where no two points differ."""
    r = np.arange(len(z))[:, None]
    i, j = pairs[:, :, 0], pairs[:, :, 1]
    apart = z[r, j] - z[r, i]
    sound = np.abs(apart) > 1e-9
    m = np.where(sound, w[r, j] - w[r, i], 0) / np.where(sound, apart, 1)
    t = w[r, i] - m * z[r, i]
    error = np.abs(m[:, :, None] * z[:, None, :] + t[:, :, None] - w[:, None, :])
    inside = (error <= near) & sound[:, :, None]
    count, loss = inside.sum(2), (np.where(inside, error, 0.0) ** 2).sum(2)
    best = np.where(count == count.max(1, keepdims=True), loss, np.inf).argmin(1)
    own = inside[np.arange(len(z)), best]
    size = own.sum(1)
    some = np.maximum(size, 1)
    zc, wc = (z * own).sum(1) / some, (w * own).sum(1) / some
    dz, dw = (z - zc[:, None]) * own, (w - wc[:, None]) * own
    spread = (np.abs(dz) ** 2).sum(1)
    fitted = np.where(spread > 1e-12, (np.conj(dz) * dw).sum(1) / np.where(spread > 1e-12, spread, 1.0), np.nan)
    return fitted, wc - fitted * zc, own


def motion(pairs: DataFrame, centre: tuple[float, float], fewest: int = FEWEST, near: float = NEAR_PX) -> DataFrame:
    """For each row of matched(): the shift of the image centre in pixels, scale and angle (degrees), and how many points agree. The status is few points, degenerate
    (no two of them apart, or fewer than `fewest` agree) or ok; only an ok row has a motion. The centre's shift is not the map's own t, which is that of a corner."""
    c = complex(*centre)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf["points"].tolist()
            out = pdf[["clip_no", "frame_idx", "last_frame"]].assign(n=[len(p) for p in points], status="few points", inliers=0)
            values = np.full((len(pdf), 4), np.nan)
            status, inliers = out["status"].tolist(), out["inliers"].tolist()
            keys = list(zip(pdf["clip_no"].astype(int).tolist(), pdf["frame_idx"].astype(int).tolist(), strict=True))
            for size, at in by_size(points).items():
                if size < max(2, fewest):
                    continue
                for k in range(0, len(at), STACK):
                    some = at[k : k + STACK]
                    flat = np.array([[(p["x"], p["y"], p["u"], p["v"]) for p in points[i]] for i in some], float)
                    z, w = flat[:, :, 0] + 1j * flat[:, :, 1], flat[:, :, 2] + 1j * flat[:, :, 3]
                    m, t, own = fit_similarities(z, w, proposals(size, [keys[i] for i in some]), near)
                    moved = m * c + t - c
                    for i, mm, d, agree in zip(some, m, moved, own.sum(1).tolist(), strict=True):
                        good = agree >= max(2, fewest) and np.isfinite(mm)
                        status[i], inliers[i] = ("ok" if good else "degenerate"), agree
                        if good:
                            values[i] = d.real, d.imag, abs(mm), np.degrees(np.angle(mm))
            out = out.assign(status=status, inliers=inliers)
            yield out.assign(**{name: pd.Series(values[:, k], index=out.index).astype("Float64") for k, name in enumerate(("dx", "dy", "scale", "angle"))})

    return pairs.mapInPandas(run, MOTION)


def summary(moved: DataFrame, over: float = SHIFT_PX) -> DataFrame:
    """For each clip: pairs of frames, those with a motion, median and 95th percentile of the shift without its sign (a pan to the left moves the court as much as one to the right), median and
    largest change of scale, and frames whose shift is over the limit."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    dx, ds = F.abs(F.col("dx")), F.abs(F.col("scale") - 1)
    return moved.groupBy("clip_no").agg(F.count("*").alias("frame_pairs"), F.count("dx").alias("estimated"), q(dx, 0.5).alias("median_dx"), q(dx, 0.95).alias("p95_dx"), q(ds, 0.5).alias("median_scale"), F.max(ds).alias("largest_scale"), F.count_if(dx > over).alias("over_limit"))
