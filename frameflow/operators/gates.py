"""Gates: which ball detections are kept, before any position is made up.

Five causal gates share one step function over the last accepted anchors; each clip is a group, folded in frame order. The
step is also what the streaming twin runs. The trajectory gate looks at the whole clip: a cheapest path through its detections, found
with one vectorised step over the last frames for each detection.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TRAVEL = 25.0
BASE, GROWTH, HISTORY, SPAN = 40.0, 15.0, 4, 8
STALE = 8
RECENT, MAX_ANGLE, MIN_SPEED, SPEED_RATIO, SPEED_CAP = 3, 90.0, 5.0, 3.0, 60.0
FRESH_GAP, FRESH_SPAN = 8, 8
MAX_SPEED, SKIP, MAX_GAP = 100.0, 1000.0, 45
#: Detections whose hops are worked out at once.
HOPS = 1024

TRACE = "clip_no int, frame_idx int, cx double, cy double, confidence double, accepted boolean, path string, anchor_frame int, frame_gap int, distance double, tolerance double"
Anchor = tuple[int, float, float]


def predicted(anchors: list[Anchor], gap: int, span: int = SPAN) -> tuple[float, float] | None:
    """Where the anchors' least-squares velocity leads in `gap` frames; None with too few anchors or too long a span."""
    if len(anchors) < 2 or anchors[-1][0] - anchors[0][0] > span:
        return None
    # a handful of anchors: plain numbers, in order
    n, s, sx, sy = len(anchors), 0.0, 0.0, 0.0
    f, x, y = (sum(v) / n for v in zip(*anchors, strict=True))
    for g, a, b in anchors:
        d = g - f
        s, sx, sy = s + d * d, sx + d * (a - x), sy + d * (b - y)
    return anchors[-1][1] + gap * (sx / s), anchors[-1][2] + gap * (sy / s)


def consistent(anchors: list[Anchor], now: Anchor) -> tuple[bool, str]:
    """Speed and direction against the net velocity from the oldest to the newest anchor."""
    if len(anchors) < 2:
        return True, "inconclusive: few anchors"
    (f0, x0, y0), (f1, x1, y1), (f2, x2, y2) = anchors[0], anchors[-1], now
    if f1 <= f0 or f2 <= f1:
        return True, "inconclusive: no gap"
    vx, vy, wx, wy = (x1 - x0) / (f1 - f0), (y1 - y0) / (f1 - f0), (x2 - x1) / (f2 - f1), (y2 - y1) / (f2 - f1)
    v, w = math.sqrt(vx * vx + vy * vy), math.sqrt(wx * wx + wy * wy)
    if w > max(v * SPEED_RATIO, SPEED_CAP):
        return False, "inconsistent: speed"
    if v >= MIN_SPEED and w >= MIN_SPEED and math.degrees(math.acos(max(-1.0, min(1.0, (vx * wx + vy * wy) / (v * w))))) > MAX_ANGLE:
        return False, "inconsistent: direction"
    return True, "consistent"


def step(kind: str, anchors: list[Anchor], now: Anchor) -> tuple[bool, str, float | None, float | None]:
    """Whether `now` is accepted, by which rule, its distance and the tolerance. kind: frozen, predicted, stale, motion, combined."""
    if kind == "motion":
        ok, why = consistent(anchors, now)
        return ok, why, None, None
    if not anchors:
        return True, "seed", None, None
    f, x, y = anchors[-1]
    gap = now[0] - f
    if kind == "stale" and gap > STALE:
        return True, "stale reset", None, None
    aim = predicted(anchors, gap) if kind == "predicted" else None
    tolerance = BASE + GROWTH * gap if aim else TRAVEL * gap
    ax, ay = aim or (x, y)
    d = math.sqrt((now[1] - ax) ** 2 + (now[2] - ay) ** 2)
    if d > tolerance:
        return False, "predicted" if aim else "frozen", d, tolerance
    if kind == "combined" and gap <= FRESH_GAP and len(anchors) >= 2 and anchors[-1][0] - anchors[0][0] <= FRESH_SPAN:
        ok, why = consistent(anchors, now)
        return ok, why, d, tolerance
    return True, "predicted" if aim else "frozen", d, tolerance


#: How many accepted anchors each gate remembers.
KEPT = {"frozen": 1, "stale": 1, "predicted": HISTORY, "motion": RECENT, "combined": RECENT}


def fold(kind: str, rows: list[tuple], anchors: list[Anchor]) -> tuple[list[tuple], list[Anchor]]:
    """rows of (clip, frame, x, y, confidence) in frame order, through the gate; trace rows and the anchors left."""
    out = []
    for clip, f, x, y, c in rows:
        ok, path, d, tol = step(kind, anchors, (f, x, y))
        before = anchors[-1][0] if anchors else None
        out.append((clip, f, x, y, c, ok, path, before, None if before is None else f - before, d, tol))
        if ok:
            anchors = [*anchors, (f, x, y)][-KEPT[kind] :]
    return out, anchors


COLUMNS = [c.split()[0] for c in TRACE.split(",")]


def traced(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=COLUMNS)
    return pdf.astype({"anchor_frame": "Int32", "frame_gap": "Int32", "distance": "Float64", "tolerance": "Float64"})


def trace(ball: DataFrame, kind: str = "frozen") -> DataFrame:
    """Every detection with the gate's decision and its reason."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        rows = list(zip(pdf["clip_no"].tolist(), pdf["frame_idx"].tolist(), pdf["cx"].tolist(), pdf["cy"].tolist(), pdf["confidence"].tolist(), strict=True))
        return traced(fold(kind, rows, [])[0])

    return ball.select("clip_no", "frame_idx", "cx", "cy", "confidence").groupBy("clip_no").applyInPandas(one, TRACE)


def traces(ball: DataFrame) -> DataFrame:
    """Every detection with the decision of each causal gate (column `gate`): one shuffle and one fold of a clip for all of them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        rows = list(zip(pdf["clip_no"].tolist(), pdf["frame_idx"].tolist(), pdf["cx"].tolist(), pdf["cy"].tolist(), pdf["confidence"].tolist(), strict=True))
        return pd.concat([traced(fold(kind, rows, [])[0]).assign(gate=kind) for kind in KEPT])

    return ball.select("clip_no", "frame_idx", "cx", "cy", "confidence").groupBy("clip_no").applyInPandas(one, TRACE + ", gate string")


def gate(ball: DataFrame, kind: str = "frozen") -> DataFrame:
    """The accepted detections."""
    return trace(ball, kind).where("accepted").select("clip_no", "frame_idx", "cx", "cy", "confidence")


def best_path(frame: np.ndarray, x: np.ndarray, y: np.ndarray, speed: float = MAX_SPEED, skip: float = SKIP, gap: int = MAX_GAP) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Detections on the cheapest path, each one's cost and predecessor (-1: none). Only the detections of the last `gap` frames are looked at one by one; of those before, whose hops cost
    fees only, one running minimum is enough, so that the time is linear in the clip. A hop costs its squared length over its frames and a
    fee for each detection left out; hops beyond the speed are out of the question; after a long silence a hop is free of
    motion cost. On equal cost the first predecessor and the first end win."""
    n = len(frame)
    best, parent = skip * np.arange(n, dtype=float), np.full(n, -1)
    begin = np.searchsorted(frame, frame - gap, "left")
    for a in range(0, n, HOPS):
        b = min(n, a + HOPS)
        most = int((np.arange(a, b) - begin[a:b]).max())
        # the hops to each detection from the last ones before it, in their order; none from those that are too far back
        to = np.arange(a, b)[:, None]
        before = to - most + np.arange(most)
        use = np.maximum(before, 0)
        g = (frame[to] - frame[use]).astype(float)
        d = np.sqrt((x[use] - x[to]) ** 2 + (y[use] - y[to]) ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            hop = np.where((before < begin[to]) | (d > speed * g), np.inf, d * d / g + skip * (to - before - 1))
        if a == 0:
            low, far, far_value = 0, -1, np.inf
        for j in range(max(a, 1), b):
            while low < begin[j]:
                if best[low] - skip * low < far_value:
                    far, far_value = low, best[low] - skip * low
                low += 1
            at, cost = far, best[far] + skip * (j - far - 1) if far >= 0 else np.inf
            if low < j:
                near = best[low:j] + hop[j - a, most - (j - low) :]
                i = int(near.argmin())
                if near[i] < cost:
                    at, cost = low + i, near[i]
            if cost < best[j]:
                best[j], parent[j] = cost, at
    at = int(np.argmin(best + skip * (n - 1 - np.arange(n)))) if n else -1
    path = []
    while at != -1:
        path.append(at)
        at = int(parent[at])
    return path[::-1], best, parent


def trajectory(ball: DataFrame, speed: float = MAX_SPEED, skip: float = SKIP, gap: int = MAX_GAP) -> DataFrame:
    """Every detection with whether it is on its clip's cheapest path, and the cost to reach it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx").reset_index(drop=True)
        path, best, _ = best_path(pdf["frame_idx"].to_numpy(), pdf["cx"].to_numpy(), pdf["cy"].to_numpy(), speed, skip, gap)
        pdf["on_path"], pdf["cost"] = False, best
        pdf.loc[path, "on_path"] = True
        return pdf

    rows = ball.select("clip_no", "frame_idx", "cx", "cy", "confidence")
    return rows.groupBy("clip_no").applyInPandas(one, "clip_no int, frame_idx int, cx double, cy double, confidence double, on_path boolean, cost double")


def trajectory_gate(ball: DataFrame, **limits: float) -> DataFrame:
    return trajectory(ball, **limits).where("on_path").select("clip_no", "frame_idx", "cx", "cy", "confidence")
