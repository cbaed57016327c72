"""Streaming twins of the causal operators, with the same step functions as their batch forms.

State is kept for each clip and is bounded: a gate's last anchors, the last holder, the last sighting of each track. Rows of a clip must come
in frame order from batch to batch; within a batch they are sorted. Restarts resume from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameflow.operators import events, gates

ANCHORS = "frames array<int>, xs array<double>, ys array<double>"
CHANGE = "clip_no int, frame_idx int, last_frame int, from_track_id int, to_track_id int"
MOVE = "clip_no int, track_id int, frame_idx int, gap int, step_m double, total_m double"


def gated(ball: DataFrame, kind: str = "frozen") -> DataFrame:
    """Every detection of a stream with the gate's decision."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchors = list(zip(*state.get, strict=True)) if state.exists else []
        pdf = pd.concat(parts).sort_values("frame_idx")
        rows = list(zip(pdf["clip_no"].tolist(), pdf["frame_idx"].tolist(), pdf["cx"].tolist(), pdf["cy"].tolist(), pdf["confidence"].tolist(), strict=True))
        out, anchors = gates.fold(kind, rows, anchors)
        state.update(tuple([a[i] for a in anchors] for i in range(3)))
        yield gates.traced(out)

    rows = ball.select("clip_no", "frame_idx", "cx", "cy", "confidence")
    return rows.groupBy("clip_no").applyInPandasWithState(step, gates.TRACE, ANCHORS, "append", GroupStateTimeout.NoTimeout)


def transitions(possessed: DataFrame, max_gap: int = events.MAX_GAP) -> DataFrame:
    """Changes of holder in a stream of (clip_no, frame_idx, holder)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, frame = state.get if state.exists else (-1, -1)
        out = []
        pdf = pd.concat(parts).sort_values("frame_idx")
        for f, h in zip(pdf["frame_idx"].tolist(), pdf["holder"].tolist(), strict=True):
            if h == -1:
                continue
            if holder not in (-1, h) and f - frame <= max_gap:
                out.append((key[0], f, frame, holder, h))
            holder, frame = h, f
        state.update((holder, frame))
        yield pd.DataFrame(out, columns=["clip_no", "frame_idx", "last_frame", "from_track_id", "to_track_id"])

    rows = possessed.select("clip_no", "frame_idx", "holder")
    return rows.groupBy("clip_no").applyInPandasWithState(step, CHANGE, "holder int, frame int", "append", GroupStateTimeout.NoTimeout)


def distances(positions: DataFrame) -> DataFrame:
    """Step and distance so far of every sighting in a stream of (clip_no, track_id, frame_idx, x_m, y_m)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(parts).sort_values("frame_idx").itertuples(index=False):
            gap = d = None
            total = 0.0
            if last is not None:
                f, x, y, total = last
                gap, d = r.frame_idx - f, ((r.x_m - x) ** 2 + (r.y_m - y) ** 2) ** 0.5
                total += d
            out.append((key[0], key[1], r.frame_idx, gap, d, total))
            last = (int(r.frame_idx), float(r.x_m), float(r.y_m), float(total))
        state.update(last)
        yield pd.DataFrame(out, columns=["clip_no", "track_id", "frame_idx", "gap", "step_m", "total_m"]).astype({"gap": "Int32", "step_m": "Float64"})

    rows = positions.select("clip_no", "track_id", "frame_idx", "x_m", "y_m")
    return rows.groupBy("clip_no", "track_id").applyInPandasWithState(step, MOVE, "frame int, x double, y double, total double", "append", GroupStateTimeout.NoTimeout)
