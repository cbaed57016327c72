"""A tracker of boxes in two stages with a Kalman filter for each track.

A track is centre, aspect and height of its box with their velocities, and a covariance. Each frame all tracks are predicted; confident boxes are matched first, by overlap times
confidence, with tracks that are seen or lost; what is left of the seen tracks may take the boxes of low confidence. A confident box that nobody takes starts
a track, which counts once it is matched again (at once on a clip's first frame) and has an id after `steady` sightings in a row. A track that is not matched is
lost, is predicted on without growing, and is removed after the buffer (in frames at 30 a second, scaled to the clip's rate). Of a seen and a
lost track in the same place the younger goes.

A clip is one fold (bounded by its length); the same Tracker is kept in the state of a stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from frameflow.operators.tracking import assign

#: Noise of the filter, as shares of a box's height (public method of tracking by constant velocity).
POSITION, VELOCITY = 1 / 20, 1 / 160
#: Standard deviations of a step and of a measurement: what is multiplied by the height, and what is added.
STEP = np.array([[POSITION, POSITION, 0, POSITION, VELOCITY, VELOCITY, 0, VELOCITY], [0, 0, 1e-2, 0, 0, 0, 1e-5, 0]])
SEEN = np.array([[POSITION, POSITION, 0, POSITION], [0, 0, 1e-1, 0]])
PLACE = np.arange(8)
#: The thresholds of the two-stage method beside those that are parameters.
LOW, SECOND, UNSURE, START, SAME = 0.1, 0.5, 0.7, 0.1, 0.15
HIGH, BUFFER, MATCH, STEADY, FPS = 0.5, 30, 0.8, 2, 30.0
TRACKED = "clip_no int, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double, confidence double"
NAMES = ["clip_no", "frame_idx", "track_id", "x1", "y1", "x2", "y2", "confidence"]


def measured(boxes: np.ndarray) -> np.ndarray:
    """Corners as centre, aspect (width by height) and height."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / np.where(h == 0, 1e-9, h), h], 1)


def corners(mean: np.ndarray) -> np.ndarray:
    half = mean[:, 2:4] * mean[:, 3:4]
    half[:, 1] = mean[:, 3]
    half /= 2
    return np.concatenate([mean[:, :2] - half, mean[:, :2] + half], 1)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    side = np.maximum(side, 0)
    s = side[:, :, 0] * side[:, :, 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return s / np.maximum(area(a)[:, None] + area(b)[None] - s, 1e-9)


def began(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of new tracks."""
    h = z[:, 3]
    tiny = np.ones_like(h)
    std = np.stack([2 * POSITION * h, 2 * POSITION * h, 1e-2 * tiny, 2 * POSITION * h, 10 * VELOCITY * h, 10 * VELOCITY * h, 1e-5 * tiny, 10 * VELOCITY * h], 1)
    return np.concatenate([z, np.zeros_like(z)], 1), std[:, :, None] ** 2 * np.eye(8)


def predicted(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One frame on, for all tracks at once. The step matrix is the unit with ones from velocities to places, so it is applied by blocks."""
    std = mean[:, 3:4] * STEP[0] + STEP[1]
    ahead = mean.copy()
    ahead[:, :4] += mean[:, 4:]
    out = cov.copy()
    out[:, :4] += cov[:, 4:]
    out[:, :, :4] += out[:, :, 4:]
    out[:, PLACE, PLACE] += std**2
    return ahead, out


def updated(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances after their measurements."""
    std = mean[:, 3:4] * SEEN[0] + SEEN[1]
    own = cov[:, :4, :4].copy()
    own[:, PLACE[:4], PLACE[:4]] += std**2
    gain = np.linalg.solve(own, cov[:, :4, :]).transpose(0, 2, 1)
    return mean + (gain @ (z - mean[:, :4])[:, :, None])[:, :, 0], cov - gain @ cov[:, :4, :]


class Track:
    def __init__(self, mean: np.ndarray, cov: np.ndarray, frame: int, sure: bool):
        self.mean, self.cov, self.since, self.seen, self.sure, self.lost, self.run, self.id = mean, cov, frame, frame, sure, False, 1, None


class Tracker:
    """The state of one clip: step() takes the boxes of one frame and returns (box, id) pairs. A frame without boxes must be stepped too, unless step() is told the
    frame's number: it predicts over the frames between."""

    def __init__(self, high: float = HIGH, buffer: int = BUFFER, match: float = MATCH, steady: int = STEADY, fps: float = FPS):
        self.high, self.match, self.steady, self.most = high, match, steady, int(fps / 30.0 * buffer)
        self.tracks: list[Track] = []
        self.frame: int | None = None
        self.ids = 0

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> list[tuple[int, int]]:
        first = self.frame is None
        for between in range(frame if first else self.frame + 1, frame):
            self.one(between, np.zeros((0, 4)), np.zeros(0), False)
        self.frame = frame
        return self.one(frame, np.asarray(boxes, float).reshape(-1, 4), np.asarray(conf, float), first)

    def one(self, frame: int, boxes: np.ndarray, conf: np.ndarray, first: bool) -> list[tuple[int, int]]:
        self.ahead()
        strong, weak = np.flatnonzero(conf >= self.high), np.flatnonzero((conf > LOW) & (conf < self.high))
        sure, unsure = [t for t in self.tracks if t.sure], [t for t in self.tracks if not t.sure]
        found: list[tuple[Track, int]] = []
        rest, strong = self.take(sure, strong, boxes, conf, True, self.match, found)
        seen = [t for t in rest if not t.lost]
        missed, _ = self.take(seen, weak, boxes, conf, False, SECOND, found)
        gone, strong = self.take(unsure, strong, boxes, conf, True, UNSURE, found)
        self.correct(frame, found, boxes)
        for t in missed:
            t.lost, t.run = True, 0
        dropped = {id(t) for t in gone} | {id(t) for t in self.tracks if t.lost and frame - t.seen > self.most}
        self.tracks = [t for t in self.tracks if id(t) not in dropped]
        new = [d for d in strong.tolist() if conf[d] >= self.high + START]
        if new:
            mean, cov = began(measured(boxes[new]))
            for k, d in enumerate(new):
                t = Track(mean[k], cov[k], frame, first)
                self.tracks.append(t)
                found.append((t, d))
        self.apart()
        out = []
        alive = {id(t) for t in self.tracks}
        for t, d in sorted(found, key=lambda x: x[1]):
            if t.sure and id(t) in alive:
                if t.id is None and t.run >= self.steady:
                    self.ids += 1
                    t.id = self.ids
                if t.id is not None:
                    out.append((d, t.id))
        return out

    def ahead(self) -> None:
        if self.tracks:
            mean, cov = np.array([t.mean for t in self.tracks]), np.array([t.cov for t in self.tracks])
            mean[[t.lost for t in self.tracks], 7] = 0.0
            mean, cov = predicted(mean, cov)
            for t, m, c in zip(self.tracks, mean, cov, strict=True):
                t.mean, t.cov = m, c

    def take(self, tracks: list[Track], chosen: np.ndarray, boxes: np.ndarray, conf: np.ndarray, weighed: bool, most: float, found: list) -> tuple[list[Track], np.ndarray]:
        """Matches tracks and boxes up to a cost; returns what is left of both."""
        if not tracks or not len(chosen):
            return tracks, chosen
        near = overlap(corners(np.array([t.mean for t in tracks])), boxes[chosen])
        cost = 1 - near * (conf[chosen][None] if weighed else 1.0)
        pairs = assign(np.where(cost <= most, cost, np.inf))
        found += [(tracks[a], int(chosen[b])) for a, b in pairs]
        left, used = {a for a, _ in pairs}, {b for _, b in pairs}
        return [t for k, t in enumerate(tracks) if k not in left], np.array([d for k, d in enumerate(chosen.tolist()) if k not in used], int)

    def correct(self, frame: int, found: list[tuple[Track, int]], boxes: np.ndarray) -> None:
        if not found:
            return
        mean, cov = updated(np.array([t.mean for t, _ in found]), np.array([t.cov for t, _ in found]), measured(boxes[[d for _, d in found]]))
        for (t, _), m, c in zip(found, mean, cov, strict=True):
            t.run = t.run + 1 if t.seen == frame - 1 else 1
            t.mean, t.cov, t.seen, t.lost, t.sure = m, c, frame, False, True

    def apart(self) -> None:
        """A lost track where a seen one is: the one that has lived longer stays."""
        seen, lost = [t for t in self.tracks if t.sure and not t.lost], [t for t in self.tracks if t.lost]
        if seen and lost:
            near = 1 - overlap(corners(np.array([t.mean for t in seen])), corners(np.array([t.mean for t in lost]))) < SAME
            out = {id(lost[b] if seen[a].seen - seen[a].since > lost[b].seen - lost[b].since else seen[a]) for a, b in zip(*np.nonzero(near), strict=True)}
            self.tracks = [t for t in self.tracks if id(t) not in out]


def fold(tracker: Tracker, clip: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Steps a tracker over the frames of one clip's rows."""
    out = []
    frames, order = pdf["frame_idx"].to_numpy(), pdf["det_order"].to_numpy()
    at = np.lexsort((order, frames))
    frames, every, sure = frames[at], pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)[at], pdf["confidence"].to_numpy(float)[at]
    starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(frames) else np.empty(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frames)], strict=False):
        frame, boxes, conf = int(frames[a]), every[a:b], sure[a:b]
        out += [(clip, frame, i, *boxes[d].tolist(), float(conf[d])) for d, i in tracker.step(frame, boxes, conf)]
    return pd.DataFrame(out, columns=NAMES).astype({"clip_no": "int32", "frame_idx": "int32", "track_id": "int32"})


def track(detections: DataFrame, high: float = HIGH, buffer: int = BUFFER, match: float = MATCH, steady: int = STEADY, fps: float = FPS) -> DataFrame:
    """The boxes of (clip_no, frame_idx, det_order, x1, y1, x2, y2, confidence) that have a track, with its id (from 1 in each clip)."""
    rows = detections.select("clip_no", "frame_idx", "det_order", "x1", "y1", "x2", "y2", "confidence")
    return rows.groupBy("clip_no").applyInPandas(lambda key, pdf: fold(Tracker(high, buffer, match, steady, fps), int(key[0]), pdf), TRACKED)
