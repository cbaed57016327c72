"""Points followed from frame to frame: corners, a pyramid, iterated least squares in a window, and the way back as a check.

Frames are rows of grey pixels. A row meets the frame before it by a window over its clip, each pair is a row of its own from there on, and all points of a stack of pairs of one size are
followed together. Frames that are drawn from points meet as points: their pixels are made where the pair is followed, and are never moved. A point counts if following it back ends near
where it began; fewer than FEWEST such points are no motion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.camera import fit_similarities, proposals

#: Corners of a frame and how far apart they are, the share of the best corner's strength that one needs, half the window, levels of the pyramid, rounds of each, the step that ends
#: them, and the largest error of the way there and back; the fewest points that make a motion.
CORNERS, APART, QUALITY, HALF, LEVELS, ROUNDS, STEP, BACK, FEWEST = 60, 3, 0.02, 4, 3, 20, 0.01, 1.0, 10
#: The margin around an image, pixels of pairs that are worked on at once (one pair at least), and pairs whose motions are fitted at once.
MARGIN, AT_ONCE, FITTED = 2 * HALF + 2, 600_000, 32
FOLLOWED = "clip_no int, frame_idx int, last_frame int, corners int, points int, dx double, dy double, scale double"


def widened(images: np.ndarray, by: int) -> np.ndarray:
    """Images of a stack with a margin of their edges' pixels."""
    return np.pad(images, ((0, 0), (by, by), (by, by)), mode="edge")


def windows(images: np.ndarray, of: np.ndarray, at: np.ndarray, half: int = HALF) -> np.ndarray:
    """Pixels of the windows around places (y, x) between pixels: row, column, place. images: a stack with margins; of: each place's image. Beyond an edge the pixels are the edge's own."""
    _, high, wide = images.shape
    side = np.arange(2 * half + 2)
    at = np.clip(at, -HALF, [high - 2 * MARGIN - 1 + HALF, wide - 2 * MARGIN - 1 + HALF])
    first = np.floor(at).astype(int)
    a, b = (at - first).T.astype(images.dtype)
    begin = (of * high + first[:, 0] + MARGIN - half) * wide + first[:, 1] + MARGIN - half
    own = images.ravel().take((side[:, None] * wide + side)[:, :, None] + begin, mode="clip")
    rows = np.diff(own, axis=1)
    rows *= b
    rows += own[:, :-1]
    out = np.diff(rows, axis=0)
    out *= a
    out += rows[:-1]
    return out


def strongest(images: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a stack of images: each one's image, and (y, x)."""
    n, h, w = images.shape
    of, at = [np.zeros(0, int)], [np.zeros((0, 2), int)]
    if min(h, w) <= 2 * HALF:
        return of[0], at[0].astype(float)
    # differences over two pixels where a corner may be and one pixel around, and their products' sums over squares of three: 36 times the means of squared slopes
    inner = lambda y, x: images[:, HALF - 1 + y : h - HALF + 1 + y, HALF - 1 + x : w - HALF + 1 + x]
    gy, gx = inner(1, 0) - inner(-1, 0), inner(0, 1) - inner(0, -1)

    def summed(p: np.ndarray) -> np.ndarray:
        rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
        return rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]

    a, b, c = (summed(p).astype(float) for p in (gy * gy, gy * gx, gx * gx))
    # with a margin that is no corner, so that what is near one needs no bounds; rows are known by their largest
    left = np.full((n, h + 2 * (APART - HALF), w + 2 * (APART - HALF)), -1.0)
    left[:, APART:-APART, APART:-APART] = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    rows = left.max(2)
    best, near = rows.max(1), np.arange(-APART, APART + 1)
    least, each = np.where(best > 36e-6, QUALITY * best, np.inf), np.arange(n)
    for _ in range(most):
        y = rows.argmax(1)
        good = np.flatnonzero(rows[each, y] >= least)
        if not len(good):
            break
        y = y[good]
        x = left[good, y].argmax(1)
        of.append(good)
        at.append(np.stack([y, x], 1))
        around = y[:, None] + near
        left[good[:, None, None], around[:, :, None], (x[:, None] + near)[:, None]] = -1
        rows[good[:, None], around] = left[good[:, None], around].max(2)
    return np.concatenate(of), np.concatenate(at).astype(float) + HALF - APART


def corners(image: np.ndarray, most: int = CORNERS) -> np.ndarray:
    """(y, x) of the pixels where the image changes most in its weaker direction, the strongest first, none close to another."""
    return strongest(image[None].astype(np.float32), most)[1]


def pyramid(images: np.ndarray) -> list[np.ndarray]:
    """The images and their halves, each the mean of four pixels, with margins."""
    out = [images]
    for _ in range(LEVELS - 1):
        x = out[-1][:, : out[-1].shape[1] // 2 * 2, : out[-1].shape[2] // 2 * 2]
        if min(x.shape[1:]) < 4 * HALF:
            break
        out.append((x[:, ::2, ::2] + x[:, 1::2, ::2] + x[:, ::2, 1::2] + x[:, 1::2, 1::2]) / 4)
    return [widened(x, MARGIN) for x in out]


def followed(a: list[np.ndarray], b: list[np.ndarray], of: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the points of the images of pyramid a are in pyramid b, and whether each could be followed. of: each point's image."""
    move, fine = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(a) - 1, -1, -1):
        # a pixel of a level stands for the middle of its four
        at = (points + 0.5) / 2**level - 0.5
        wide = windows(a[level], of, at, HALF + 1)
        own, sy, sx = wide[1:-1, 1:-1], (wide[2:, 1:-1] - wide[:-2, 1:-1]) / 2, (wide[1:-1, 2:] - wide[1:-1, :-2]) / 2
        yy, yx, xx = (np.einsum("ijk,ijk->k", p, q) for p, q in ((sy, sy), (sy, sx), (sx, sx)))
        det = yy * xx - yx * yx
        sound = det > 1e-6
        going = np.flatnonzero(sound)
        own, sy, sx = (np.ascontiguousarray(x[:, :, going]) for x in (own, sy, sx))
        for _ in range(ROUNDS if len(going) else 0):
            off = own - windows(b[level], of[going], at[going] + move[going])
            ey, ex = np.einsum("ijk,ijk->k", off, sy), np.einsum("ijk,ijk->k", off, sx)
            step = np.stack([xx[going] * ey - yx[going] * ex, yy[going] * ex - yx[going] * ey], 1) / det[going, None]
            move[going] += step
            more = np.flatnonzero(np.abs(step).max(1) >= STEP)
            if len(more) < len(going):
                going, own, sy, sx = going[more], *(x.take(more, axis=2) for x in (own, sy, sx))
            if not len(going):
                break
        if level:
            move *= 2
        else:
            fine = sound
    end = points + move
    h, w = (x - 2 * MARGIN for x in a[0].shape[1:])
    return end, fine & (end >= 0).all(1) & (end[:, 0] <= h - 1) & (end[:, 1] <= w - 1)


def tracked_stack(before: np.ndarray, now: np.ndarray, most: int = CORNERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a stack of pairs of images: the points of the first ones that are found in the second ones and back again (each one's pair, and its place), where they are there, and how many corners each first image had."""
    a, b = pyramid(before), pyramid(now)
    of, points = strongest(before, most)
    there, seen = followed(a, b, of, points)
    back, returned = followed(b, a, of, there)
    good = seen & returned & (np.hypot(*(back - points).T) <= BACK)
    return of[good], points[good], there[good], np.bincount(of, minlength=len(before))


def tracked(before: np.ndarray, now: np.ndarray, most: int = CORNERS) -> tuple[np.ndarray, np.ndarray, int]:
    """Points of the first image that are found in the second and back again, where they are there, and how many corners there were."""
    _, points, there, n = tracked_stack(before[None].astype(np.float32), now[None].astype(np.float32), most)
    return points, there, int(n[0])


class Found:
    """Corners, points and motions of the pairs of a batch, as they are found."""

    def __init__(self, clips: np.ndarray, frames: np.ndarray, fewest: int, most: int):
        self.seeds, self.fewest, self.most = list(zip(clips.tolist(), frames.tolist(), strict=True)), max(2, fewest), most
        self.corners, self.points = np.zeros((2, len(clips)), np.int32)
        self.motion = np.full((len(clips), 3), np.nan)
        self.waiting: dict[int, list[tuple[int, complex, np.ndarray, np.ndarray]]] = {}

    def add(self, at: np.ndarray, before: np.ndarray, now: np.ndarray) -> None:
        """A stack of pairs of images, the rows at those places."""
        of, p, q, self.corners[at] = tracked_stack(before.astype(np.float32), now.astype(np.float32), self.most)
        self.points[at] = n = np.bincount(of, minlength=len(at))
        order = np.argsort(of, kind="stable")
        z, w = (np.split((x[:, 1] + 1j * x[:, 0])[order], np.cumsum(n)[:-1]) for x in (p, q))
        centre = complex(now.shape[2] / 2, now.shape[1] / 2)
        for i, own, other in zip(at.tolist(), z, w, strict=True):
            if len(own) >= self.fewest:
                same = self.waiting.setdefault(len(own), [])
                same.append((i, centre, own, other))
                if len(same) == FITTED:
                    self.fit(len(own))

    def fit(self, size: int) -> None:
        """The motions of pairs that have so many points each."""
        at, centre, z, w = map(np.array, zip(*self.waiting.pop(size), strict=True))
        m, t, _ = fit_similarities(z, w, proposals(size, [self.seeds[i] for i in at]), 1.0)
        d = m * centre + t - centre
        self.motion[at] = np.stack([d.real, d.imag, np.abs(m)], 1)

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch with what was found."""
        for size in list(self.waiting):
            self.fit(size)
        columns = [batch.column(c) for c in ("clip_no", "frame_idx", "last_frame")] + [pa.array(self.corners), pa.array(self.points)] + [pa.array(x, from_pandas=True) for x in self.motion.T]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOLLOWED.split(", ")])


def stacks(heights: np.ndarray, widths: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Places of rows with images of one size, so many at a time, with that size."""
    for h, w in np.unique(np.stack([heights, widths], 1), axis=0).tolist():
        at, step = np.flatnonzero((heights == h) & (widths == w)), max(1, AT_ONCE // (h * w))
        yield from ((at[k : k + step], h, w) for k in range(0, len(at), step))


def paired(frames: DataFrame, *columns: str) -> DataFrame:
    """Each frame but a clip's first, with last_frame, the columns, and those of the frame before as last_<column>."""
    last = F.lag(F.struct("frame_idx", *columns)).over(Window.partitionBy("clip_no").orderBy("frame_idx"))
    pairs = frames.select("clip_no", "frame_idx", *columns, last.alias("last")).where("last is not null")
    pairs = pairs.select("clip_no", "frame_idx", F.col("last.frame_idx").alias("last_frame"), *columns, *[F.col(f"last.{c}").alias(f"last_{c}") for c in columns])
    # following takes far longer than moving a pair: those of a few long clips go to all tasks
    return pairs.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip_no", "frame_idx")


def motions(frames: DataFrame, fewest: int = FEWEST, most: int = CORNERS) -> DataFrame:
    """For each frame but a clip's first: shift of the image centre (pixels) and scale against the frame before it, from the points followed; null where these are too few. frames:
    clip_no, frame_idx, height, width and pixels (bytes, row by row). Frames of another size than the one before have no motion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(c) for c in batch.schema.names}
            found = Found(got["clip_no"].to_numpy(), got["frame_idx"].to_numpy(), fewest, most)
            heights, widths, *last = (got[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("height", "width", "last_height", "last_width"))
            here, there = (got[c].is_valid().to_numpy(zero_copy_only=False) for c in ("pixels", "last_pixels"))
            rows = np.flatnonzero(here & there & (heights == last[0]) & (widths == last[1]) & (heights > 0) & (widths > 0))
            for at, h, w in stacks(heights[rows], widths[rows]):
                before, now = (np.frombuffer(b"".join(got[c].take(pa.array(rows[at])).to_pylist()), np.uint8).reshape(len(at), h, w) for c in ("last_pixels", "pixels"))
                found.add(rows[at], before, now)
            yield found.rows(batch)

    return paired(frames, "height", "width", "pixels").mapInArrow(run, FOLLOWED)


def painted(points: list[np.ndarray], height: int, width: int, spread: float) -> np.ndarray:
    """A stack of images with a soft spot at each point (x, y, light)."""
    ys, xs = np.arange(height)[:, None], np.arange(width)[:, None]
    out = np.empty((len(points), height, width), np.uint8)
    sizes = np.array([len(p) for p in points])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, y, light = np.moveaxis(np.stack([points[i] for i in at]), 2, 0)[:, :, None]
        image = 30 + (np.exp(-((ys - y) ** 2) / (2 * spread**2)) * light) @ np.exp(-((xs - x) ** 2) / (2 * spread**2)).transpose(0, 2, 1)
        out[at] = np.clip(np.round(image), 0, 255)
    return out


def spots(column: pa.ListArray) -> list[np.ndarray]:
    """The points of each row of an array of x, y, light."""
    if not len(column):
        return []
    flat = column.flatten()
    p = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "light")], 1)
    return np.split(p, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1])


def drawn(points: DataFrame, height: int, width: int, spread: float = 1.6) -> DataFrame:
    """Frames with a soft spot at each point. points: clip_no, frame_idx and an array of x, y, light."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, images = batch.num_rows, painted(spots(batch.column("points")), height, width, spread)
            size = [pa.array(np.full(n, x, np.int32)) for x in (height, width)]
            yield pa.RecordBatch.from_arrays([batch.column("clip_no"), batch.column("frame_idx"), *size, pa.array([x.tobytes() for x in images], pa.binary())], names=["clip_no", "frame_idx", "height", "width", "pixels"])

    return points.mapInArrow(run, "clip_no int, frame_idx int, height int, width int, pixels binary")


def drawn_motions(points: DataFrame, height: int, width: int, fewest: int = FEWEST, most: int = CORNERS, spread: float = 1.6) -> DataFrame:
    """The rows of motions(drawn(points, height, width, spread)), but a pair is drawn where it is followed: points take a fortieth of the pixels' bytes, and those are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Found(batch.column("clip_no").to_numpy(), batch.column("frame_idx").to_numpy(), fewest, most)
            before, now = spots(batch.column("last_points")), spots(batch.column("points"))
            for at, h, w in stacks(*np.full((2, batch.num_rows), [[height], [width]])):
                found.add(at, *(painted([p[i] for i in at], h, w, spread) for p in (before, now)))
            yield found.rows(batch)

    return paired(points, "points").mapInArrow(run, FOLLOWED)
