"""The court's landmarks and plane geometry on columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The court in metres (length, width, lane, free-throw line, corner inset), its 18 landmarks and their mirror images; the names are this package's own.
LENGTH, WIDTH = 28.65, 15.24
LANE, FREE_THROW, CORNER = 4.88, 5.79, 0.914
LANE_A, LANE_B = (WIDTH - LANE) / 2, WIDTH - (WIDTH - LANE) / 2
CORNER_A, CORNER_B = CORNER, WIDTH - CORNER
CENTRE, RIGHT_THROW = LENGTH / 2, LENGTH - FREE_THROW
TEMPLATE = [
    (0.0, 0.0, "L end, edge A", 15),
    (0.0, CORNER_A, "L end, arc A", 14),
    (0.0, LANE_A, "L end, paint A", 13),
    (0.0, LANE_B, "L end, paint B", 12),
    (0.0, CORNER_B, "L end, arc B", 11),
    (0.0, WIDTH, "L end, edge B", 10),
    (CENTRE, WIDTH, "middle, edge B", 6),
    (CENTRE, 0.0, "middle, edge A", 7),
    (FREE_THROW, LANE_A, "L foul A", 16),
    (FREE_THROW, LANE_B, "L foul B", 17),
    (LENGTH, WIDTH, "R end, edge B", 5),
    (LENGTH, CORNER_B, "R end, arc B", 4),
    (LENGTH, LANE_B, "R end, paint B", 3),
    (LENGTH, LANE_A, "R end, paint A", 2),
    (LENGTH, CORNER_A, "R end, arc A", 1),
    (LENGTH, 0.0, "R end, edge A", 0),
    (RIGHT_THROW, LANE_A, "R foul A", 8),
    (RIGHT_THROW, LANE_B, "R foul B", 9),
]
MARGIN_M = 2.0
#: What a fit's last digits may move a point: far above their error, and far below what a whole pixel moves it.
EDGE_M = 1e-9
FLAT_M2 = 0.01
#: Conditioning down to which a fit comes from the product of its design matrix with itself: about eight digits are left there.
WEAK = 1e-4


def in_bounds(x: Column, y: Column, margin: float = MARGIN_M) -> Column:
    """On the court or within the margin around it, edges included; a point on an edge stays on it whatever the last digits of its fit."""
    return x.between(-margin - EDGE_M, LENGTH + margin + EDGE_M) & y.between(-margin - EDGE_M, WIDTH + margin + EDGE_M)


def to_pixels(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    return x / F.lit(LENGTH) * F.lit(float(width)), y / F.lit(WIDTH) * F.lit(float(height))


def collinear(a: Column, b: Column, c: Column, least: float = FLAT_M2) -> Column:
    """Whether three points (structs of x_m and y_m) span a triangle of less than the area."""
    twice = F.abs((b["x_m"] - a["x_m"]) * (c["y_m"] - a["y_m"]) - (c["x_m"] - a["x_m"]) * (b["y_m"] - a["y_m"]))
    return twice / 2 < F.lit(least)


def flat_triples(least: float = FLAT_M2) -> set[tuple[int, int, int]]:
    """Landmark triples on one line."""
    out = set()
    for i, j, k in combinations(range(len(TEMPLATE)), 3):
        (ax, ay, *_), (bx, by, *_), (cx, cy, *_) = TEMPLATE[i], TEMPLATE[j], TEMPLATE[k]
        if abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2 < least:
            out.add((i, j, k))
    return out


def general_quadruple(indices: list[int], flat: set[tuple[int, int, int]] | None = None) -> bool:
    """Whether four of the landmarks have no three on one line."""
    flat = flat_triples() if flat is None else flat
    return any(not any(t in flat for t in combinations(q, 3)) for q in combinations(sorted(set(indices)), 4))


def normalise(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of points (set x point x 2) moved to their centres with mean distance sqrt 2, and the matrices of these moves; no spread: centred only."""
    centre = points.mean(1, keepdims=True)
    spread = np.sqrt(((points - centre) ** 2).sum(2)).mean(1)
    s = np.where(spread > 0, np.sqrt(2) / np.where(spread > 0, spread, 1), 1.0)
    t = np.zeros((len(points), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2] = -s[:, None] * centre[:, 0]
    t[:, 2, 2] = 1
    return (points - centre) * s[:, None, None], t


def smallest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each matrix of nine columns the direction that it shrinks most, and the smallest but one over the largest of nine singular values. They come from its product with itself, which is
    nine by nine however many rows there are and takes a third of the time; that halves the digits, so what the matrix itself makes of the direction says what it holds of the others, which is
    taken out. Matrices for which it could still be felt are decomposed themselves."""
    values, vectors = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)
    least, ratio = vectors[:, :, 0], np.sqrt(np.maximum(values[:, 1], 0) / np.where(values[:, 8] > 0, values[:, 8], 1))
    others, apart = vectors[:, :, 1:], values[:, 1:, None] - values[:, :1, None]
    held = others.transpose(0, 2, 1) @ (rows.transpose(0, 2, 1) @ (rows @ least[:, :, None])) / np.where(apart > 0, apart, np.inf)
    least = least - (others @ held)[:, :, 0]
    weak = np.flatnonzero(~(ratio > WEAK))
    if len(weak):
        _, size, basis = np.linalg.svd(rows[weak], full_matrices=rows.shape[1] < 9)
        least[weak], ratio[weak] = basis[:, -1], size[:, 7] / size[:, 0]
    return least, ratio


def fit_homographies(image: np.ndarray, court: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares maps from image to court (direct linear transform on normalised points) of sets of equally many points, their stack at once: the maps, the sign that each denominator has on its points, whether the map is sound, and the design matrix's conditioning (smallest but one over largest singular value)."""
    (p, tp), (q, tq) = normalise(image), normalise(court)
    rows = np.zeros((len(p), 2 * p.shape[1], 9))
    rows[:, ::2, 0:2] = rows[:, 1::2, 3:5] = -p
    rows[:, ::2, 2] = rows[:, 1::2, 5] = -1
    rows[:, ::2, 6:8], rows[:, 1::2, 6:8] = q[:, :, :1] * p, q[:, :, 1:] * p
    rows[:, ::2, 8], rows[:, 1::2, 8] = q[:, :, 0], q[:, :, 1]
    least, ratio = smallest(rows)
    h = np.linalg.inv(tq) @ least.reshape(-1, 3, 3) @ tp
    norm = np.sqrt((h * h).sum((1, 2), keepdims=True))
    sound = np.isfinite(h).all((1, 2)) & (np.abs(np.linalg.det(h / norm)) >= 1e-12)
    last = h[:, 2, 2][:, None, None]
    h = h / np.where(np.abs(last) > 1e-12, last, norm)
    w = (image * h[:, None, 2, :2]).sum(2) + h[:, 2, 2][:, None]
    return h, np.sign(np.median(w, axis=1)), sound, ratio


def fit_homography(image: np.ndarray, court: np.ndarray) -> tuple[np.ndarray | None, float]:
    """The map of one set of points and its sign; None if the map is degenerate."""
    h, sign, sound, _ = fit_homographies(image[None], court[None])
    return (h[0], float(sign[0])) if sound[0] else (None, 0.0)


def apply_homography(h: Column, sign: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Court position of an image point, null at or beyond the horizon. h: array of nine numbers, row by row."""
    w = h[6] * x + h[7] * y + h[8]
    ok = (F.abs(w) >= 1e-12) & (F.signum(w) == sign)
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)
