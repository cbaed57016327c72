"""Box geometry and small vector functions on columns. Boxes are x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns of one box."""

    def __init__(self, x1: Column, y1: Column, x2: Column, y2: Column):
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def around(cls, x: Column, y: Column, half: float) -> Box:
        return cls(x - F.lit(half), y - F.lit(half), x + F.lit(half), y + F.lit(half))

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def foot(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, self.y2

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def shared_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def containment(player: Box, ball: Box) -> Column:
    """The share of the ball's box inside the player's; 0 for a ball without area."""
    return F.when(ball.area > 0, shared_area(player, ball) / ball.area).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    s = shared_area(a, b)
    return F.when(s > 0, s / (a.area + b.area - s)).otherwise(F.lit(0.0))


def closest(box: Box, x: Column, y: Column) -> Column:
    """Smallest distance to the box's proximity points: corners, edge middles, centre, a point a third down; the point's own level on the
    sides, and its own column on top and bottom, where those lie strictly inside the box."""
    cx, cy = box.centre
    fixed = [(box.x1, box.y1), (box.x2, box.y1), (box.x1, box.y2), (box.x2, box.y2), (cx, box.y1), (cx, box.y2), (box.x1, cy), (box.x2, cy), (cx, cy), (cx, box.y1 + box.height / 3)]
    level, column = (box.y1 < y) & (y < box.y2), (box.x1 < x) & (x < box.x2)
    more = [F.when(level, distance(box.x1, y, x, y)), F.when(level, distance(box.x2, y, x, y)), F.when(column, distance(x, box.y1, x, y)), F.when(column, distance(x, box.y2, x, y))]
    return F.least(*[distance(px, py, x, y) for px, py in fixed], *more)


def crop(box: Box, width: int, height: int, share: float = 1.0) -> Column:
    """The box in whole pixels (cut toward zero), its upper `share`, clamped to the image; null if nothing is left."""
    cut = lambda v: v.cast("int")
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most)))
    bottom = cut(box.y1 + (box.y2 - box.y1) * F.lit(share))
    x1, y1, x2, y2 = clamp(cut(box.x1), width), clamp(cut(box.y1), height), clamp(cut(box.x2), width), clamp(bottom, height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def softmax(v: Column) -> Column:
    """Of an array of doubles, stable."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def margin(near: Column, other: Column) -> Column:
    return other / (near + other + F.lit(1e-9))


def bucket(n: Column) -> Column:
    """5, 6, 7, 8 and 9+; null below."""
    return F.when(n >= 9, F.lit("9+")).when(n >= 5, n.cast("string"))


def cut(value: Column, edges: list[float]) -> Column:
    """The number of the interval (open left, closed right) between the edges; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((value > a) & (value <= b), F.lit(i)).otherwise(out)
    return out
