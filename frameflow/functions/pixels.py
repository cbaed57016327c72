"""Colours of image crops: background from the border, foreground by its distance, one colour a crop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The border's share of the shorter side, and the fewest pixels of a foreground.
RING, FEWEST = 0.10, 10
#: Values of pixels that are worked on at once.
AT_ONCE = 2_000_000
COLOURS = "border array<double>, n_foreground int, colour array<double>"


def border_colour(crop: np.ndarray) -> np.ndarray:
    """Mean of the pixels on the crop's border (height x width x channel); a crop that is border only gives the mean of all. Crops of one size may be stacked."""
    h, w = crop.shape[-3:-1]
    wide = max(1, round(min(h, w) * RING))
    on_border = np.ones((h, w), bool)
    if 2 * wide < h and 2 * wide < w:
        on_border[wide : h - wide, wide : w - wide] = False
    return crop[..., on_border, :].mean(axis=-2, dtype=np.float64)


def foreground(crop: np.ndarray, border: np.ndarray, farther: float) -> np.ndarray:
    """The pixels farther than that from the border's colour."""
    return crop[((crop - border) ** 2).sum(axis=2) > farther**2]


def stack_colours(crops: np.ndarray, farther: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Border, number of foreground pixels and their mean of a stack of crops of one size."""
    border = border_colour(crops)
    front = ((crops - border[:, None, None]) ** 2).sum(axis=3) > farther**2
    n = front.sum((1, 2))
    return border, n, (crops * front[..., None]).sum((1, 2)) / np.maximum(n, 1)[:, None]


def crop_colours(pixels: Column, height: Column, width: Column, farther: float) -> Column:
    """border, n_foreground and colour of crops (bytes, row by row, three channels a pixel). An empty or missing crop has none of them; one
    with fewer than FEWEST pixels of foreground has no colour: a background is never passed off as one."""

    @F.pandas_udf(COLOURS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raw, hs, ws in parts:
            own, borders, counts, means = raw.tolist(), [None] * len(raw), [None] * len(raw), [None] * len(raw)
            sizes: dict[tuple[int, int], list[int]] = {}
            for i, (r, h, w) in enumerate(zip(own, hs.tolist(), ws.tolist(), strict=True)):
                if r:
                    sizes.setdefault((int(h), int(w)), []).append(i)
            # crops of one size are worked on together, up to a bounded number of values
            for (h, w), at in sizes.items():
                step = max(1, AT_ONCE // (3 * h * w))
                for some in (at[a : a + step] for a in range(0, len(at), step)):
                    crops = np.frombuffer(b"".join([own[i] for i in some]), np.uint8).reshape(len(some), h, w, 3).astype(np.float64)
                    for i, b, n, m in zip(some, *(x.tolist() for x in stack_colours(crops, farther)), strict=True):
                        borders[i], counts[i], means[i] = b, n, m if n >= FEWEST else None
            yield pd.DataFrame({"border": pd.Series(borders, dtype=object), "n_foreground": pd.Series(counts, dtype="Int32"), "colour": pd.Series(means, dtype=object)})

    return run(pixels, height, width)
