"""Samples that anyone with the seed can draw again."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded(rows: DataFrame, group: str, value: str, quota: int, seed: int) -> DataFrame:
    """`quota` values of each group (all, if fewer) without replacement, by Python's generator seeded with the text "seed:group" over the sorted distinct values: the same values whatever the order or the
    parts of the table, and those of a plain loop. Groups are clips, one task each."""
    distinct = rows.select(group, value).where(F.col(value).isNotNull()).distinct()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every = sorted(pdf[value].tolist())
        return pd.DataFrame({group: [key[0]] * min(quota, len(every)), value: sorted(random.Random(f"{seed}:{key[0]}").sample(every, min(quota, len(every))))})

    return distinct.groupBy(group).applyInPandas(one, distinct.schema)
