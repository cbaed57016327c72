"""Points on the edge of what counts as in bounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow import catalog
from frameflow.functions import court as plane
from frameflow.functions.court import in_bounds
from tests.oracle import same


def test_the_last_digits_of_a_fit_do_not_decide(spark):
    rows = spark.createDataFrame([(-2.0,), (-2.0000000000000107,), (30.650000000000013,), (-2.00001,), (30.65001,)], "x double")
    assert [r["b"] for r in rows.select(in_bounds(F.col("x"), F.lit(1.0)).alias("b")).collect()] == [True, True, True, False, False]


@pytest.mark.parametrize("name", ["k10_court_positions", "e16_mapping_report"])
def test_a_clip_with_a_player_on_the_edge(spark, tmp_path, name):
    """Clip 534 has a foot point that is on the edge exactly (frame 262)."""
    ids = spark.range(534 * 500, 535 * 500, numPartitions=1).withColumnRenamed("id", "event_id")
    ids.select("event_id", F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    same(catalog.queries()[name](spark, str(tmp_path)).toPandas(), catalog.oracle_sql()[name], str(tmp_path))


@pytest.mark.parametrize(("clip", "frame"), [(273, 129), (1164, 293)])
def test_a_player_on_the_line_is_on_the_map(spark, tmp_path, clip, frame):
    """A foot point of that frame is on the court's line, and so on the map's edge, exactly."""
    ids = spark.range(clip * 500, (clip + 1) * 500, numPartitions=1).withColumnRenamed("id", "event_id")
    ids.select("event_id", F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["b12_minimap"](spark, str(tmp_path)).toPandas()
    assert not got[(got["frame_idx"] == frame) & (got["x"] == 5.0) & (got["y"].round(2).isin([108.61, 47.96]))]["is_off"].any()
    same(got, catalog.oracle_sql()["b12_minimap"], str(tmp_path))


def test_fits_have_the_digits_of_their_landmarks():
    """Positions under fits to exact landmarks, whichever of them are seen, to within a few last digits: the product of a matrix with itself alone has two digits less."""
    places = np.array([p[:2] for p in plane.TEMPLATE])
    w = 1 + places[:, 0] / 200 + places[:, 1] / 300
    image = np.stack([(38 * places[:, 0] + 3 * places[:, 1] + 70) / w, (2 * places[:, 0] + 29 * places[:, 1] + 95) / w], 1)
    worst = 0.0
    for k in range(400):
        seen = [i for i in range(18) if (k * 7 + i * 13) % 100 >= 50]
        if len(seen) >= 4 and plane.general_quadruple(seen):
            h, _ = plane.fit_homography(image[seen], places[seen])
            v = np.column_stack([image, np.ones(18)]) @ h.T
            worst = max(worst, np.abs(v[:, :2] / v[:, 2:] - places).max())
    assert worst < 1e-13
