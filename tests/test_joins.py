"""Rows of frames, players and landmarks, and stored stages, never pass through the driver for a join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frameflow import catalog
from frameflow.sources import scene, store

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", ["d02_holder", "f09_possession", "b35_captions", "e02_possession_share", "b12_minimap", "k10_court_positions", "c10_event_candidates", "d23_hold_sweep"])
def test_rows_of_players_are_not_broadcast(spark, name):
    """The tables are small enough for Spark to broadcast them; each frame has ten players, and their rows are many times what their files take."""
    joins = [x for x in plan(QUERIES[name](spark, SF)).splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "frame_idx" in x], joins


def test_small_tables_that_are_asked_for_still_are(spark):
    assert "BroadcastHashJoin" in plan(scene.keypoints(spark, SF))


def test_stored_stages_are_not_broadcast(spark, tmp_path):
    mark = store.fingerprint("rows", {})
    rows = store.stage(spark, str(tmp_path / "rows"), mark, "clip_no int, frame_idx int", lambda: scene.players(spark, SF).select("clip_no", "frame_idx"))
    both = spark.range(10).select(F.col("id").cast("int").alias("clip_no")).join(rows, "clip_no", "left")
    assert "Broadcast" not in plan(both)
