"""Streams give what their batch forms give, over several micro-batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frameflow.operators import events, gates, kinematics
from frameflow.plans import game
from frameflow.sources import scene
from frameflow.streaming import live

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, rows, make, name):
    """rows in three files by frame, read one file a batch; the rows that the stream gives."""
    path = tmp_path / name
    for k in range(3):
        part = rows.where((F.col("frame_idx") >= 170 * k) & (F.col("frame_idx") < (170 * (k + 1) if k < 2 else 10_000)))
        part.coalesce(1).write.mode("append").parquet(str(path / "rows" / f"part={k}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path / "rows"))
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("kind", ["frozen", "combined"])
def test_gate(spark, tmp_path, kind):
    ball = scene.ball(spark, SF)
    got = streamed(spark, tmp_path, ball, lambda s: live.gated(s, kind), f"gate_{kind}")
    assert sorted(map(str, got.collect())) == sorted(map(str, gates.trace(ball, kind).collect()))


def test_transitions(spark, tmp_path):
    rows = spark.createDataFrame(game.possessed(spark, SF).toPandas(), "clip_no int, frame_idx int, holder int")
    got = streamed(spark, tmp_path, rows, live.transitions, "changes")
    assert sorted(got.collect()) == sorted(events.transitions(rows).select(*got.columns).collect())


def test_distances(spark, tmp_path):
    rows = game.placed(spark, SF)
    got = streamed(spark, tmp_path, rows, live.distances, "moves")
    wanted = kinematics.kinematics(rows).select(*got.columns)
    key = lambda r: (r["clip_no"], r["track_id"], r["frame_idx"], r["gap"], round(r["total_m"], 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, wanted.collect()))
