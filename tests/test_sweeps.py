"""Exact ranks, the lattice of possession settings and choices by leaving one group out, against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators import lattice, possession, ranks
from frameflow.plans import sweeps
from frameflow.sources import scene

SF = "/root/testdata/sf0.001"
TABLE = "g string, v double"


def test_quantiles_are_exact(spark):
    rnd = random.Random(2)
    groups = {"many": [rnd.random() for _ in range(700)], "equal": [3.0] * 500, "two": [1.0, 2.0], "one": [-7.5], None: [float(i % 9) for i in range(100)], "nulls": [None, None, float("nan")]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    fractions = {"low": 0.0, "a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999, "high": 1.0}
    got = {r["g"]: r for r in ranks.quantiles(spark.createDataFrame(rows, TABLE).repartition(5), ["g"], "v", fractions).collect()}
    assert got.keys() == groups.keys() - {"nulls"}
    for g, vs in groups.items():
        if g != "nulls":
            assert got[g]["n"] == len(vs)
            for name, f in fractions.items():
                assert math.isclose(got[g][name], float(np.quantile(vs, f)), rel_tol=1e-12, abs_tol=1e-12)
    assert ranks.quantiles(spark.createDataFrame([], TABLE), [], "v", fractions).count() == 0


def test_a_group_of_a_million_values_is_spread(spark):
    """No task holds more than a small part of a group's distinct values."""
    rows = spark.range(1_000_000).select((F.col("id") * 7_919 % 1_000_003).cast("double").alias("v"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    small = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        ranked = ranks.ranked(rows, [], "v")
        ordered = ranked.orderBy("value").select("before", "n", "total").toPandas()
        assert (ordered["before"].to_numpy() == np.arange(1_000_000)).all()
        assert set(ordered["total"]) == {1_000_000}
        placed = rows.groupBy("v").count().repartitionByRange("v").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert placed.max() < 300_000
        q = ranks.quantiles(rows, [], "v", {"m": 0.5, "p": 0.999}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", small)
    values = np.arange(1_000_000) * 7_919 % 1_000_003
    assert (q["m"], q["p"]) == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.999)))


def test_quantiles_of_all_other_folds(spark):
    rnd = random.Random(6)
    rows = [(f, round(rnd.gauss(ord(f), 9), rnd.choice([0, 3]))) for f in "abcdefg" for _ in range(rnd.randint(1, 60))] + [("x", 1e9)] * 40 + [("y", None)]
    got = {r["g"]: r for r in ranks.left_out_quantiles(spark.createDataFrame(rows, TABLE), "g", "v", {"lo": 0.001, "q": 0.3, "hi": 0.999}).collect()}
    for f in {g for g, _ in rows}:
        others = [v for g, v in rows if g != f and v is not None]
        assert got[f]["n"] == len(others)
        for name, p in (("lo", 0.001), ("q", 0.3), ("hi", 0.999)):
            assert math.isclose(got[f][name], float(np.quantile(others, p)), rel_tol=1e-9)
    alone = ranks.left_out_quantiles(spark.createDataFrame([("a", 1.0), ("a", 2.0)], TABLE), "g", "v", {"m": 0.5}).collect()
    assert [(r["g"], r["n"], r["m"]) for r in alone] == [("a", 0, None)]


def machine(balls, players, hold, reach, overlap):
    """The possession machine as a loop over one clip's frames; balls[f] is None or (cx, cy, confidence)."""
    held, owner, start, length, anchored, sure = [-1] * len(balls), None, 0, 0, False, False
    for f, ball in enumerate(balls):
        if ball is None:
            continue
        cx, cy, conf = ball
        inside, near = [], []
        for order, (t, x1, y1) in enumerate(players[f]):
            x2, y2 = x1 + 60, y1 + 150
            w, h = min(x2, cx + 6) - max(x1, cx - 6), min(y2, cy + 6) - max(y1, cy - 6)
            inside.append((-(w * h / 144 if w > 0 and h > 0 else 0.0), order, t))
            mx, my = (x1 + x2) / 2, (y1 + y2) / 2
            spots = [(x1, y1), (x2, y1), (x1, y2), (x2, y2), (mx, y1), (mx, y2), (x1, my), (x2, my), (mx, my), (mx, y1 + (y2 - y1) / 3)]
            spots += [(x1, cy), (x2, cy)] if y1 < cy < y2 else []
            spots += [(cx, y1), (cx, y2)] if x1 < cx < x2 else []
            near.append((min(math.hypot(a - cx, b - cy) for a, b in spots), order, t))
        best = -1
        if inside and -min(inside)[0] > overlap:
            best = min(inside)[2]
        elif near and min(near)[0] < reach:
            best = min(near)[2]
        if best == -1:
            owner, length, anchored, sure = None, 0, False, False
            continue
        if best == owner:
            length += 1
        else:
            owner, start, length, anchored, sure = best, f, 1, False, False
        anchored = anchored or conf > 0
        if not sure and length >= hold and anchored:
            sure = True
            held[start : f + 1] = [owner] * (f + 1 - start)
        elif sure:
            held[f] = owner
    return held


def made_clips(seed):
    """Clips with frames without a ball, filled detections, few players, and one clip without any ball."""
    rnd = random.Random(seed)
    clips = {}
    for clip in range(4):
        x, balls, players = 100.0, [], []
        for _ in range(90):
            x += rnd.choice([-14, 0, 0, 9])
            balls.append(None if clip == 3 or rnd.random() < 0.12 else (x, 200.0 + rnd.choice([0, 30, 90]), rnd.choice([0.0, 0.0, 0.7]) if clip else 0.6))
            players.append([(t, 40.0 + 45 * t, 150.0 + 10 * (t % 3)) for t in range(1, 5) if rnd.random() < 0.8])
        clips[clip] = (balls, players)
    truth = {(c, f): rnd.choice([-1, 1, 2, 3]) for c in clips for f in range(90) if rnd.random() < 0.8}
    return clips, truth


@pytest.mark.parametrize("seed", [1, 2])
def test_lattice_against_the_machine(spark, seed):
    clips, truth = made_clips(seed)
    frames = spark.createDataFrame([(c, f) for c in clips for f in range(90)], "clip_no int, frame_idx int")
    ball = spark.createDataFrame([(c, f, *b) for c, (balls, _) in clips.items() for f, b in enumerate(balls) if b], "clip_no int, frame_idx int, cx double, cy double, confidence double")
    boxes = spark.createDataFrame([(c, f, t, k, x, y, x + 60, y + 150) for c, (_, ps) in clips.items() for f, own in enumerate(ps) for k, (t, x, y) in enumerate(own)],
                                  "clip_no int, frame_idx int, track_id int, det_order int, x1 double, y1 double, x2 double, y2 double")
    known = spark.createDataFrame([(*k, v) for k, v in truth.items()], "clip_no int, frame_idx int, truth int")
    holds, reaches, overlaps = (1, 2, 5, 9), (10.0, 40.0, 41.0, 90.0), (0.2, 0.5, 0.9)
    got = {(r["clip_no"], r["hold"], r["reach"], r["overlap"]): r for r in lattice.lattice(frames, ball, boxes, known, holds, reaches, overlaps).collect()}
    assert len(got) == 4 * 4 * 4 * 3
    for clip, hold, reach, overlap in itertools.product(clips, holds, reaches, overlaps):
        held = machine(*clips[clip], hold, reach, overlap)
        seen = [(held[f], truth[clip, f], clips[clip][0][f]) for f in range(90) if (clip, f) in truth]
        r = got[clip, hold, reach, overlap]
        assert r["n"] == len(seen)
        assert r["n_held"] == sum(t != -1 for _, t, _ in seen)
        assert r["n_right"] == sum(h == t for h, t, _ in seen)
        assert r["right_held"] == sum(h == t != -1 for h, t, _ in seen)
        assert r["right_empty"] == sum(h == t == -1 for h, t, _ in seen)
        assert r["right_real"] == sum(h == t for h, t, b in seen if b and b[2] > 0)
    # the plain operator is the machine too
    for clip in clips:
        one = possession.possession(frames.where(F.col("clip_no") == clip), possession.holders(ball.where(F.col("clip_no") == clip), boxes, 0.5, 40.0), 2)
        assert [r["holder"] for r in one.orderBy("frame_idx").collect()] == machine(*clips[clip], 2, 40.0, 0.5)


def test_limits_that_change_nothing_share_a_sequence(spark):
    found = spark.createDataFrame([(0, 2, 3), (0, 5, 6), (1, 0, 0)], "clip_no int, upper int, lower int")
    rows = {(r["clip_no"], r["i"], r["j"]): (r["first_i"], r["first_j"]) for r in lattice.sequences(found, 6, 5).collect()}
    assert len(rows) == 2 * 30
    assert {v for (c, _, _), v in rows.items() if c == 0} == {(0, 0), (0, 3), (2, 0), (2, 3)}
    assert {v for (c, _, _), v in rows.items() if c == 1} == {(0, 0)}


def test_scene_is_read_once(spark):
    """The plan of 240 settings has the scans and windows of the plan of one."""
    shape = lambda df: [len(re.findall(x, df._jdf.queryExecution().optimizedPlan().toString())) for x in (r"Relation \[", r"\bWindow \[")]
    assert shape(sweeps.swept(spark, SF)) == shape(sweeps.swept(spark, SF, holds=(5,), reaches=(50.0,), overlaps=(0.8,)))


def test_leave_one_out(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.1), ("b", 1, 0.2), ("b", 2, 0.8), ("c", 1, 0.3), ("c", 2, 0.3), ("c", 3, 1.0), ("d", 1, None)]
    got = {r["f"]: tuple(r)[1:] for r in lattice.leave_one_out(spark.createDataFrame(rows, "f string, k int, s double"), "f", ["k"], "s").collect()}
    assert got == {"a": (2, 0.55, 0.1), "b": (1, 0.6, 0.2), "c": (1, 0.55, 0.3), "d": (1, 0.466667, None)}
    assert lattice.leave_one_out(spark.createDataFrame([("a", 1, 0.5)], "f string, k int, s double"), "f", ["k"], "s").count() == 0


def test_frames_of_the_scene(spark):
    assert scene.frames(spark, SF).count() == 1_000
