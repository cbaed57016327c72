"""Streams with held-back rows give their batch rows for any cut, through restarts, and close by mark or timer."""

from __future__ import annotations

import random
import time

import pytest

from frameflow.operators import kinematics
from frameflow.streaming import stateful
from tests.test_sweeps import machine

ROWS = "clip_no int, frame_idx int, candidate int, confidence double"


def clips(seed):
    """Candidates with short and long streaks, frames without a ball, and detections that are filled for long."""
    rnd = random.Random(seed)
    rows = []
    for clip in range(3):
        c = -1
        for f in range(60):
            c = rnd.choice([-1, 1, 2]) if rnd.random() < 0.25 else c
            rows.append((clip, f, None if rnd.random() < 0.1 else c, rnd.choice([0.0, 0.0, 0.8]) if clip else 0.9))
    return [(clip, f, c, None if c is None else conf) for clip, f, c, conf in rows]


def loop(rows, hold):
    """The machine of the batch tests, fed with candidates: one player a number, far enough apart."""
    out = []
    for clip in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == clip)
        balls = [None if c is None else (1_000.0 * c + 30 if c > 0 else -5_000.0, 75.0, conf) for _, _, c, conf in own]
        players = [[(t, 1_000.0 * t, 0.0) for t in (1, 2)] for _ in own]
        out += [(clip, r[1], h) for r, h in zip(own, machine(balls, players, hold, 20.0, 0.8), strict=True)]
    return out


@pytest.mark.parametrize(("seed", "hold", "cuts"), [(1, 4, [7, 31]), (2, 1, []), (3, 6, [20, 21, 22, 50])])
def test_any_cut_gives_the_rows_of_the_machine(spark, tmp_path, seed, hold, cuts):
    rows = clips(seed)
    table = spark.createDataFrame(rows + [(c, None, None, None) for c in range(3)], ROWS).repartition(3)
    got = stateful.replayed(table, lambda s: stateful.possession(s, hold), str(tmp_path / "s"), cuts, 3)
    assert sorted(map(tuple, got.collect())) == loop(rows, hold)


def test_rows_wait_until_they_are_sure(spark, tmp_path):
    """Two frames of a streak of three wait; the third lets them out; those of a broken streak go out as nobody's."""
    path = str(tmp_path / "s")

    def feed(*rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{path}/new")
        return sorted(map(tuple, stateful.drained(stateful.possession(spark.readStream.schema(ROWS).parquet(f"{path}/new"), 3), path, 2).collect()))

    assert feed((1, 0, 5, 0.0), (1, 1, 5, 0.9)) == []
    assert feed((1, 2, 5, 0.0), (1, 3, 6, 0.9)) == [(1, 0, 5), (1, 1, 5), (1, 2, 5)]
    assert feed((1, 4, -1, 0.9), (2, 0, 7, 0.9))[3:] == [(1, 3, -1), (1, 4, -1)]
    assert feed((2, None, None, None))[5:] == [(2, 0, -1)]


def test_a_silent_clip_is_closed_by_its_timer(spark, tmp_path):
    path = str(tmp_path / "s")

    def feed(*rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{path}/new")
        return sorted(map(tuple, stateful.drained(stateful.possession(spark.readStream.schema(ROWS).parquet(f"{path}/new"), 3, idle=1.0), path, 2).collect()))

    assert feed((1, 0, 5, 0.9), (1, 1, 5, 0.9)) == []
    time.sleep(2)
    assert feed((2, 0, -1, 0.9)) == [(1, 0, -1), (1, 1, -1), (2, 0, -1)]


@pytest.mark.parametrize("cuts", [[9, 10, 30], []])
def test_speed_over_cuts(spark, tmp_path, cuts):
    rnd = random.Random(4)
    rows = [(c, t, f, 0.3 * f + rnd.random(), rnd.random()) for c in (0, 1) for t in (1, 2) for f in range(50) if rnd.random() < 0.55 and not 20 < f < 29]
    table = spark.createDataFrame(rows, "clip_no int, track_id int, frame_idx int, x_m double, y_m double")
    got = stateful.replayed(table, stateful.speeds, str(tmp_path / "s"), cuts, 3)
    wanted = kinematics.kinematics(table).select(*got.columns)
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, wanted.collect()), key=str)


def test_speed_of_a_track_that_rests_while_its_clip_goes_on(spark, tmp_path):
    """The second track is not in the second part at all; it goes on from its last sighting in the third."""
    rows = [(0, 1, f, float(f), 0.0) for f in range(12)] + [(0, 2, f, 2.0 * f, 1.0) for f in (0, 1, 2, 9, 10, 11)]
    table = spark.createDataFrame(rows, "clip_no int, track_id int, frame_idx int, x_m double, y_m double")
    got = {(r["track_id"], r["frame_idx"]): r for r in stateful.replayed(table, stateful.speeds, str(tmp_path / "s"), [4, 8], 2).collect()}
    assert len(got) == len(rows)
    assert (got[2, 9]["gap"], got[2, 9]["suppressed"], got[2, 9]["speed"]) == (7, True, None)
    assert got[2, 11]["total_m"] == 22.0 and got[2, 10]["speed"] == 60.0


def test_a_clip_is_one_key(spark, tmp_path):
    """A key's cost is paid by clip, not by each of its tracks: the state has one group."""
    spark.createDataFrame([(0, t, 0, 1.0, 1.0) for t in range(1, 11)], "clip_no int, track_id int, frame_idx int, x_m double, y_m double").write.parquet(str(tmp_path / "new"))
    stream = stateful.speeds(spark.readStream.schema("clip_no int, track_id int, frame_idx int, x_m double, y_m double").parquet(str(tmp_path / "new")))
    assert stateful.drained(stream, str(tmp_path / "s"), 1).count() == 10
    due = spark.read.format("statestore").option("path", str(tmp_path / "s" / "checkpoint")).option("stateVarName", "due").load()
    assert due.count() == 1
