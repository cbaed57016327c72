"""Points followed in pixels: planted shifts and zooms, points that leave, flat and changed frames."""

from __future__ import annotations

import numpy as np
import pytest

from frameflow.operators import flow


def image(shift=(0.0, 0.0), zoom=1.0, size=(72, 128), seed=1, spots=30):
    """Soft spots at random places, moved and zoomed about the middle, in (y, x)."""
    rng = np.random.default_rng(seed)
    h, w = size
    middle = np.array([h / 2, w / 2])
    p = (rng.uniform([8, 8], [h - 8, w - 8], (spots, 2)) - middle) * zoom + middle + shift
    light = rng.uniform(60, 160, spots)
    ys, xs = np.arange(h)[:, None], np.arange(w)[:, None]
    out = 30 + (np.exp(-((ys - p[:, 0]) ** 2) / 5) * light) @ np.exp(-((xs - p[:, 1]) ** 2) / 5).T
    return np.clip(np.round(out), 0, 255)


@pytest.mark.parametrize("shift", [(0.0, 0.0), (1.0, -2.0), (0.4, 0.7), (-5.3, 6.2), (2.25, -7.5)])
def test_planted_shifts_within_a_tenth_of_a_pixel(shift):
    before, after, n = flow.tracked(image(), image(shift))
    assert len(before) >= flow.FEWEST and n <= flow.CORNERS
    assert np.abs(np.median(after - before, axis=0) - shift).max() < 0.1
    assert (np.abs(after - before - shift).max(1) < 0.25).mean() > 0.9


def test_corners_are_apart_and_flat_frames_have_none():
    found = flow.corners(image())
    d = np.abs(found[:, None] - found[None]).max(2) + 100 * np.eye(len(found))
    assert len(found) > 15 and d.min() > flow.APART
    assert len(flow.corners(np.full((40, 40), 9.0))) == 0
    edge = np.zeros((40, 40))
    edge[:, 20:] = 200  # a straight edge changes in one direction only
    assert len(flow.corners(edge)) == 0


def test_points_that_do_not_come_back_are_dropped():
    before, _, _ = flow.tracked(image(), image(seed=99))
    assert len(before) < 0.5 * len(flow.corners(image()))


FRAMES = "clip_no int, frame_idx int, height int, width int, pixels binary"


def test_motion_of_frames(spark):
    """Zoom about the centre leaves it in place; a gap takes the last frame there is; flat frames, other sizes and missing pixels have no motion."""
    row = lambda c, f, x: (c, f, x.shape[0], x.shape[1], x.astype(np.uint8).tobytes())
    rows = [row(0, 0, image()), row(0, 1, image(zoom=1.03)), row(0, 5, image((0, 3.0), zoom=1.03)), row(1, 0, np.full((50, 60), 7.0)), row(1, 1, np.full((50, 60), 7.0)), row(1, 2, image()), (1, 3, 72, 128, None), row(2, 9, image())]
    got = {(r["clip_no"], r["frame_idx"]): r for r in flow.motions(spark.createDataFrame(rows, FRAMES).repartition(3)).collect()}
    assert got.keys() == {(0, 1), (0, 5), (1, 1), (1, 2), (1, 3)}
    zoomed, moved = got[0, 1], got[0, 5]
    assert abs(zoomed["dx"]) < 0.1 and abs(zoomed["dy"]) < 0.1 and abs(zoomed["scale"] - 1.03) < 0.003
    assert moved["last_frame"] == 1 and abs(moved["dx"] - 3) < 0.1 and abs(moved["dy"]) < 0.1 and abs(moved["scale"] - 1) < 0.003
    assert {k: (r["points"], r["dx"]) for k, r in got.items() if k[0] == 1} == {(1, 1): (0, None), (1, 2): (0, None), (1, 3): (0, None)}
    assert flow.motions(spark.createDataFrame([], FRAMES)).count() == 0


def test_drawn_frames(spark):
    rows = spark.createDataFrame([(0, 0, [(10.0, 5.0, 100)]), (0, 1, [])], "clip_no int, frame_idx int, points array<struct<x:double,y:double,light:int>>")
    got = {r["frame_idx"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]) for r in flow.drawn(rows, 12, 20).collect()}
    assert got[0][5, 10] == 130 and got[0].sum() > got[1].sum() and set(got[1].ravel()) == {30}


def shifted(n):
    return np.stack([image((0.3 * k % 4, -0.2 * k), zoom=1 + k / 2000, seed=k % 3) for k in range(n)])


def test_pairs_of_a_stack_are_followed_together(monkeypatch):
    """As many steps as the slowest point of all pairs takes, not as the pairs take one after another; and each pair's own points."""
    frames, calls = shifted(41), []
    windows = flow.windows
    monkeypatch.setattr(flow, "windows", lambda *a: calls.append(1) or windows(*a))
    of, p, q, n = flow.tracked_stack(frames[:-1], frames[1:])
    assert len(calls) <= 2 * flow.LEVELS * (1 + flow.ROUNDS)
    for k in range(40):
        a, b, corners = flow.tracked(frames[k], frames[k + 1])
        assert corners == n[k] and np.array_equal(p[of == k], a) and np.abs(q[of == k] - b).max() < 1e-3


def test_pairs_are_drawn_where_they_are_followed(spark):
    """The same motions as of frames of pixels, but no pixels below a shuffle."""
    rng = np.random.default_rng(3)
    base = [(float(x), float(y), int(v)) for x, y, v in zip(rng.uniform(8, 120, 20), rng.uniform(8, 64, 20), rng.integers(60, 160, 20), strict=True)]
    moved = lambda k: [(x + k, y - k % 2, v) for x, y, v in base]
    rows = [(0, 0, moved(0)), (0, 1, moved(2)), (0, 7, moved(1)), (0, 8, []), (1, 4, moved(0)), (1, 5, moved(3)[:12]), (2, 0, moved(0))]
    points = spark.createDataFrame(rows, "clip_no int, frame_idx int, points array<struct<x:double,y:double,light:int>>").repartition(3)
    got = flow.drawn_motions(points, 72, 128)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flow.motions(flow.drawn(points, 72, 128)).collect()))
    assert {(r["clip_no"], r["frame_idx"]): r["dx"] and round(r["dx"]) for r in got.collect()} == {(0, 1): 2, (0, 7): -1, (0, 8): None, (1, 5): 3}


def test_the_query_shuffles_no_pixels(spark):
    from frameflow import catalog

    plan = catalog.queries()["k12_point_tracking"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().treeString().splitlines()
    first = next(i for i, x in enumerate(plan) if "Exchange" in x)
    assert [x for x in plan[:first] if "MapIn" in x] and not [x for x in plan[first:] if "MapIn" in x]
