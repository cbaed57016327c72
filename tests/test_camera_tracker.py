"""Camera motion with planted outliers, and the tracker's filter, gaps and crossings, against plain loops and by hand."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from frameflow.operators import camera, tracker
from frameflow.streaming import stateful

POINTS = "clip_no int, frame_idx int, idx int, x double, y double, confidence double"


def consensus(z, w, near):
    """Best agreement over all pairs of points, one at a time."""
    best = (0, 0.0, None)
    for i, j in combinations(range(len(z)), 2):
        if abs(z[j] - z[i]) < 1e-9:
            continue
        m = (w[j] - w[i]) / (z[j] - z[i])
        errors = [abs(m * a + (w[i] - m * z[i]) - b) for a, b in zip(z, w, strict=True)]
        own = [e <= near for e in errors]
        key = (sum(own), -sum(e * e for e in errors if e <= near), own)
        if best[2] is None or key[:2] > best[:2]:
            best = key
    return best[2]


def test_similarity_against_a_loop():
    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 18):
        z = rng.uniform(0, 900, (20, n)) + 1j * rng.uniform(0, 500, (20, n))
        m, t = 1 + rng.normal(size=20) / 50 + 1j * rng.normal(size=20) / 50, rng.normal(size=20) * 30 + 1j * rng.normal(size=20) * 30
        w = m[:, None] * z + t[:, None] + rng.normal(size=(20, n)) / 10
        far = rng.random((20, n)) < (0.2 if n > 3 else 0)
        w[far] += 150 * np.exp(1j * rng.uniform(0, 6.28, far.sum()))
        got, shift, own = camera.fit_similarities(z, w, camera.proposals(n, [(0, k) for k in range(20)]))
        for k in range(20):
            inside = np.array(consensus(z[k], w[k], camera.NEAR_PX))
            assert own[k].tolist() == inside.tolist()
            a = np.array([[x.real, -x.imag, 1, 0] for x in z[k][inside]] + [[x.imag, x.real, 0, 1] for x in z[k][inside]])
            b = np.r_[w[k][inside].real, w[k][inside].imag]
            want = np.linalg.lstsq(a, b, rcond=None)[0]
            assert np.allclose([got[k].real, got[k].imag, shift[k].real, shift[k].imag], want, atol=1e-6)


def test_many_points_are_drawn_and_repeat():
    rng = np.random.default_rng(2)
    z = rng.uniform(0, 900, (3, 60)) + 1j * rng.uniform(0, 500, (3, 60))
    w = (0.99 + 0.02j) * z + (12 - 5j)
    w[:, :15] += 200
    pairs = camera.proposals(60, [(1, 2), (1, 3), (1, 2)])
    assert pairs.shape == (3, camera.SAMPLES, 2) and (pairs[0] == pairs[2]).all() and (pairs[0] != pairs[1]).any() and (pairs[:, :, 0] != pairs[:, :, 1]).all()
    m, t, own = camera.fit_similarities(z, w, pairs)
    assert np.allclose(m, 0.99 + 0.02j) and np.allclose(t, 12 - 5j) and own.sum(1).tolist() == [45] * 3


def test_motion_of_frames(spark):
    """A zoom about the centre moves nothing there; a gap takes the last frame there is; outliers, equal points and few points."""
    base = [(100.0 + 130 * (k % 4), 80.0 + 140 * (k // 4)) for k in range(8)]
    rows = [(0, 0, k, x, y, 0.9) for k, (x, y) in enumerate(base)]
    rows += [(0, 3, k, 300 + 1.01 * (x - 300), 200 + 1.01 * (y - 200), 0.9) for k, (x, y) in enumerate(base)]
    rows += [(0, 4, k, 300 + 1.01 * (x - 300) + 7 + (90 if k in (1, 5) else 0), 200 + 1.01 * (y - 200), 0.9) for k, (x, y) in enumerate(base)]
    rows += [(0, 5, 0, 1.0, 1.0, 0.9), (0, 5, 1, 1.0, 1.0, 0.2)]
    rows += [(1, f, k, 5.0, 5.0, 0.9) for f in (0, 1) for k in range(6)] + [(1, 2, 0, None, 1.0, 0.9)]
    got = {(r["clip_no"], r["frame_idx"]): r for r in camera.motion(camera.matched(spark.createDataFrame(rows, POINTS)), (300.0, 200.0)).collect()}
    assert {k: (r["last_frame"], r["n"], r["status"], r["inliers"]) for k, r in got.items()} == {
        (0, 3): (0, 8, "ok", 8), (0, 4): (3, 8, "ok", 6), (0, 5): (4, 1, "few points", 0), (1, 1): (0, 6, "degenerate", 0), (1, 2): (1, 0, "few points", 0)}
    assert [round(got[0, 3][c], 9) for c in ("dx", "dy", "scale", "angle")] == [0, 0, 1.01, 0]
    assert [round(got[0, 4][c], 9) for c in ("dx", "dy", "scale", "angle")] == [7, 0, 1, 0]
    assert got[1, 1]["dx"] is None
    s = {r["clip_no"]: r for r in camera.summary(camera.motion(camera.matched(spark.createDataFrame(rows, POINTS)), (300.0, 200.0)), over=5.0).collect()}
    assert (s[0]["frame_pairs"], s[0]["estimated"], s[0]["over_limit"], round(s[0]["median_dx"], 6)) == (3, 2, 1, 3.5)
    assert (s[1]["estimated"], s[1]["median_dx"]) == (0, None)
    assert camera.motion(camera.matched(spark.createDataFrame([], POINTS)), (0.0, 0.0)).count() == 0


# --- the filter -----------------------------------------------------------------------------------------------------
def test_filter_is_the_textbook_one():
    rng = np.random.default_rng(3)
    z = np.c_[rng.uniform(50, 500, (5, 2)), rng.uniform(0.3, 0.6, 5), rng.uniform(90, 200, 5)]
    mean, cov = tracker.began(z)
    f = np.eye(8) + np.eye(8, k=4)
    h = np.eye(4, 8)
    for _ in range(4):
        z = z + rng.normal(size=z.shape) * [3, 3, 0.01, 2]
        a, p = tracker.predicted(mean, cov)
        b, q = tracker.updated(a, p, z)
        for k in range(5):
            s = mean[k, 3]
            noise = np.diag([s / 20, s / 20, 1e-2, s / 20, s / 160, s / 160, 1e-5, s / 160]) ** 2
            x, c = f @ mean[k], f @ cov[k] @ f.T + noise
            assert np.allclose(x, a[k]) and np.allclose(c, p[k])
            r = np.diag([x[3] / 20, x[3] / 20, 1e-1, x[3] / 20]) ** 2
            gain = c @ h.T @ np.linalg.inv(h @ c @ h.T + r)
            assert np.allclose(x + gain @ (z[k] - h @ x), b[k]) and np.allclose((np.eye(8) - gain @ h) @ c, q[k])
        mean, cov = b, q


def box(x, y):
    return [x, y, x + 60.0, y + 150.0]


def run(frames, **settings):
    """frames: for each frame its boxes as (x, y, confidence); ids per frame by box, None without one."""
    t, out = tracker.Tracker(**settings), []
    for f, boxes in enumerate(frames):
        if boxes is None:
            continue
        got = dict(t.step(f, np.array([box(x, y) for x, y, _ in boxes]).reshape(-1, 4), np.array([c for *_, c in boxes])))
        out.append([got.get(k) for k in range(len(boxes))])
    return out


def test_ids_start_late_and_survive_a_gap():
    walk = [[(10.0 + 4 * f, 50.0, 0.9)] for f in range(12)]
    gap = [None] * 8
    ids = run([*walk, *gap, *[[(10.0 + 4 * f, 50.0, 0.9)] for f in range(20, 26)]])
    assert ids[0] == [None] and ids[1:12] == [[1]] * 11
    # found again where the filter expects it, after eight frames unseen
    assert ids[12:] == [[1]] * 6
    assert run([*walk, *[[] for _ in gap], *[[(10.0 + 4 * f, 50.0, 0.9)] for f in range(20, 26)]])[20:] == [[1]] * 6


def test_a_track_ends_after_its_buffer():
    still = [[(10.0, 50.0, 0.9)]] * 5
    assert run([*still, *[None] * 30, *still])[5:] == [[1]] * 5
    assert run([*still, *[None] * 31, *still])[5:] == [[None], [2], [2], [2], [2]]
    assert run([*still, *[None] * 31, *still], fps=60.0)[5:] == [[1]] * 5
    assert run([*still, *[None] * 8, *still], buffer=4)[5:] == [[None], [2], [2], [2], [2]]


def test_crossing_boxes_keep_their_ids():
    frames = [[(0.0 + 9 * f, 50.0, 0.9), (360.0 - 9 * f, 50.0, 0.9)] for f in range(41)]
    ids = run(frames)
    assert ids[1] == [1, 2]
    assert ids[-1] == [1, 2]


def test_weak_boxes_carry_a_track_but_start_none():
    assert run([[(10.0, 50.0, 0.9)]] * 3 + [[(10.0, 50.0, 0.3)]] * 5)[3:] == [[1]] * 5
    assert run([[(10.0, 50.0, 0.3)]] * 5) == [[None]] * 5
    assert run([[(10.0, 50.0, 0.55)]] * 5) == [[None]] * 5  # over the threshold, but not by the margin that a new track needs
    assert run([[(10.0, 50.0, 0.9)]] * 3 + [[(10.0, 50.0, 0.05)]] * 2)[3:] == [[None]] * 2


def test_one_sighting_is_no_track():
    frames = [[(900.0, 50.0, 0.9)]] * 3 + [[(900.0, 50.0, 0.9), (10.0, 50.0, 0.9)]] + [[(900.0, 50.0, 0.9)]] * 3
    assert [x for row in run(frames) for x in row] == [None, 1, 1, 1, None, 1, 1, 1]
    assert run([[], [(1.0, 2.0, 0.9)], []])[1] == [None]


DETECTIONS = "clip_no int, frame_idx int, det_order int, x1 double, y1 double, x2 double, y2 double, confidence double"


@pytest.mark.parametrize("cuts", [[], [6, 19]])
def test_tracks_of_a_table_and_of_a_stream(spark, tmp_path, cuts):
    rng = np.random.default_rng(5)
    rows = [(c, f, k, *box(200.0 * k + 5 * f + rng.normal(), 60.0 + 20 * c + rng.normal()), round(float(rng.uniform(0.2, 1)), 3)) for c in (0, 1) for f in range(30) for k in range(3) if rng.random() < 0.85]
    table = spark.createDataFrame(rows, DETECTIONS).repartition(3)
    pdf = pd.DataFrame(rows, columns=DETECTIONS.replace(" int", "").replace(" double", "").split(", "))
    wanted = sorted(tuple(r) for c in (0, 1) for r in tracker.fold(tracker.Tracker(), c, pdf[pdf["clip_no"] == c]).itertuples(index=False))
    assert len({r[2] for r in wanted}) >= 3
    got = stateful.replayed(table, stateful.tracked, str(tmp_path / "s"), cuts, 2) if cuts else tracker.track(table)
    assert sorted(map(tuple, got.collect())) == wanted
