"""Leave-one-out residuals and their tables against a plain loop."""

from __future__ import annotations

import statistics
from itertools import combinations

import numpy as np
import pytest

from frameflow.functions.court import TEMPLATE
from frameflow.operators import court
from frameflow.sources import scene

KEYPOINTS = "clip_no int, frame_idx int, idx int, eid long, x double, y double, confidence double"


def plane_fit(image, plane):
    """Direct linear transform of one set of points after moving and scaling both; the map and the ratio of the last but one to the first singular value."""

    def moved(p):
        p = np.array(p, float)
        c = p.mean(0)
        s = np.sqrt(2) / np.sqrt(((p - c) ** 2).sum(1)).mean()
        return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, ta), (b, tb) = moved(image), moved(plane)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, size, basis = np.linalg.svd(np.array(rows))
    return np.linalg.inv(tb) @ basis[8].reshape(3, 3) @ ta, size[7] / size[0]


def on(h, x, y):
    v = h @ [x, y, 1]
    return v[0] / v[2], v[1] / v[2]


def flat(points):
    """No four of the points without three on one line."""
    line = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 < 0.01
    return not any(not any(line(*t) for t in combinations(q, 3)) for q in combinations(points, 4))


def loop(frames):
    """frames: {(clip, frame): [(idx, x, y)]} of confident landmarks."""
    out = {}
    for (clip, f), points in frames.items():
        for held in points:
            others = [p for p in points if p != held]
            if len(points) < 5:
                continue
            plane = [TEMPLATE[i][:2] for i, _, _ in others]
            if flat(plane):
                out[clip, f, held[0]] = ("collinear", None, None, None)
                continue
            h, c = plane_fit([p[1:] for p in others], plane)
            truth = TEMPLATE[held[0]][:2]
            m, px = on(h, *held[1:]), on(np.linalg.inv(h), *truth)
            out[clip, f, held[0]] = ("scored", np.hypot(m[0] - truth[0], m[1] - truth[1]), np.hypot(px[0] - held[1], px[1] - held[2]), c)
    return out


@pytest.fixture(scope="module")
def made():
    """Landmarks of three clips under a projective camera, found some pixels off; frames with few, with many and with only flat sets of them."""
    rng = np.random.default_rng(9)
    frames = {}
    for clip in range(3):
        for f in range(14):
            n = int(rng.choice([0, 3, 4, 5, 6, 9, 12, 18]))
            chosen = sorted(rng.choice(18, n, replace=False).tolist()) if f else [0, 1, 2, 3, 4, 5]  # the first frame: all on one side line
            points = []
            for i in chosen:
                x, y = TEMPLATE[i][:2]
                w = 1 + x / 200 + y / 300
                points.append((i, (38 * x + 3 * y + 60) / w + rng.normal() * 2, (2 * x + 29 * y + 90) / w + rng.normal() * 2))
            frames[clip, f] = points
    return frames


def left_out(spark, made):
    rows = [(c, f, i, 0, x, y, 0.9) for (c, f), points in made.items() for i, x, y in points] + [(c, f, 99 % 18, 0, 1.0, 1.0, 0.1) for c, f in made if not made[c, f]]
    return court.left_out(court.point_sets(spark.createDataFrame(rows, KEYPOINTS), scene.template(spark)))


def test_residuals_against_a_loop(spark, made):
    wanted = loop(made)
    got = {(r["clip_no"], r["frame_idx"], r["idx"]): r for r in left_out(spark, made).collect()}
    assert got.keys() == wanted.keys()
    assert {s for s, *_ in wanted.values()} == {"scored", "collinear"}
    for k, (state, *figures) in wanted.items():
        r = got[k]
        assert r["state"] == state
        if state == "scored":
            assert np.allclose([r["error_m"], r["error_px"], r["conditioning"]], figures, rtol=1e-5, atol=1e-8)
        else:
            assert (r["error_m"], r["error_px"], r["conditioning"]) == (None, None, None)


def quartiles(values):
    return tuple(float(np.quantile(values, p)) for p in (0.25, 0.5, 0.75))


def test_tables_against_a_loop(spark, made):
    found, wanted = left_out(spark, made), {k: v for k, v in loop(made).items() if v[0] == "scored"}
    scopes = {None: wanted} | {c: {k: v for k, v in wanted.items() if k[0] == c} for c in range(3)}
    label = lambda n: str(n) if n < 9 else "9+"
    for c, own in scopes.items():
        by_n, by_i = {}, {}
        for (clip, f, i), v in own.items():
            by_n.setdefault(label(len(made[clip, f])), []).append(v)
            by_i.setdefault(i, []).append(v)
        got = {r["bucket"]: r for r in court.by_bucket(found, "n", "error_m").collect() if r["clip_no"] == c}
        assert got.keys() == by_n.keys()
        for b, vs in by_n.items():
            assert got[b]["n"] == len(vs) and np.allclose([got[b][k] for k in ("q25", "median", "q75")], quartiles([v[1] for v in vs]), atol=1e-6)
        got = {r["bucket"]: r for r in court.conditioning(found).collect() if r["clip_no"] == c}
        for b, vs in by_n.items():
            k = [v[3] for v in vs]
            assert np.allclose([got[b][x] for x in ("least", "q25", "median", "q75", "largest")], [min(k), *quartiles(k), max(k)], rtol=1e-6)
        got = {r["idx"]: r for r in court.by_index(found).collect() if r["clip_no"] == c}
        assert got.keys() == by_i.keys()
        for i, vs in by_i.items():
            assert np.allclose([got[i][f"{k}_{u}"] for u in ("m", "px") for k in ("q25", "median", "q75")], [*quartiles([v[1] for v in vs]), *quartiles([v[2] for v in vs])], rtol=1e-5)


def test_coverage_adds_up(spark, made):
    frames = spark.createDataFrame(list(made), "clip_no int, frame_idx int")
    every = loop(made)
    for r in court.coverage(frames, left_out(spark, made)).collect():
        states = {f: [v[0] for k, v in every.items() if k[:2] == (r["clip_no"], f)] for f in range(14)}
        assert r["n_frames"] == 14 and r["reconciles"]
        assert r["skipped"] == sum(not s for s in states.values())
        assert r["scored_frames"] == sum("scored" in s for s in states.values())
        assert r["lost_collinear"] == sum(set(s) == {"collinear"} for s in states.values()) >= 1
        assert r["lost_degenerate"] == 0
        assert (r["scored_fits"], r["collinear_fits"]) == tuple(sum(s.count(x) for s in states.values()) for x in ("scored", "collinear"))


def test_stability(spark):
    rows = [(0, f, 3, 0, 10.0 * f * (f + 1) / 2, 0.0, 0.9 if f != 4 else 0.1) for f in range(9)]
    got = court.stability(court.displacements(spark.createDataFrame(rows, KEYPOINTS))).collect()
    moves = [10.0, 20.0, 30.0, 60.0, 70.0, 80.0]
    assert [tuple(r) for r in got] == [(0, 3, 6, statistics.median(moves), 80.0)]


def test_a_frame_goes_to_its_task_once(spark, made):
    """The sets without one landmark are made within the task, not by rows that hold all others again."""
    rows = [(c, f, i, 0, x, y, 0.9) for (c, f), points in made.items() for i, x, y in points]
    sets = court.point_sets(spark.createDataFrame(rows, KEYPOINTS), scene.template(spark))
    assert "Generate" not in court.left_out(sets)._jdf.queryExecution().executedPlan().treeString()


def test_weak_designs_are_decomposed_themselves():
    """Points near one line: the product of the design with itself would lose the digits that decide."""
    from frameflow.functions.court import fit_homographies, smallest

    rng = np.random.default_rng(4)
    rows = rng.normal(size=(40, 16, 9))
    rows[20:, :, 7] = rows[20:, :, 6] + 1e-7 * rows[20:, :, 7]
    rows[20:, :, 8] = rows[20:, :, 5] + 1e-9 * rows[20:, :, 8]
    _, size, basis = np.linalg.svd(rows, full_matrices=False)
    least, ratio = smallest(rows)
    assert np.allclose(ratio, size[:, 7] / size[:, 0], rtol=1e-6)
    assert np.allclose(np.abs((least * basis[:, -1]).sum(1)), 1, atol=1e-9)
    assert not fit_homographies(np.ones((1, 5, 2)), np.ones((1, 5, 2)))[2].any()
