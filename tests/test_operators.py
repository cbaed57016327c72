"""Hand-checked cases of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.functions import court as plane
from frameflow.functions import pixels
from frameflow.functions.boxes import Box, closest, containment, iou, softmax
from frameflow.operators import court, events, gates, kinematics, possession, teams, tracking
from frameflow.sources import files, scene, store


def frames(spark, n, clip=0):
    return spark.range(n).select(F.lit(clip).alias("clip_no"), F.col("id").cast("int").alias("frame_idx"))


def candidates(spark, values, confidence=0.9):
    """values: candidate by frame, None for a frame without a ball."""
    rows = [(0, i, confidence, v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "clip_no int, frame_idx int, confidence double, candidate int")


def holders(spark, values, hold=3, confidence=0.9):
    out = possession.possession(frames(spark, len(values)), candidates(spark, values, confidence), hold)
    return [r["holder"] for r in out.orderBy("frame_idx").collect()]


@pytest.mark.parametrize(("values", "wanted"), [
    ([1, 1, -1, 1, 1, 1], [-1, -1, -1, 1, 1, 1]),
    ([1, None, 1, 1], [1, 1, 1, 1]),
    ([1, 1, 2, 1], [-1, -1, -1, -1]),
    ([1, 1, 1, None, 1, 2, 2, 2], [1, 1, 1, -1, 1, 2, 2, 2]),
])
def test_possession(spark, values, wanted):
    assert holders(spark, values) == wanted


def test_possession_needs_a_genuine_ball(spark):
    assert holders(spark, [1, 1, 1, 1], confidence=0.0) == [-1] * 4


def test_possession_against_loop(spark):
    rng = random.Random(3)
    for _ in range(4):
        values = [rng.choice([1, 1, 1, 2, -1, None]) for _ in range(60)]
        real = [True] * 60
        wanted, streak, start, count, done = [-1] * 60, None, 0, 0, False
        for i, v in enumerate(values):
            if v is None:
                continue
            if v != streak:
                streak, start, count, done = v, i, 0, False
            count += 1
            if v != -1 and count >= 3 and real[i]:
                if not done:
                    wanted[start:i] = [v] * (i - start)
                    done = True
                wanted[i] = v
        assert holders(spark, values) == wanted


def test_fill(spark):
    ball = spark.createDataFrame([(0, 0, 0.0, 5.0, 0.9), (0, 2, 20.0, 5.0, 0.8)], "clip_no int, frame_idx int, cx double, cy double, confidence double")
    rows = possession.fill(frames(spark, 4), ball).orderBy("frame_idx").collect()
    assert [(r["cx"], r["confidence"], r["is_real"]) for r in rows] == [(0, 0.9, True), (10, 0, False), (20, 0.8, True), (20, 0, False)]
    assert possession.fill(frames(spark, 4), ball.where("false")).count() == 0


def test_boxes(spark):
    row = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0)], "x1 double, y1 double, x2 double, y2 double")
    at = lambda c: row.select(c.alias("v")).first()["v"]
    lit = lambda *v: Box(*[F.lit(float(x)) for x in v])
    assert at(containment(Box.of(), lit(95, 95, 105, 105))) == 0.25
    assert at(containment(Box.of(), lit(100, 0, 110, 10))) == 0
    assert at(containment(Box.of(), lit(5, 5, 5, 9))) == 0
    assert at(iou(Box.of(), lit(0, 0, 100, 100))) == 1
    assert at(closest(Box.of(), F.lit(-10.0), F.lit(40.0))) == 10
    assert at(closest(Box.of(), F.lit(50.0), F.lit(50.0))) == 0
    assert at(closest(Box.of(), F.lit(-3.0), F.lit(-4.0))) == 5
    assert math.isclose(sum(at(softmax(F.array(F.lit(1000.0), F.lit(1001.0))))), 1)


def balls(spark, rows):
    return spark.createDataFrame([(0, f, float(x), float(y), 0.9) for f, x, y in rows], "clip_no int, frame_idx int, cx double, cy double, confidence double")


def kept(df):
    return [r["frame_idx"] for r in df.orderBy("frame_idx").collect()]


def test_gates(spark):
    jump = balls(spark, [(0, 0, 0), (1, 10, 0), (2, 500, 0), (3, 30, 0)])
    assert kept(gates.gate(jump, "frozen")) == [0, 1, 3]
    assert kept(gates.gate(jump, "predicted")) == [0, 1, 3]
    away = balls(spark, [(0, 0, 0), (10, 5000, 0), (11, 5010, 0)])
    assert kept(gates.gate(away, "stale")) == [0, 10, 11]
    assert kept(gates.gate(away, "frozen")) == [0]
    back = balls(spark, [(0, 0, 0), (1, 10, 0), (2, 20, 0), (3, 10, 0)])
    assert kept(gates.gate(back, "motion")) == [0, 1, 2]
    assert kept(gates.gate(back, "combined")) == [0, 1, 2]
    assert kept(gates.trajectory_gate(balls(spark, [(0, 0, 0), (1, 10_000, 0), (2, 20, 0)]))) == [0, 2]
    assert kept(gates.trajectory_gate(balls(spark, [(5, 1, 1)]))) == [5]


def slow_path(nodes, speed=100.0, skip=1000.0, gap=45):
    n = len(nodes)
    best, parent = [skip * j for j in range(n)], [-1] * n
    for j in range(n):
        for i in range(j):
            g = nodes[j][0] - nodes[i][0]
            d = math.dist(nodes[i][1:], nodes[j][1:])
            if g <= gap and d > speed * g:
                continue
            c = best[i] + skip * (j - i - 1) + (0 if g > gap else d * d / g)
            if c < best[j]:
                best[j], parent[j] = c, i
    end = min(range(n), key=lambda j: (best[j] + skip * (n - 1 - j), j))
    path = []
    while end != -1:
        path.append(end)
        end = parent[end]
    return path[::-1], best


def test_trajectory_against_loop():
    rng = random.Random(1)
    for _ in range(20):
        f = sorted(rng.sample(range(200), 40))
        nodes = [(k, float(rng.choice([k * 5, rng.randrange(3000)])), float(rng.randrange(100))) for k in f]
        a = np.array(nodes)
        path, best, _ = gates.best_path(a[:, 0].astype(int), a[:, 1], a[:, 2])
        wanted, cost = slow_path(nodes)
        assert path == wanted
        assert np.allclose(best, cost)


def test_events(spark):
    held = [1] + [-1] * 20 + [2, 2, 3]
    p = spark.createDataFrame([(0, i, v) for i, v in enumerate(held)], "clip_no int, frame_idx int, holder int")
    assert [r["frame_idx"] for r in events.transitions(p, 5).collect()] == [23]
    q = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 1])], "clip_no int, frame_idx int, holder int")
    team = spark.createDataFrame([(0, i, t, 1) for i in range(3) for t in (1, 2)], "clip_no int, frame_idx int, track_id int, team int")
    assert [r["kind"] for r in events.detected(events.transitions(q), team).orderBy("frame_idx").collect()] == ["pass", "pass"]


LABEL = "clip_no int, start_frame int, end_frame int, event_type string, from_team string, to_team string, from_track_id string, to_track_id string"
FOUND = "clip_no int, frame_idx int, kind string, from_track_id int, to_track_id int, from_team int, to_team int"


@pytest.mark.parametrize(("found", "tolerance", "strict", "wanted"), [
    ([(105, "pass", 5, 6, 1, 1)], 10, False, (1, 0, 0)),
    ([(118, "pass", 5, 6, 1, 1)], 10, False, (1, 0, 0)),
    ([(121, "pass", 5, 6, 1, 1)], 10, False, (0, 1, 1)),
    ([(105, "interception", 5, 6, 2, 1)], 10, False, (0, 1, 1)),
    ([(105, "pass", 5, 6, 2, 2)], 10, False, (0, 1, 1)),
    ([(105, "pass", 9, 8, 1, 1)], 10, False, (1, 0, 0)),
    ([(105, "pass", 9, 8, 1, 1)], 10, True, (0, 1, 1)),
    ([(104, "pass", 5, 6, 1, 1), (106, "pass", 5, 6, 1, 1)], 10, False, (1, 1, 0)),
])
def test_matching(spark, found, tolerance, strict, wanted):
    labels = spark.createDataFrame([(0, 100, 110, "pass", "1", "1", "5", "6"), (0, 100, 110, "shot", "1", "1", "5", "6")], LABEL)
    r = events.scores(labels, spark.createDataFrame([(0, *f) for f in found], FOUND), tolerance, strict).first()
    assert (r["tp"], r["fp"], r["fn"]) == wanted


def track(spark, points):
    return spark.createDataFrame([(0, f, 1, float(x), 0.0) for f, x in points], "clip_no int, frame_idx int, track_id int, x_m double, y_m double")


def test_speed(spark):
    steady = kinematics.kinematics(track(spark, [(i, i) for i in range(6)])).orderBy("frame_idx").collect()
    assert [r["speed"] for r in steady] == [None] + [30.0] * 5
    assert steady[-1]["total_m"] == 5
    gap = kinematics.kinematics(track(spark, [(i, i) for i in (0, 1, 2, 3, 10, 11)]), window=10).orderBy("frame_idx").collect()
    assert [r["speed"] for r in gap][-2:] == [None, 30.0]
    assert [r["suppressed"] for r in gap] == [False] * 4 + [True, False]


def test_homography():
    rng = np.random.default_rng(0)
    court_points = np.array([(x, y) for x, y, *_ in plane.TEMPLATE])
    w = 1 + court_points[:, 0] / 200 + court_points[:, 1] / 300
    image = np.c_[(38 * court_points[:, 0] + 3 * court_points[:, 1] + 60) / w, (2 * court_points[:, 0] + 29 * court_points[:, 1] + 90) / w]
    for _ in range(20):
        some = rng.choice(18, 7, replace=False)
        if not plane.general_quadruple(some.tolist()):
            continue
        h, _ = plane.fit_homography(image[some], court_points[some])
        p = np.c_[image, np.ones(18)] @ h.T
        assert np.abs(p[:, :2] / p[:, 2:] - court_points).max() < 1e-8
    assert not plane.general_quadruple([0, 1, 2, 3])
    assert plane.general_quadruple([0, 5, 8, 9])
    assert court.set_status((0, 1, 2)) == "insufficient"


def test_assignment_is_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5)):
        c = rng.random((n, m))
        got = sum(c[a, b] for a, b in tracking.assign(c))
        small, big = min(n, m), max(n, m)
        cc = c if n <= m else c.T
        assert math.isclose(got, min(sum(cc[i, p[i]] for i in range(small)) for p in permutations(range(big), small)))
    assert tracking.assign(np.full((1, 1), np.inf)) == []


def test_mot(spark):
    box = lambda i: (10.0 * i, 0.0, 10.0 * i + 8, 8.0)
    labels = spark.createDataFrame([(0, f, g, *box(g)) for f in range(4) for g in (1, 2)], "clip_no int, frame_idx int, gt_id int, x1 double, y1 double, x2 double, y2 double")
    swap = [(0, f, 10 + g if f < 2 else 13 - g, *box(g)) for f in range(4) for g in (1, 2)] + [(0, 3, 30, *box(50))]
    tracks = spark.createDataFrame(swap, "clip_no int, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    r = tracking.metrics(labels, tracks).first()
    assert (r["matches"], r["switches"], r["misses"], r["false_positives"]) == (8, 2, 0, 1)
    assert r["mota"] == round(1 - 3 / 8, 6)


def test_two_means_against_a_loop(spark):
    """Two directions in each group: every vector is with its own direction, in one part or many, and a group of one kind of row is no error."""
    rng = np.random.default_rng(2)
    rows, side = [], {}
    for g in ("a", "b"):
        for i in range(60):
            v = np.zeros(6)
            v[0 if i % 2 else 3] = 1
            rows.append((g, i, (v + rng.normal(0, 0.05, 6)).tolist()))
            side[g, i] = i % 2
    rows += [("c", 0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])] * 2
    data = spark.createDataFrame(rows, "g string, id int, v array<double>")
    for parts in (1, 5):
        got = {(r["g"], r["id"]): (r["cluster"], r["margin"]) for r in teams.two_means(data.repartition(parts), "g", "id", "v", tries=4).collect()}
        assert len(got) == 121
        assert all(got[k][0] == (2 if s else 1) and got[k][1] > 0.7 for k, s in side.items())


def test_border_and_foreground():
    crop = np.full((20, 20, 3), 60.0)
    crop[5:15, 5:15] = 240
    assert pixels.border_colour(crop).tolist() == [60.0] * 3
    assert len(pixels.foreground(crop, pixels.border_colour(crop), 40)) == 100
    assert pixels.border_colour(np.full((3, 3, 3), 70.0)).tolist() == [70.0] * 3
    crop = np.full((40, 40, 3), 60.0)
    crop[10:30, 10:30] = crop[0:4, 0:4] = 240
    assert 60 < pixels.border_colour(crop).mean() < 75


def test_colour_teams(spark):
    """Lighter jerseys are team 1 whatever their ids; crops without a colour have no team; too few colours are an error."""
    rows = [("a", i, [200.0 + i, 190.0, 180.0] if i % 3 == 0 else [40.0 + i, 30.0, 20.0]) for i in range(30)] + [("a", 99, None)]
    got = {r["id"]: r for r in teams.colour_teams(spark.createDataFrame(rows, "g string, id int, c array<double>"), "g", "id", "c").collect()}
    assert all(got[i]["predicted_team"] == (1 if i % 3 == 0 else 2) and got[i]["confidence"] > 0.8 for i in range(30))
    assert (got[99]["predicted_team"], got[99]["confidence"], got[99]["crop_ok"]) == (None, 0.0, False)
    with pytest.raises(Exception, match="too few"):
        teams.colour_teams(spark.createDataFrame(rows[:1], "g string, id int, c array<double>"), "g", "id", "c").collect()


def test_strategies(spark):
    """All strategies have one form and are called by name; an unknown name is an error."""
    rows = [("a", i, [200.0 + i % 5, 190.0, 180.0] if i % 3 == 0 else [40.0, 30.0, 120.0 + i % 4]) for i in range(30)] + [("a", 99, None)]
    crops = spark.createDataFrame(rows, "g string, id int, c array<double>")
    for name in ("colour", "embedding"):
        got = {r["id"]: r for r in teams.assign_teams(name, crops, "g", "id", "c").collect()}
        assert len(got) == 31 and not got[99]["crop_ok"] and got[99]["predicted_team"] is None
        assert len({got[i]["predicted_team"] for i in range(0, 30, 3)}) == len({got[i]["predicted_team"] for i in range(1, 30, 3)}) == 1
        assert got[0]["predicted_team"] != got[1]["predicted_team"]
    with pytest.raises(ValueError, match="no strategy 'colours'; there are colour, embedding"):
        teams.assign_teams("colours", crops, "g", "id", "c")


def test_missing_crops(spark):
    got = spark.createDataFrame([(None, 0, 0), (bytearray(), 0, 0), (bytearray([9] * 12), 2, 2)], "p binary, h int, w int").select(pixels.crop_colours(F.col("p"), F.col("h"), F.col("w"), 40).alias("c")).select("c.*").collect()
    assert [(r["border"], r["n_foreground"], r["colour"]) for r in got] == [(None, None, None)] * 2 + [([9.0] * 3, 0, None)]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="margin"):
        files.need(spark.range(1), "id", "margin")


def test_all_gates_in_one_fold(spark):
    rng = random.Random(5)
    rows = [(c, f, rng.random() * 300, rng.random() * 300, 0.9) for c in range(3) for f in sorted(rng.sample(range(200), 60))]
    ball = spark.createDataFrame(rows, "clip_no int, frame_idx int, cx double, cy double, confidence double")
    every = gates.traces(ball).orderBy("gate", "clip_no", "frame_idx").drop("gate").collect()
    one = [r for kind in sorted(gates.KEPT) for r in gates.trace(ball, kind).orderBy("clip_no", "frame_idx").collect()]
    assert every == one


def test_votes(spark):
    raw = spark.createDataFrame([(0, i, 1, t, c, ok) for i, (t, c, ok) in enumerate([(1, 0.5, True), (2, 0.5, True), (2, 0.9, False)])],
                                "clip_no int, frame_idx int, player_id int, predicted_team int, confidence double, crop_ok boolean")
    assert [r["voted_team"] for r in teams.vote(raw, 5).orderBy("frame_idx").collect()] == [1, 1, 1]


def test_vote_against_loop(spark):
    rng = random.Random(5)
    rows = [(0, f, p, rng.choice((1, 2)), rng.randrange(50, 100) / 100, rng.random() > 0.1) for p in (1, 2) for f in sorted(rng.sample(range(80), 40))]
    raw = spark.createDataFrame(rows, "clip_no int, frame_idx int, player_id int, predicted_team int, confidence double, crop_ok boolean")
    for w in (1, 2, 5, 9):
        got = {(r["player_id"], r["frame_idx"]): r["voted_team"] for r in teams.vote(raw, w).collect()}
        for p in (1, 2):
            own = [r for r in rows if r[2] == p]
            for i, r in enumerate(own):
                near = own[max(0, i - w // 2) : i + (w - 1) // 2 + 1]
                side = lambda t: sum(x[4] for x in near if x[3] == t and x[5])  # noqa: B023, E731
                assert got[p, r[1]] == (1 if round(side(1) - side(2), 6) >= 0 else 2)


def test_binomial(spark):
    p = spark.createDataFrame([(1, 9), (0, 0), (5, 5)], "b int, c int").select(teams.binomial_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert [round(r["p"], 6) for r in p] == [round(22 / 1024, 6), 1, 1]


def test_mot_files(spark, tmp_path):
    boxes = spark.createDataFrame([(0, 7, 1.5, 2.0, 11.5, 22.0), (9, 8, 0.0, 0.0, 5.0, 5.0)], "frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    files.write_mot(boxes, str(tmp_path / "gt"))
    back = files.read_mot(spark, str(tmp_path / "gt"))
    assert sorted(back.collect()) == sorted(boxes.collect())
    for i, bad in enumerate(("1,2,3", "0,1,1,1,5,5,1,-1,-1,-1", "1,1,1,1,0,5,1,-1,-1,-1", "1,x,1,1,5,5,1,-1,-1,-1")):
        (tmp_path / f"bad{i}.txt").write_text(bad + "\n\n")
        with pytest.raises(Exception, match="malformed"):
            files.read_mot(spark, str(tmp_path / f"bad{i}.txt")).collect()


def test_detection_labels(spark):
    rows = spark.createDataFrame([("0 0.5 0.5 0.1 0.1\n\n 1 .25 0 1 1 ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(files.detect_text(files.detect_boxes(F.col("t")))).collect()] == ["0 0.500000 0.500000 0.100000 0.100000\n1 0.250000 0.000000 1.000000 1.000000", "", None]
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("0 1 2",)], "t string").select(files.detect_boxes(F.col("t"))).collect()


def test_result_files(spark, tmp_path):
    a = spark.createDataFrame([(" x ", 1)], "name string, n int")
    assert files.stripped(a.toDF(" name ", "n")).collect() == [("x", 1)]
    both = files.union_rows([a, spark.createDataFrame([(2, 0.5)], "n int, share double")])
    assert both.columns == ["name", "n", "share"]
    assert sorted(both.collect(), key=lambda r: r["n"]) == [(" x ", 1, None), (None, 2, 0.5)]
    assert files.union_rows([]) is None
    assert not files.write_result(a.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert files.write_result(a, str(tmp_path / "some"))
    assert spark.read.csv(str(tmp_path / "some"), header=True).count() == 1


def test_images(spark, tmp_path):
    for name in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / "images").mkdir(exist_ok=True)
        (tmp_path / "images" / name).write_bytes(b"12345")
    got = files.image_files(spark, str(tmp_path)).select("path", "label_path", "n_bytes").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["a.jpg", "b.png"]
    assert got[0]["label_path"].endswith("/labels/a.txt")
    assert got[0]["n_bytes"] == 5


def test_label_store(spark, tmp_path):
    path = str(tmp_path / "labels")
    one = spark.createDataFrame([("a", 1, "3", "t"), ("a", 2, "nobody", "t"), ("a", 1, "4", "u")], files.POSSESSION_LABEL).coalesce(1)
    ok = F.col("holder").rlike("^([0-9]+|nobody|unclear)$")
    files.append_labels(one, path, ok)
    rows = files.read_labels(spark, path, files.POSSESSION_LABEL, ["clip", "frame_idx"])
    assert {(r["frame_idx"], r["holder"]) for r in rows.collect()} == {(1, "4"), (2, "nobody")}
    with pytest.raises(ValueError, match="domain"):
        files.append_labels(spark.createDataFrame([("a", 3, "maybe", "t")], files.POSSESSION_LABEL), path, ok)


def test_stored_stage(spark, tmp_path, caplog):
    path, made = str(tmp_path / "stage"), []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 2.0)], "a int, b double")

    mark = store.fingerprint("ball", {"conf": 0.3}, {"player": "x"})
    for _ in range(2):
        assert store.stage(spark, path, mark, "a int, b double", make).count() == 1
    assert len(made) == 1
    store.stage(spark, path, store.fingerprint("ball", {"conf": 0.4}, {"player": "x"}), "a int, b double", make)
    assert len(made) == 2
    assert "conf" in caplog.text
    with pytest.raises(TypeError):
        store.load(spark, path, store.fingerprint("ball", {"conf": 0.4}, {"player": "x"}), "a int, c double")


def test_settings(spark):
    clips = frames(spark, 2)
    good = store.clip_settings(clips, {"gap": 5.0}, spark.createDataFrame([(0, "gap", 9.0)], "clip_no int, key string, value double"))
    assert [r["value"] for r in good.collect()] == [9.0]
    with pytest.raises(Exception, match="unknown setting"):
        store.clip_settings(clips, {"gap": 5.0}, spark.createDataFrame([(0, "gup", 9.0)], "clip_no int, key string, value double")).collect()


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert store.data_digest(a).first() == store.data_digest(a.orderBy(F.col("a").desc())).first()
    assert store.data_digest(a).first() != store.data_digest(a.where("a = 1")).first()


def test_scene(spark):
    sf = "/root/testdata/sf0.001"
    assert scene.frames(spark, sf).count() == 1000
    assert scene.ball(spark, sf).count() == 799
    assert scene.players(spark, sf).count() == 9091
