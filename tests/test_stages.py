"""The graph of stages runs what is stale and nothing else; seeded samples are those of a plain run."""

from __future__ import annotations

import random

import pytest

from frameflow.operators import sampling
from frameflow.sources import stages, store


def graph(spark, log, revision=1):
    def made(name):
        def make(settings, inputs):
            log.append((name, dict(settings), sorted(inputs)))
            rows = spark.createDataFrame([(name, sum(settings.values()))], "name string, n long")
            for other in inputs.values():
                rows = rows.unionByName(other)
            return rows
        return make

    s = lambda name, keys=(), after=(), revision=1: stages.Stage(name, "name string, n long", made(name), keys, after, revision)
    return stages.Graph([s("d", ("k",), ("b", "c")), s("a", ("x",)), s("b", ("y",), ("a",), revision), s("c", ("z", "x"), ("a",)), s("e", (), ("c",))])


def test_only_what_is_stale_runs(spark, tmp_path):
    log, root, base = [], str(tmp_path / "g"), {"x": 1, "y": 2, "z": 3, "k": 4, "unused": 5}
    g = graph(spark, log)
    ran = lambda settings, wanted=None, g=g: set(g.run(spark, root, settings, wanted)[1])
    assert g.stale(spark, root, base) == g.order
    assert ran(base, ["b"]) == {"a", "b"}
    assert ran(base) == {"c", "d", "e"}
    assert ran(base) == set() and g.stale(spark, root, base) == []
    assert ran(base | {"unused": 6}) == set()
    assert ran(base | {"k": 9}) == {"d"}
    assert ran(base | {"y": 9}) == {"b", "d"}
    assert ran(base | {"z": 9}) == {"c", "d", "e"}
    assert ran(base | {"x": 9}) == {"a", "b", "c", "d", "e"}
    assert ran(base) == set()  # the first results are still there
    assert ran(base, None, graph(spark, log, 2)) == {"b", "d"}
    assert ("c", {"z": 3, "x": 1}, ["a"]) in log and ("d", {"k": 4}, ["b", "c"]) in log
    rows = g.run(spark, root, base)[0]["d"].collect()
    assert sorted((r["name"], r["n"]) for r in rows) == [("a", 1), ("a", 1), ("b", 2), ("c", 4), ("d", 4)]


def test_stages_run_after_what_they_read(spark):
    g = graph(spark, [])
    assert all(g.order.index(a) < g.order.index(s) for s in g.stages for a in g.stages[s].after)
    assert g.needed(["e"]) == [n for n in g.order if n in ("a", "c", "e")]


def test_wrong_graphs_and_settings(spark, tmp_path):
    s = lambda name, after=(), keys=(): stages.Stage(name, "n long", lambda *_: None, keys, after)
    with pytest.raises(ValueError, match="circle"):
        stages.Graph([s("a", ("b",)), s("b", ("a",))])
    with pytest.raises(ValueError, match="b reads c"):
        stages.Graph([s("b", ("c",))])
    with pytest.raises(ValueError, match="one name"):
        stages.Graph([s("b"), s("b")])
    with pytest.raises(ValueError, match="stage b needs hold, reach"):
        stages.Graph([s("b", (), ("hold", "fps", "reach"))]).run(spark, str(tmp_path), {"hold": None, "fps": 0})
    with pytest.raises(ValueError, match="no such stage: z"):
        stages.Graph([s("b")]).needed(["z"])


def test_a_result_of_another_kind_is_an_error(spark, tmp_path):
    g = stages.Graph([stages.Stage("a", "n long", lambda *_: spark.createDataFrame([("x",)], "n string"))])
    with pytest.raises(TypeError, match="columns"):
        g.run(spark, str(tmp_path), {})


def test_seeded_sample_is_a_plain_run(spark):
    rows = [(c, v) for c in ("clip_1", "clip_2", "short") for v in range(3 if c == "short" else 90) if v % 7] * 2 + [("clip_1", None)]
    got = sampling.seeded(spark.createDataFrame(rows, "clip string, frame int").repartition(5), "clip", "frame", 20, 11).collect()
    wanted = []
    for c in sorted({c for c, _ in rows}):
        every = sorted({v for k, v in rows if k == c and v is not None})
        wanted += [(c, v) for v in sorted(random.Random(f"11:{c}").sample(every, min(20, len(every))))]
    assert sorted(map(tuple, got)) == wanted
    assert {tuple(r) for r in sampling.seeded(spark.createDataFrame(rows, "clip string, frame int"), "clip", "frame", 20, 12).collect()} != set(wanted)


def test_stored_stages_can_be_cleared(spark):
    path = store.workplace(spark, "gone")
    spark.range(3).write.parquet(path)
    assert store.exists(spark, path)
    other = path.replace("frameflow-scene-", "frameflow-")
    spark.range(3).write.parquet(other)
    store.clear(spark)
    assert not store.exists(spark, path) and store.exists(spark, other)
