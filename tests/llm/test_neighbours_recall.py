"""Recall of the hash-prefix forest on full shards, over several shards and blocks of queries, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from frameflow.llm import neighbours


def made(kind, n):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 32))
    if kind == "clusters":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + 0.3 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(found, x, queries):
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & {r.vec_id for r in found[q]})
    return hits / (10 * len(queries))


@pytest.mark.parametrize(("kind", "rows", "share"), [("clusters", 3_000, 0.2), ("random", 3_000, 0.58), ("random", 8_192, 0.58)])
def test_recall_over_shards_and_blocks(spark, kind, rows, share):
    """Three shards and more, two blocks of queries, names that clash; the share of rows is what bounds the candidates."""
    n = 9_000 if rows < 8_192 else 8_192
    x = made(kind, n)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "'x' as v", "2 as ids", "3 as score", "4 as rank", "5 as query_id").repartition(4)
    found: dict = {}
    for r in neighbours.nearest(table, every=150, shard_rows=rows, enough=100, block=40, share=share).collect():
        found.setdefault(r["query_id"], []).append(r)
    queries = list(range(0, n, 150))
    assert sorted(found) == queries
    assert all([r["rank"] for r in sorted(rs, key=lambda r: r["rank"])] == list(range(1, 11)) for rs in found.values())
    assert recall(found, x, queries) >= 0.9
    for q in queries[:5]:
        for r in found[q]:
            assert r["score"] == pytest.approx(float(np.sqrt(((x[r["vec_id"]] - x[q]) ** 2).sum())), rel=1e-12)


def test_clusters_compare_a_part_of_the_rows():
    """With clusters, a fifth of the rows is enough for nearly all neighbours."""
    x = made("clusters", 6_000)
    planes = neighbours.Planes(x[::3])
    labels = planes.labels(x)
    order = np.argsort(labels, axis=0, kind="stable")
    placed, asked = np.take_along_axis(labels, order, axis=0), list(range(0, 6_000, 100))
    sets = list(neighbours.candidates(placed.T.copy(), order.T.astype(np.int32).copy(), labels[asked], neighbours.LENGTH, int(0.2 * 6_000)))
    share = sum(map(len, sets)) / (6_000 * len(asked))
    d = [((x - x[q]) ** 2).sum(1).argsort()[1:11] for q in asked]
    assert share < 0.3
    assert np.mean([np.isin(t, s).mean() for t, s in zip(d, sets, strict=True)]) >= 0.95
