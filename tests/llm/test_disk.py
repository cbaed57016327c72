"""What the pipeline's stages leave on disk and send more than once."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipe
from frameflow.llm import common, decontaminate, simhash
from frameflow.sources import store

SF = "/root/testdata/sf0.01"


def blocks(spark) -> int:
    """Shuffle files of this process."""
    return str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()).count("shuffle_")


def test_shuffles_of_a_stored_table_are_deleted(spark):
    before = blocks(spark)
    kept = common.stored(spark.range(1000).selectExpr("id % 7 as k").repartition(4).groupBy("k").count(), "counts")
    assert blocks(spark) <= before
    assert kept.count() == 7
    assert spark.conf.get(common.TIDY) == "false"


def test_only_shingles_of_near_copies_are_stored(spark, monkeypatch):
    tables, sizes, real, own = [], [], simhash.stored, simhash.members
    monkeypatch.setattr(simhash, "stored", lambda df, *a, **k: tables.append(df.columns) or real(df, *a, **k))
    monkeypatch.setattr(simhash, "members", lambda *a: sizes.append(own(*a).count()) or own(*a))
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(50)] + [None, ""]
    texts.append(texts[3] + " more")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sizes == [2]
    assert [t for t in tables if "shingles" in t] == [["node", "root", "key", "shingles"]]
    assert {d: c for d, c in got.items() if d != c} == {51: 50, 52: 3}


def test_a_pair_is_sent_from_one_shard():
    rng = np.random.default_rng(1)
    cuts = simhash.cuts_of(4, 30, 8)
    masks = np.array([[sum(1 << (c - 64 * w) for c in cut if c // 64 == w) for w in range(4)] for cut in cuts], np.uint64)
    a = rng.integers(0, 2**63, (200, 4), dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in rng.choice(256, 40, replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    met = np.array([((a ^ b) & m == 0).all(1) for m in masks])
    sent = sum(simhash.first_met(a[met[k]], b[met[k]], np.full(met[k].sum(), k), masks).sum() for k in range(30))
    assert sent == met.any(0).sum() < met.sum()


def test_clean_texts_are_not_shuffled_and_no_index_is_left(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(decontaminate, "stored", lambda df, *a, **k: tables.append(common.stored(df, *a, **k)) or tables[-1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = pipe.drop_contaminated(spark, docs, SF)
    assert not [t for t in tables if store.exists(spark, t._stored_path)]
    kept = {r["doc_id"] for r in left.select("doc_id").collect()}
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    bad = {r["doc_id"] for r in found.where("size(spans) > 0").collect()}
    assert bad and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
    assert "Union" in left._jdf.queryExecution().optimizedPlan().toString()


def test_short_lists_are_read_as_they_were():
    """Any sorted positions, and a third of the bytes of four for each."""
    rng = np.random.default_rng(2)
    lists = [np.array([0]), np.array([127, 128]), np.array([2**21 - 1, 2**21, 2**28, 2**32 - 1]), *(np.unique(rng.integers(0, 2_000_000, n)) for n in rng.integers(1, 3000, 200))]
    gaps = [np.diff(x, prepend=0).astype(np.uint32) for x in lists]
    packed, ends = decontaminate.short(np.concatenate(gaps))
    cuts = np.r_[0, ends[np.cumsum([len(x) for x in gaps]) - 1]]
    got = decontaminate.positions([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    assert all(np.array_equal(a, b) for a, b in zip(got, lists, strict=True)) and len(packed) < 2 * ends.size
    assert decontaminate.positions([]) == []


def test_the_stored_index_is_brief(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(decontaminate, "stored", lambda df, *a, **k: sizes.append(df.selectExpr("sum(length(gaps))").first()[0]) or common.stored(df, *a, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sizes[0] < 0.6 * decontaminate.build_index(docs).selectExpr("sum(length(gaps))").first()[0]


def test_samples_of_bits_are_shuffled_in_lots(spark, monkeypatch):
    """No shuffle holds a node more than LOT times, and the links are those of all samples at once."""
    nodes = spark.createDataFrame([(bytes(np.random.default_rng(i // 3).integers(0, 256, 32, dtype=np.uint8)[:-1]) + bytes([i % 3]), i) for i in range(300)], "fp binary, id long")
    pairs = lambda: {(r["a"]["id"], r["b"]["id"]) for r in simhash.links(nodes, 54, 4, 30, 8).collect()}
    lots, real = [], simhash.sample_shards
    monkeypatch.setattr(simhash, "sample_shards", lambda *a: lots.append(real(*a).count()) or real(*a))
    some = pairs()
    assert max(lots) <= simhash.LOT * 300 and sum(lots) == 30 * 300
    monkeypatch.setattr(simhash, "LOT", 100)
    assert some == pairs() and len(some) >= 200
