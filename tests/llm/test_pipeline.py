"""The stages of the corpus pipeline, each against brute force on its own input, and the whole of it."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from frameflow.llm import decontaminate, simhash
from tests.llm.test_ops import DOCS, LOWER, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_in_order():
    assert [f for _, f in pipe.STAGES] == [pipe.identify_language, pipe.drop_near_duplicates, pipe.drop_contaminated, pipe.mask_secrets, pipe.pack_sequences]
    assert pipe.ORACLE_SQL is None


def test_language_keeps_clean_documents(spark, documents):
    more = documents.unionByName(spark.createDataFrame([(-1, "12345 !!!", "en", "s", 9), (-2, None, "en", "s", 0)], DOCS))
    kept = pipe.identify_language(spark, more, SF)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in documents.collect()}


def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    return len(a & b) / max(1, len(a | b))


def test_near_duplicates(spark, documents):
    extra = spark.createDataFrame([(None, "no id at all", "en", "s", 0)], DOCS)
    kept = pipe.drop_near_duplicates(spark, documents.unionByName(extra), SF).collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in documents.collect()}
    left = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(left) == len(set(left)) == len(kept) - 1
    assert not [(a, b) for i, a in enumerate(left) for b in left[:i] if likeness(sets[a], sets[b]) >= 0.8]
    for gone in sets.keys() - set(left):
        assert max(likeness(sets[gone], s) for d, s in sets.items() if d != gone) >= 0.8


def test_near_duplicates_against_all_pairs(spark):
    """6,000 documents: no one goes without a partner of 0.8, and hardly any link of 0.8 is lost."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    sets = {r["doc_id"]: frozenset(shingles(r["text"])) for r in rows.select("doc_id", "text").collect()}
    holders, pairs = {}, set()
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    counts = {}
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                counts[a, b] = counts.get((a, b), 0) + 1
    pairs = {p for p, n in counts.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}
    own = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(rows).collect()}
    partnered = {d for p in pairs for d in p}
    assert {d for d, c in own.items() if d != c} <= partnered
    different = [p for p in pairs if sets[p[0]] != sets[p[1]]]
    assert sum(own[a] == own[b] for a, b in pairs - set(different)) == len(pairs) - len(different)
    assert len(different) > 50
    assert sum(own[a] == own[b] for a, b in different) >= 0.98 * len(different)


def test_near_copies_of_every_kind(spark):
    """Copies with one word in thirty changed, from a dozen to hundreds of words, and a large group of them."""
    import random

    rng = random.Random(2)
    rows, base = [], 0
    for size in (40, 80, 200, 600):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for copy in range(12):
            own = list(words)
            for k in rng.sample(range(size), size // 60 if copy else 0):
                own[k] = f"x{rng.randrange(5000)}"
            rows.append((base + copy, " ".join(own), "en", "s", 0))
        base += 100
    kept = {r["doc_id"] for r in pipe.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert {0, 100, 200, 300} <= kept
    assert len(kept) <= 6


def test_dense_group_of_looser_copies(spark):
    """Hundreds of texts that are like one of them but not like each other, and texts that only a chain links."""
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(300):
        own = list(base)
        for k in rng.sample(range(0, 300, 12), 6):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    chain = [" ".join(f"c{k}" for k in range(i * 12, i * 12 + 200)) for i in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, *chain, " ".join(base)])]
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if likeness(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    own = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    wrong = [i for i in own if own[i] != top(i)]
    assert len(wrong) <= 0.01 * len(own)


def test_stages_with_clashing_columns(spark, documents):
    more = documents.where("doc_id < 40").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as _key", "3 as key", "4 as found", "5 as fp", "6 as of", "7 as n", "8 as component_id", "9 as c0", "10 as words")
    for _, stage in pipe.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns
        assert out.count() > 0
    assert pipe.pack_sequences(spark, more, SF).count() >= 40


def test_near_copies_with_repeated_lines(spark):
    """A line repeated once or a hundred times: nearly the same shingle set."""
    base, line = " ".join(f"b{k}" for k in range(200)), " ".join(f"r{k}" for k in range(12))
    texts = [" ".join([base] + [line] * n) for n in (1, 100, 30)]
    assert all(likeness(shingles(texts[0]), shingles(t)) > 0.95 for t in texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert [r["doc_id"] for r in pipe.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()] == [0]


def test_contaminated(spark, documents):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = documents.where("doc_id < 60").unionByName(spark.createDataFrame([(None, bench[0][1], "en", "s", 0), (None, "clean", "en", "s", 0)], DOCS))
    kept = pipe.drop_contaminated(spark, some, SF)
    wanted = sorted(str(r["doc_id"]) for r in some.collect() if not brute_hits(r["text"], bench)[1])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == wanted
    assert kept.columns == documents.columns


def test_secrets_masked(spark, documents):
    out = pipe.mask_secrets(spark, documents, SF)
    assert out.columns == documents.columns
    both = out.select("doc_id", F.col("text").alias("new")).join(documents, "doc_id").collect()
    assert len(both) == documents.count()
    for r in both:
        assert not re.search(r'\bAKIA[A-Z0-9]{16}\b|\btoken = "[0-9a-f]{40}"|\bpassword=[0-9a-f]{18}\b', r["new"])
        if not re.search(r"[A-Za-z0-9]{16}|=", r["text"]):
            assert r["new"] == r["text"]


def test_whole_pipeline(spark, documents):
    out = pipe.run(spark, SF)
    rows = out.toPandas()
    assert len(rows)
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert set(rows["doc_id"]) <= {r["doc_id"] for r in documents.collect()}
    assert decontaminate.WINDOW == 10


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    for _, stage in pipe.STAGES:
        assert stage(spark, none, SF).count() == 0
