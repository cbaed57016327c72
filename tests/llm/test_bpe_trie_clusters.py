"""Encoding, the prefix trie and ball k-means against the library, brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameflow.llm import bpe, clusters, queries, trie
from frameflow.llm.packing import encoder
from tests.llm.test_ops import N_ODD, docs, odd
from tests.oracle import same

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- 11 -------------------------------------------------------------------------------------------------------------
def library(text):
    coder = Tokenizer.from_file(VOCABULARY) if not hasattr(library, "coder") else library.coder
    library.coder = coder
    ids = coder.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), coder.decode(ids, skip_special_tokens=False)


def awkward(n):
    rnd = random.Random(3)
    parts = ["a", "b", "'", "re", "ve", " ", "  ", "\n", "1", "é", "漢", "\U0001f600", ".", "s", "t", "<|endoftext|>", "<|end", "\u0000"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.choice([3, 60, 700]))) for _ in range(n)] + ["a" * 9_000, " " * 5_000, "x'" * 3_000, "\n \n" * 2_000, "'re" * 2_000, "<|endoftext|>" * 30]


@pytest.mark.parametrize("sizes", [(8, 128, 2_048), (2, 1, 7), (1, 1, 3), (0, 1, 1)])
def test_joins_are_repaired(monkeypatch, sizes):
    """Whatever the cut, ids are the library's: cuts of one to seven characters fall into words, contractions, runs of space and added tokens."""
    for name, v in zip(("BITS", "SHORTEST", "LONGEST"), sizes, strict=True):
        monkeypatch.setattr(bpe, name, v)
    coder = bpe.Coder(encoder(VOCABULARY), {})
    for text in awkward(150 if sizes[0] else 20):
        ids = coder.encode(text)
        n, wanted, plain = library(text)
        assert ids == wanted
        assert bpe.decode_ids(VOCABULARY, ids) == plain


def test_chunks_follow_content():
    rnd = random.Random(5)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    common = line(3_000)
    a, b = [list(bpe.chunk_texts(encoder(VOCABULARY), line(k) + " " + common)) for k in (500, 731)]
    assert len(set(a) & set(b)) > 0.9 * len(list(bpe.chunk_texts(encoder(VOCABULARY), common)))
    assert "".join(a).endswith(common)
    assert max(map(len, a)) <= bpe.LONGEST


def test_shared_chunks_are_encoded_once(spark):
    common = " ".join(f"word{i} and{i % 7}" for i in range(2_000))
    table = docs(spark, [f"start {i} " + common for i in range(12)] + ["own text"])
    shared = bpe.shared_chunks(table, VOCABULARY)
    assert sum(map(len, shared)) > 0.8 * len(common)
    assert len(bpe.shared_chunks(table, VOCABULARY, most=3)) == 3
    coder = bpe.Coder(encoder(VOCABULARY), shared)
    assert coder.encode("start 77 " + common) == library("start 77 " + common)[1]
    assert coder.encoded < 0.1 * coder.met
    for most in (0, 3, 8_192):
        got = bpe.encode(table, VOCABULARY, bpe.shared_chunks(table, VOCABULARY, most) if most else {}).collect()
        assert {r["doc_id"]: bytes(r["ids"]) for r in got} == {r["doc_id"]: library(r["text"])[1] for r in table.collect()}


def test_encode_odd_rows_and_other_files(spark):
    for rows in (odd(spark), odd(spark).limit(0)):
        got = bpe.decode(bpe.encode(rows, VOCABULARY), VOCABULARY).collect()
        wanted = sorted((r["doc_id"] or -1, *library(r["text"])) for r in rows.collect())
        assert sorted((r["doc_id"] or -1, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == wanted
    other = public_tokenizers.path("word_bpe_49k.json")
    text = bpe.decode(bpe.encode(docs(spark, ["Two Words", None]), other), other).orderBy("doc_id").collect()
    coder = Tokenizer.from_file(other)
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in text] == [coder.encode(t, add_special_tokens=False).ids for t in ("Two Words", "")]


def test_query_11(spark):
    got = {r["doc_id"]: r[1:] for r in queries.op11_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, ids, text = library(r["text"])
        assert got.pop(r["doc_id"]) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


# --- 12 -------------------------------------------------------------------------------------------------------------
SAID = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        inner = {v[:-1] for v in members if v}
        saved = sum((len(members[v]) - 1) * len(re.findall(trie.WORD, v[-1][1])) for v in below if v)
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(v) == len(node) + 1 for v in below), sum(v not in inner for v in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([*range(45), 10**12 + 3]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a b", "", None, " x\ty\n", "ä b c"])) for _ in range(150)]
    table = spark.createDataFrame(rows, SAID)
    assert found(trie.trie(table)) == brute_trie(rows)


def test_trie_of_equal_conversations(spark):
    """A group of copies that holds most rows, in one chunk of ids and in many."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(0, 9_000, 7) for t in range(3)] + [(c, 0, "user", "other") for c in range(20_000, 20_100)]
    table = spark.createDataFrame(rows, SAID)
    wanted = brute_trie(rows)
    assert found(trie.trie(table)) == wanted
    steps = trie.paths(trie.rebuilt(trie.turns(table)))
    small, large = [{(r["depth"], r["k1"], r["k2"], r["ends_sha256"]) for r in trie.ends(steps, n).collect()} for n in (16, 10**9)]
    assert small == large
    for salts in (1, 5, 5_000):
        assert sorted(r["n_convs"] for r in trie.nodes(trie.owned(steps, salts)).collect()) == sorted(x[3] for x in wanted)


def test_trie_of_odd_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, None, None), (1, 5, "u", "word " * 50_000), (None, 0, "u", "lost"), (2, 1, "a:b", "c"), (3, 1, "a", "b:c"), (40, 0, "u", "x")]
    table = spark.createDataFrame(rows, SAID)
    assert found(trie.trie(table)) == brute_trie(rows)
    clash = table.selectExpr("*", "1 as k", "'x' as digest", "2 as a", "3 as words", "4 as depth", "5 as part", "6 as owner")
    assert found(trie.trie(clash)) == brute_trie(rows)
    assert found(trie.trie(table.limit(0))) == []
    long = [(7, t, "user", f"t{t}") for t in range(2_500)]
    assert len(found(trie.trie(spark.createDataFrame(long, SAID)))) == 2_501 - zlib.crc32(b"7") % 4


def test_query_12(spark):
    same(queries.op12_prefix_trie(spark, SF).toPandas(), queries.oracle_sql()["op12_prefix_trie"], SF)


# --- 13 -------------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>"


def brute_means(rows, k, rounds, scale=64):
    """vec_id, cluster, distance of all rows, in Python's numbers."""
    kept = [(i, [int(np.floor(max(min(x * scale, 2.0**62), -(2.0**62)))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in set(own):
            members = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [(i, *near(q)[::-1]) for i, q in kept]
    return sorted(((i, j, min(d, 2**63 - 1)) for i, j, d in last), key=str)


def split(got):
    rows = got.collect()
    assert all(r["inertia"] == min(sum(x["distance"] for x in rows), 2**63 - 1) for r in rows)
    for r in rows:
        assert r["cluster_inertia"] == min(sum(x["distance"] for x in rows if x["cluster"] == r["cluster"]), 2**63 - 1)
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=str)


@pytest.mark.parametrize("spread", [0.02, 1.0, 40_000.0])
def test_ball_means_against_brute_force(spark, spread):
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(6, 5))
    rows = [(i, (middle[i % 6] + rnd.normal(size=5) * spread).tolist()) for i in range(240)] + [(900 + i, middle[0].tolist()) for i in range(90)]
    got = clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), clusters=9, rounds=4, length=5)
    assert split(got) == brute_means(rows, 9, 4)


def test_rings_compare_less_and_lose_nothing():
    rnd = np.random.default_rng(8)
    c = rnd.integers(-900, 900, (16, 8)).astype(float)
    v = (c[rnd.integers(0, 16, 4_000)] + rnd.integers(-60, 60, (4_000, 8))).astype(float)
    v[:500] = rnd.integers(-3, 4, (500, 8))
    near, far = clusters.first_assignment(v, c)
    again, d, compared = clusters.reassigned(v, rnd.integers(0, 16, 4_000), c)
    assert (again == near).all() and (d == far).all()
    again, d, compared = clusters.reassigned(v, near, c)
    assert (again == near).all() and (d == far).all()
    assert compared < 0.4 * v.shape[0] * 16


def test_ties_go_to_the_smaller_number():
    c = np.array([[4.0, 0], [-4, 0], [0, 4], [4, 0]])
    v = np.array([[0.0, 0], [4, 0], [0, 1], [-1, 1]])
    for own in ([3, 3, 3, 3], [2, 3, 1, 0], [1, 0, 0, 2]):
        assert clusters.reassigned(v, np.array(own), c)[0].tolist() == clusters.first_assignment(v, c)[0].tolist() == [0, 0, 2, 1]


def test_ball_means_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    sound = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [-0.01, 3.0]), (None, [9.0, 9.0]), (5, [3e38, -3e38]), (6, [2.0**33, 7.0]), (7, [2.0**33, 9.0])]
    rows = sound + [(8, None), (9, [1.0]), (10, [1.0, None]), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, [1.0, 2.0, 3.0]), (14, [])]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "3 as cluster", "'x' as q", "1 as distance", "2 as inertia")
    assert split(clusters.cluster(table, clusters=3, length=2)) == brute_means(sound, 3, 3)
    few = clusters.cluster(table.where("vec_id <= 2"), clusters=16, length=2)
    assert split(few) == brute_means(sound[:3], 16, 3)
    assert clusters.cluster(table.limit(0)).count() == 0
    floats = table.withColumn("embedding", F.col("embedding").cast("array<float>")).where("vec_id < 3")
    assert split(clusters.cluster(floats, clusters=2, length=2)) == brute_means([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in sound[:3]], 2, 3)


def test_query_13(spark):
    same(queries.op13_ball_kmeans(spark, SF).toPandas(), queries.oracle_sql()["op13_ball_kmeans"], SF)


def test_odd_rows_are_ten(spark):
    assert odd(spark).count() == N_ODD
