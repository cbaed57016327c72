"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: one bit for each bit position, set where over half of a text's shingle hashes (XXH64, seed 42) have it set.
Equal fingerprints are one node. Two fingerprints of 64 bits within r bits agree on all but r of any k parts, so every
choice of k-r parts gives shards, each with the fingerprints that agree there; two that are within r bits meet in
a shard. With r=2 and the 8 bytes as parts a shard holds at most 65,536 fingerprints, whatever the input, as only two bytes are free.
Each shard has a BK-tree: a child hangs under its parent by the integer Hamming distance, and a search follows only the
edges within r of the distance to the parent. A shard's tree is built where its rows are and serves all of the shard's queries
at once (a broadcast within the shard: fingerprints of all documents in one place would not be bounded). A shard gives a spanning
forest of its links instead of all pairs, so that no link between components is lost and no group emits its square.
Components come from alternating large and small stars over those links.

near_groups() is for looser copies, by the share of word shingles in common. Its fingerprints are longer (several words of 64 bits, over distinct shingles) and only propose:
shards are equal samples of bits, as long as the table is large and as many as the wanted recall takes; fingerprints within the radius
make coarse groups. In each of these all members are compared exactly with the one that shares most of its shingles with others. A member that is not like that one, and has enough shingles
in common with any others to be like one of them at all, looks for its partners within the radius (again only those with enough of such shingles), and each such pair
is compared exactly too. Only exact links make groups, so a document without a partner of that likeness is never in one.

Defined results: null and blank texts have fingerprint zero and are linked like any other; fewer words than a shingle make
one shingle of them all; rows with equal ids stay rows of their own; null ids are ignored when the smallest id is taken (a
component of null ids only has none); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import TO_LOWER, forget, map_rows, stored, temporary

SEED = 42
RADIUS = 2
BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: Hashes whose bits are counted at a time.
PART = 100_000
#: Frontier entries (query, tree node) followed at a time.
FRONTIER = 2_000_000
#: Rows with fingerprints read at a time from a task's input.
HELD = 400_000
#: Trees of so many rows hang from the row nearest to their middle.
LARGE = 1_000
#: Fingerprints whose shingles a task of sketches() has sent already.
KEPT = 200_000
#: near_groups() looks again for the texts of groups by the slot of their hash: so many slots at most are sent to all tasks.
SLOTS = 2**22
#: Samples of bits whose shards are shuffled at once; more of them go one lot after the other, so that the disk that they take does not grow with their number.
LOT = 12
#: Stands for a null id in nodes, behind all others.
LAST = 2**63 - 1
#: near_groups(): share of distinct shingles in common, words of a shingle, fingerprint words, radius in bits, the share of pairs at that likeness that no
#: sample of bits may bring together, and fingerprints of an average shard.
SIMILARITY, SHINGLE, WORDS, NEAR, MISSED, SHARD = 0.8, 5, 4, 54, 0.01, 32


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    parts = BLANK.split(text.translate(TO_LOWER).strip("\x20\x09\x0a\x0b\x0c\x0d")) if text else []
    if parts and not parts[0]:
        parts = []
    h, n = xxhash.xxh64_intdigest, max(1, len(parts) - words + 1) if parts else 0
    for a in range(0, n, PART):
        yield np.array([h(" ".join(parts[i : i + words]), SEED) for i in range(a, min(a + PART, n))], np.uint64)


def fold(parts: Iterator[np.ndarray], words: int) -> bytes:
    """The bits that are set in over half the hashes. The words after the first count bits of hashes mixed anew."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in parts:
        n += len(h)
        for w in range(words):
            x = h
            if w:
                x = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + w * 0x3C6EF372FE94F82A) % 2**64 | 1)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ones[64 * w : 64 * w + 64] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """A signed number of 64 bits over all shingles, repeats included."""
    return int.from_bytes(fold(shingle_hashes(text, shingle_words), 1), "little", signed=True)


def sketch(text: str | None, shingle_words: int = SHINGLE, words: int = WORDS) -> tuple[bytes, np.ndarray]:
    """words x 8 bytes over the distinct shingles, and these."""
    held = list(shingle_hashes(text, shingle_words))
    distinct = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
    return fold((distinct[a : a + PART] for a in range(0, len(distinct), PART)), words), distinct.view(np.int64)


def fp_type(words: int):
    return LongType() if words == 1 else BinaryType()


def as_words(fps: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    """Row x word of 64 bits."""
    return fps.to_numpy().view(np.uint64).reshape(-1, 1) if words == 1 else np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(-1, words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])
    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), lambda: lambda i, t: [(i, fingerprint(t, shingle_words))], schema)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """doc_id, fp and the distinct shingles; a task sends the shingles of a fingerprint once (null after that), so that many copies of one text stay small."""
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", BinaryType()), StructField("shingles", ArrayType(LongType()))])

    def make():
        seen: set[bytes] = set()

        def one(doc_id, text):
            fp, distinct = sketch(text, shingle_words, words)
            new = fp not in seen
            if len(seen) >= KEPT:
                seen.clear()
            seen.add(fp)
            return [(doc_id, fp, distinct if new else None)]

        return one

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), make, schema)


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the slot of the text's hash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(SLOTS)).cast("int").alias("slot"))


def prints_of(docs: DataFrame, shingle_words: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """doc_id, fp of sketches() and slot for every row; the shingles stay in the task."""
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", BinaryType()), StructField("slot", IntegerType())])
    return map_rows(slotted(docs), lambda: lambda i, t, slot: [(i, sketch(t, shingle_words, words)[0], slot)], schema)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """BK-trees over the rows of `points`, one for each value of `tree`; rows of a tree are distinct and stand together."""

    def __init__(self, points: np.ndarray, tree: np.ndarray):
        n = len(points)
        self.points, self.tree = points, tree
        self.root = np.maximum.accumulate(np.where(np.r_[True, tree[1:] != tree[:-1]], np.arange(n), 0))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        left = np.flatnonzero(self.root != np.arange(n))
        at = self.root[left]
        while len(left):  # all rows of a level at once: the first of each (node, distance) becomes that child
            d = distance(points[left], points[at])
            order = np.lexsort((left, d, at))
            left, at, d = left[order], at[order], d[order]
            first = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
            head = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            parent[left[first]], edge[left[first]] = at[first], d[first]
            left, at = left[~first], head[~first]
        has = np.flatnonzero(parent >= 0)
        order = np.lexsort((edge[has], parent[has]))
        self.child, self.edge = has[order], edge[has][order]
        of = parent[has][order]
        self.begin, self.end = np.searchsorted(of, np.arange(n), "left"), np.searchsorted(of, np.arange(n), "right")

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, tree row) of all pairs within the radius; each query searches its own row's tree."""
        stack = [(queries[a : a + FRONTIER // 8], self.root[queries[a : a + FRONTIER // 8]]) for a in range(0, len(queries), FRONTIER // 8)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            d = distance(self.points[q], self.points[node])
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            b, e = self.begin[node], self.end[node]
            n = e - b
            some = n > 0
            q, d, b, n = q[some], d[some], b[some], n[some]
            if not len(q):
                continue
            at = np.repeat(b - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            near = np.abs(self.edge[at] - d) <= radius
            if near.any():
                stack.append((q[near], self.child[at[near]]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row is linked with, over any number of links."""
    up = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = up[a], up[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                break
            np.minimum.at(up, high, low)
            while True:
                new = up[up]
                if (new == up).all():
                    break
                up = new
    return up


def shared(tree: np.ndarray) -> np.ndarray:
    """Rows of trees of more than one."""
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]), len(tree)])
    return np.flatnonzero(np.repeat(size, size) > 1)


def from_middle(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """An order of the rows in which large trees begin with the row nearest to their middle (the bits that most of them have)."""
    order = np.arange(len(tree))
    heads = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    ends = np.r_[heads[1:], len(tree)]
    for a, b in zip(heads[ends - heads >= LARGE], ends[ends - heads >= LARGE], strict=True):
        ones = np.zeros(64 * points.shape[1], np.int64)
        for c in range(a, b, PART):
            part = points[c : min(b, c + PART)]
            ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
        middle = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)
        j = a + int(np.argmin(distance(points[a:b], middle[None])))
        order[a], order[j] = j, a
    return order


def shard_links(points: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and rows they are linked to: a spanning forest of all links within the radius. What is within the radius of a tree's root is linked by
    that; only the other rows search, so that a dense group costs its number of rows and not the square of it."""
    keep = shared(tree)
    if not len(keep):
        return keep, keep
    keep = keep[from_middle(points[keep], tree[keep])]
    p = points[keep]
    forest = Forest(p, tree[keep])
    near = distance(p, p[forest.root]) <= radius
    close = np.flatnonzero(near)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield close, forest.root[close]
        yield from forest.within(np.flatnonzero(~near), radius)

    up = roots(len(keep), pairs())
    moved = np.flatnonzero(up != np.arange(len(keep)))
    return keep[moved], keep[up[moved]]


def shard_pairs(points: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int, size: np.ndarray, common: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius of which the first one asks, but for those that can't be alike: each has `common` of its `size` shingles in common with any others."""
    keep = shared(tree)
    if len(keep):
        for a, b in Forest(points[keep], tree[keep]).within(np.flatnonzero(ask[keep]), radius):
            a, b = keep[a], keep[b]
            may = np.minimum(common[a], common[b]) >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6
            yield a[may], b[may]


def byte_shards(fp, parts: int = 8, radius: int = RADIUS):
    """For each choice of `radius` free bytes, the fingerprint with those bytes zero."""
    masks = []
    for free in combinations(range(parts), radius):
        m = (1 << 64) - 1
        for b in free:
            m &= ~(0xFF << (8 * b))
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks]))


def cuts_of(words: int, samples: int, sample_bits: int) -> list[list[int]]:
    """The bits of each sample."""
    rng = np.random.default_rng(5)
    return [rng.choice(64 * words, sample_bits, replace=False).tolist() for _ in range(samples)]


def first_met(a: np.ndarray, b: np.ndarray, no: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether sample `no` is the first in which rows a and b agree, so that a pair is sent from one shard only."""
    differ, new = a ^ b, np.ones(len(no), bool)
    for k, mask in enumerate(masks[: int(no.max(initial=0))]):
        new &= (no <= k) | (differ & mask).any(1)
    return new


def sample_shards(nodes: DataFrame, words: int, samples: int, sample_bits: int, lot: range | None = None) -> DataFrame:
    """Each node once for each sample of bits, or each of a lot of them, with the bits as its shard."""
    cuts = cuts_of(words, samples, sample_bits)
    lot = range(samples) if lot is None else lot
    keyed = StructType([*nodes.schema.fields, StructField("no", IntegerType()), StructField("shard", LongType())])
    arrow, at = to_arrow_schema(keyed), nodes.columns.index("fp")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(sample_bits, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(at).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                for k in lot:
                    own = [*part.columns, pa.array(np.full(part.num_rows, k)), pa.array((bits[:, cuts[k]] * weight).sum(1))]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own, arrow, strict=True)], schema=arrow)

    return nodes.mapInArrow(deal, keyed)


def links(nodes: DataFrame, radius: int = RADIUS, words: int = 1, samples: int = 0, sample_bits: int = 16, similarity: float | None = None) -> DataFrame:
    """(a, b), each a struct of id and fp: links of nodes with distinct fp within the radius. One word: exact, through shards by bytes. More
    words: shards by `samples` samples of bits, LOT of them at a time, each lot's links stored. A spanning forest for each shard; with a similarity all pairs that may be alike and of which one
    has its column `asks` set (nodes then have the columns `size` and `common` of shard_pairs() too)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = similarity is not None
    more = ("asks", "size", "common") if every else ()
    rows = nodes.select("fp", F.col("id").cast("long"), *more)
    node = StructType([StructField("id", LongType()), StructField("fp", fp_type(words))])
    schema = StructType([StructField("a", node), StructField("b", node)])
    arrow = to_arrow_schema(schema)
    masks = np.array([[sum(1 << (c - 64 * w) for c in cut if c // 64 == w) for w in range(words)] for cut in cuts_of(words, samples, sample_bits)], np.uint64).reshape(samples, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(table: pa.Table, end: int, tree: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = table.slice(0, end).combine_chunks()
            fps, ids = (table.column(c).combine_chunks() for c in ("fp", "id"))
            points = as_words(table.column("fp"), words)
            found = shard_pairs(points, tree[:end], table.column("asks").to_numpy(), radius, table.column("size").to_numpy(), table.column("common").to_numpy(), similarity) if every else [shard_links(points, tree[:end], radius)]
            no = table.column("no").to_numpy()
            for pair in found:
                if every:
                    new = first_met(points[pair[0]], points[pair[1]], no[pair[0]], masks)
                    pair = pair[0][new], pair[1][new]
                if len(pair[0]):
                    ends = [pa.StructArray.from_arrays([ids.take(pa.array(x)), fps.take(pa.array(x)).cast(arrow.field(0).type.field("fp").type)], fields=list(arrow.field(0).type)) for x in pair]
                    yield pa.RecordBatch.from_arrays(ends, schema=arrow)

        def work(table: pa.Table, last: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table]:
            no, shard = table.column("no").to_numpy(), table.column("shard").to_numpy()
            tree = np.cumsum(np.r_[False, (no[1:] != no[:-1]) | (shard[1:] != shard[:-1])])
            end = len(tree) if last else int(np.searchsorted(tree, tree[-1])) if len(tree) else 0
            return search(table, end, tree) if end else iter(()), table.slice(end)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                out, rest = work(pa.Table.from_batches(held), False)
                yield from out
                held, rows = rest.combine_chunks().to_batches(), 0
        if held:
            yield from work(pa.Table.from_batches(held), True)[0]

    def linked(shards: DataFrame) -> DataFrame:
        dealt = shards.repartition(parts, "no", "shard").sortWithinPartitions("no", "shard", "fp")
        found = dealt.select("fp", "id", *more, F.col("no").cast("long"), F.col("shard").cast("long")).mapInArrow(run, schema)
        return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    if words == 1:
        return linked(rows.select("*", byte_shards(F.col("fp"), radius=radius).alias("no", "shard"))).distinct()
    lots = [linked(sample_shards(rows, words, samples, sample_bits, range(k, min(samples, k + LOT)))) for k in range(0, samples, LOT)]
    return reduce(DataFrame.unionByName, (stored(x, "lot") for x in lots) if len(lots) > 1 else lots).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every other node that has a link. edges: (a, b).
    Large and small stars in turn, each a grouped minimum and an equi-join, until nothing changes; every round is a stored
    table, so that lineage stays short and a lost executor repeats one round at most."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(low, F.col("b") == F.col("k")).where("m < b").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")
        after = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = new
        if state == after:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(prints: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row. nodes: fp, first_id, n; parts: node and root. The few fingerprints that a thousandth of all rows
    or more have (a thousand of them at most) are sent to the rows, so that a text with very many copies is no key of a shuffle."""
    total = prints.count()
    best = parts.select(F.col("node.fp").alias("of"), F.col("root.id").alias("best"))
    id_ = F.coalesce("best", "first_id")
    named = stored(nodes.join(best, nodes["fp"] == best["of"], "left").select(F.col("fp").alias("of"), F.when(id_ != LAST, id_).alias("component_id"), "n"), "components")
    often = F.broadcast(named.where(F.col("n") * 1000 > total).select(F.col("of").alias("hot"), F.col("component_id").alias("hot_id")))
    seen = prints.select("doc_id", "fp").join(often, F.col("fp") == F.col("hot"), "left")
    rest = seen.where("hot is null").join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")
    return seen.where("hot is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest)


def nodes_of(prints: DataFrame, *more: Column) -> DataFrame:
    """fp, first_id (the smallest), n (rows), aggregates of the caller's and id (the smallest, behind all others if there is none)."""
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *more).withColumn("id", F.coalesce("first_id", F.lit(LAST))), "nodes")


def groups(docs: DataFrame, radius: int = RADIUS, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id linked with it) for every row; fingerprints of 64 bits, links exact."""
    prints = stored(fingerprints(docs, shingle_words=shingle_words), "fingerprints")
    nodes = nodes_of(prints)
    return labelled(prints, nodes, components(links(nodes, radius)))


def sampling(n: int, similarity: float = SIMILARITY, words: int = WORDS, missed: float = MISSED, shard: int = SHARD) -> tuple[int, int]:
    """How many bits a sample takes so that an average shard of n fingerprints stays small, and how many samples it takes so that a
    pair at the similarity, a standard deviation farther apart than expected, misses all of them with that probability only."""
    bits = max(8, min(32 * words, math.ceil(math.log2(max(2, n / shard)))))
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    apart += math.sqrt(apart * (1 - apart) / (64 * words))
    return bits, math.ceil(math.log(missed) / math.log1p(-((1 - apart) ** bits)))


def alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets (arrays of distinct values) have that share of their union in common; two empty ones do."""
    both = F.size(F.array_intersect(x, y))
    return both >= F.lit(similarity) * (F.size(x) + F.size(y) - both) - 1e-9


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE, words: int = WORDS, radius: int = NEAR) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id linked with it) for every row; links are pairs of texts with that share of distinct shingles in common."""
    with temporary():
        prints = stored(prints_of(docs, shingle_words, words), "prints")
        nodes = nodes_of(prints, F.min("slot").alias("slot"))
        n = nodes.count()
        bits, samples = sampling(n, similarity, words)
        found = components(links(nodes, radius, words, samples, bits))
        member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node.fp").alias("of"), "node", "root")
        sets = stored(members(docs, nodes, member, shingle_words, words), "sets")
        exact = exact_links(sets, n, similarity, radius, words, samples, bits)
        return stored(labelled(prints, nodes, components(exact)), "near-groups", keep=True)


def members(docs: DataFrame, nodes: DataFrame, member: DataFrame, shingle_words: int, words: int) -> DataFrame:
    """node, root, key and the shingles of each node of a coarse group. Their texts are read again, one for each node and what else has its slot, so that
    the shingles of all other texts are neither stored nor moved."""
    slots = nodes.join(member, F.col("fp") == F.col("of")).select("slot").distinct()
    again = slotted(docs).join(F.broadcast(slots), "slot", "left_semi")
    sets = sketches(again, shingle_words=shingle_words, words=words).where("shingles is not null").join(member, F.col("fp") == F.col("of")).dropDuplicates(["of"])
    return sets.select("node", "root", F.xxhash64("node").alias("key"), "shingles")


def exact_links(sets: DataFrame, n: int, similarity: float, radius: int, words: int, samples: int, bits: int) -> DataFrame:
    """(a, b): nodes of coarse groups that are alike. sets: node, root, key and shingles, n: how many nodes there are in all."""
    # partners are in the same coarse group, so that only holders in it count
    listed = sets.select("key", F.xxhash64("root").alias("of"), F.explode("shingles").alias("shingle")).select("key", F.xxhash64("of", "shingle").alias("held"))
    holders = F.count("*").over(Window.partitionBy("held"))
    common = listed.select("key", holders.alias("holders")).where("holders > 1").groupBy("key").agg(F.count("*").alias("common"))
    known = stored(sets.select("key", "node", "root", F.size("shingles").cast("long").alias("size")).join(common, "key", "left").na.fill(0, ["common"]), "known")
    sizes = stored(known.groupBy("root").agg(F.count("*").alias("n"), F.max_by("node", F.struct(F.col("common") / F.greatest("size", F.lit(1)), "node")).alias("leader")), "coarse-groups")
    # a group of over a thousandth of all nodes (a thousand such groups at most) is cut into parts, each with a copy of the leader
    most = max(1000, -(-n // 1000))
    cut = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    large = F.broadcast(sizes.where(F.col("n") > most).select("root", "n"))
    left = sets.join(large, "root", "left").withColumn("part", F.pmod("key", cut).cast("int"))
    right = sizes.join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("own")), "leader").select("root", "leader", "own", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, cut).otherwise(F.lit(1)) - 1)).alias("part"))
    compared = stored(left.join(right, ["root", "part"]).where("node <> leader").select("node", "leader", alike(F.col("shingles"), F.col("own"), similarity).alias("ok")), "compared")
    exact = compared.where("ok").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    others = stored(compared.where("not ok").select("node").join(known, "node").where(F.col("common") >= similarity * F.col("size") - 1e-6).select("node", "root"), "others")
    if others.isEmpty():
        return exact
    rows = known.join(others.select("root").distinct(), "root", "left_semi").join(others.select("node", F.lit(True).alias("asks")), "node", "left")
    pairs = links(rows.select("node.*", F.coalesce("asks", F.lit(False)).alias("asks"), "size", "common"), radius, words, samples, bits, similarity)
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    return exact.unionByName(pairs.join(x, "a").join(y, "b").where(alike(F.col("of_a"), F.col("of_b"), similarity)).select("a", "b"))
