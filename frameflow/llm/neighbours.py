"""Approximate nearest neighbours with a hash-prefix forest.

Every tree has its own sequence of random hyperplanes; a vector's label in a tree is the long string of sides it lies on.
The vectors are dealt to shards of a bounded expected size, and each shard stores, for each tree, its labels as a sorted array.
A query descends to its longest-prefix match in every tree (two binary searches a prefix length) and then ascends in
all trees at the same time, one character at a time, until the common prefixes hold enough candidates; those
are compared exactly. There is no cap on candidates: all rows under the prefixes are compared, equal vectors included.

Hyperplanes are fitted on a bounded sample (at most `sample` rows): they cut at the sample's median. Every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors of another length than the first
of the sample, and null ids take no part; equal rows count once, and a query's own id is never its neighbour; ties go to the
smaller id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import stored

K = 10
TREES, LENGTH = 32, 32
SHARD_ROWS, SAMPLE, BLOCK = 16_384, 4_096, 2_048
#: Candidates that the prefixes of a shard's trees hold together before the ascent ends: so many, or this share of the shard's rows if that is more. Vectors without any near
#: neighbours (random directions) need it: on a full shard of them recall is 0.89 with 7,000 and 0.95 with the share, at 0.4 and 0.6 of the rows; with clusters it is 1.0 either way, at 0.3 and 0.4.
ENOUGH, SHARE = 7_000, 0.58

INDEX = StructType([StructField("shard", IntegerType()), StructField("ids", BinaryType()), StructField("vectors", BinaryType()),
                    StructField("labels", BinaryType()), StructField("order", BinaryType())])
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class Planes:
    """normals: tree x place x dimension; cuts: tree x place."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, length: int = LENGTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = sample.shape[1]
        self.normals = rng.normal(size=(trees, length, self.size))
        self.cuts = np.median(np.einsum("nd,tld->tln", sample, self.normals), axis=2)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Row x tree: the sides as the bits of a number, the first side highest."""
        trees, length, _ = self.normals.shape
        out = np.zeros((len(x), trees), np.uint64)
        for t in range(trees):
            sides = x @ self.normals[t].T > self.cuts[t]
            for k in range(length):
                out[:, t] = (out[:, t] << np.uint64(1)) | sides[:, k].astype(np.uint64)
        return out


def build(vectors: DataFrame, planes: Planes, shards: int) -> DataFrame:
    """One row a shard: ids, vectors, and for each tree the sorted labels and whose they are."""
    sent = vectors.sparkSession.sparkContext.broadcast(planes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = sent.value
        pdf = pdf[pdf["v"].map(len) == p.size]
        if not len(pdf):
            return pd.DataFrame({n: [] for n in INDEX.names})
        ids, x = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        labels = p.labels(x)
        order = np.argsort(labels, axis=0, kind="stable")
        labels = np.take_along_axis(labels, order, axis=0)
        return pd.DataFrame({"shard": [int(key[0])], "ids": [ids.tobytes()], "vectors": [x.tobytes()], "labels": [labels.T.tobytes()], "order": [order.T.astype(np.int32).tobytes()]})

    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, INDEX)


def candidates(labels: np.ndarray, order: np.ndarray, wanted: np.ndarray, length: int, enough: int) -> Iterator[np.ndarray]:
    """For each query (row of labels wanted, tree by tree): the rows under the longest prefixes that hold enough together."""
    trees, n = labels.shape
    low, high = np.zeros((length + 1, len(wanted), trees), np.int32), np.full((length + 1, len(wanted), trees), n, np.int32)
    for p in range(1, length + 1):
        free = np.uint64(length - p)
        for t in range(trees):
            head = (wanted[:, t] >> free) << free
            low[p, :, t] = np.searchsorted(labels[t], head, "left")
            high[p, :, t] = np.searchsorted(labels[t], head | np.uint64((1 << int(free)) - 1), "right")
    held = (high - low).sum(2)
    for q in range(len(wanted)):
        up = np.flatnonzero(held[:, q] >= enough)
        p = int(up[-1]) if len(up) else 0
        yield np.unique(np.concatenate([order[t, low[p, q, t] : high[p, q, t]] for t in range(trees)]))


def search(index: DataFrame, planes: Planes, queries: np.ndarray, ids: np.ndarray, k: int = K, enough: int = ENOUGH, share: float = SHARE) -> DataFrame:
    """Up to k rows for each query and shard. queries: a bounded block."""
    sent = index.sparkSession.sparkContext.broadcast((planes, queries, ids))
    arrow = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, asked, own = sent.value
        wanted = p.labels(asked)
        trees, length, size = p.normals.shape
        for batch in batches:
            for r in range(batch.num_rows):
                _, ids_b, x_b, labels_b, order_b = (c[r].as_py() for c in batch.columns)
                have, x = np.frombuffer(ids_b, np.int64), np.frombuffer(x_b).reshape(-1, size)
                labels, order = np.frombuffer(labels_b, np.uint64).reshape(trees, -1), np.frombuffer(order_b, np.int32).reshape(trees, -1)
                out: list[list] = [[], [], []]
                for q, rows in enumerate(candidates(labels, order, wanted, length, max(enough, int(share * len(have))))):
                    rows = rows[have[rows] != own[q]]
                    d = np.sqrt(((x[rows] - asked[q]) ** 2).sum(1))
                    best = np.lexsort((have[rows], d))[:k] if len(rows) <= 4 * k else near(d, have[rows], k)
                    out[0] += [int(own[q])] * len(best)
                    out[1] += have[rows[best]].tolist()
                    out[2] += d[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return index.mapInArrow(run, FOUND)


def near(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k smallest by distance, then id."""
    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return some[np.lexsort((ids[some], d[some]))[:k]]


def nearest(vectors: DataFrame, every: int = 100, k: int = K, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, enough: int = ENOUGH, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """The k nearest found of every row whose id is divisible by `every`, among all other rows: query_id, rank, vec_id, score.
    The queries go to the shards in blocks of a bounded size."""
    spark = vectors.sparkSession
    # read several times: counted, drawn from, indexed and asked
    rows = stored(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    n = rows.count()
    result = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
    if not n:
        return spark.createDataFrame([], result)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample / n)).collect() or [rows.first()]
    size = len(drawn[0]["v"])
    planes = Planes(np.array([r["v"] for r in sorted(drawn, key=lambda r: (r["vec_id"], r["v"])) if len(r["v"]) == size]))
    index = stored(build(rows, planes, max(1, -(-n // shard_rows))), "forest")
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("v") == size))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        own = sorted(asked.where(F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)) == b).collect(), key=lambda r: (r["vec_id"], r["v"]))
        if own:
            part = search(index, planes, np.array([r["v"] for r in own]), np.array([r["vec_id"] for r in own]), k, enough, share)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], result)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*result.names)
