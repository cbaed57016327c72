"""Ball k-means on vectors of whole numbers.

A vector's components become floor(scale * x). Centroids start as the vectors with the smallest hashes of their ids. The first assignment compares every
vector with every centroid; each later one starts from the last: in each batch of rows the members of a cluster are a ball around its centroid whose radius
is the farthest member's distance. Only centroids less than two radii away can take members (its neighbours). A member nearer to its centroid than half
the way to the nearest neighbour is in the stable core and stays; the others lie in rings between the halves of the ways to successive
neighbours, and a ring's members are compared exactly with the neighbours up to its number. All comparisons are of whole numbers and exact, ties included: a
centroid at exactly twice a member's distance may tie with its own, and is compared.

The means are sums over tasks (one row for each cluster and component from each), added by Spark; the driver sees centroids only, as many as there are clusters. Each
assignment is a stored table, and the one before it is deleted.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; rows with equal ids stay rows of their
own; a null id counts as empty text for its hash; fewer vectors than clusters make as many clusters as vectors; an empty table gives an empty result;
only the named columns are read. Components beyond 2**62 either way count as that; distances and their sums beyond a long count as the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

CLUSTERS, ROUNDS, LENGTH, SCALE = 16, 3, 64, 64
#: Up to these components all sums of an assignment are below 2**53, so that doubles are exact; beyond them Python's own numbers are used.
EXACT = 1 << 21
LONGEST, LARGEST = 1 << 62, (1 << 63) - 1
ASSIGNED = "vec_id long, q array<long>, cluster int, distance long"


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the vector in whole numbers, of the rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    whole = lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(float(-LONGEST))), F.lit(float(LONGEST))))
    return rows.where((F.size(vector) == length) & F.forall(vector, sound)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, whole).alias("q"))


def starts(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest hashes, in their order."""
    place = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.orderBy(place, "q").limit(clusters).select("q").collect()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, exact: in doubles while everything is below 2**53, else in Python's numbers."""
    if a.dtype != object:
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.array([[sum((x - y) ** 2 for x, y in zip(p, c, strict=True)) for c in b] for p in a], object).reshape(len(a), len(b))


def numbers(values, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in the kind of numbers that is exact for both."""
    v, c = np.asarray(values), np.array(centroids, object)
    if (np.abs(v) <= EXACT).all() and all(abs(x) <= EXACT for row in centroids for x in row):
        return v.astype(float), c.astype(float)
    return v.astype(object), c


def first_assignment(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on a tie) and squared distance, by full comparison."""
    d = squared(v, c)
    near = d.argmin(1) if d.dtype != object else np.array([min(range(len(c)), key=lambda j, r=row: (r[j], j)) for row in d], int)
    return near, d[np.arange(len(v)), near]


def reassigned(v: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from an earlier assignment, and how many distances to centroids were computed."""
    between = squared(c, c)
    near, far, compared = own.copy(), np.zeros(len(v), v.dtype), 0
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        d = squared(v[rows], c[i : i + 1])[:, 0]
        compared += len(rows)
        others = sorted((j for j in range(len(c)) if j != i and between[i, j] <= 4 * d.max()), key=lambda j: (between[i, j], j))
        best, who = d.copy(), np.full(len(rows), i)
        # the ring of a member: how many neighbours are within twice its distance
        ring = np.array([(4 * d >= between[i, j]) for j in others]).sum(0) if others else np.zeros(len(rows), int)
        for n, j in enumerate(others):
            some = np.flatnonzero(ring > n)
            e = squared(v[rows[some]], c[j : j + 1])[:, 0]
            compared += len(some)
            better = (e < best[some]) | ((e == best[some]) & (j < who[some]))
            best[some[better]], who[some[better]] = e[better], j
        near[rows], far[rows] = who, best
    return near, far, compared


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every vector with its cluster and distance. Rows that have a cluster start from it."""
    again = "cluster" in vectors.columns
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, c = numbers(matrix(batch.column("q")), centroids)
            near, d = reassigned(v, batch.column("cluster").to_numpy().astype(int), c)[:2] if again else first_assignment(v, c)
            whole = pa.array([min(int(x), LARGEST) for x in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q").cast(pa.list_(pa.int64())), pa.array(near, pa.int32()), whole], schema=schema)

    return vectors.select("vec_id", "q", *["cluster"] * again).mapInArrow(run, ASSIGNED)


def means(rows: DataFrame, before: list[list[int]]) -> list[list[int]]:
    """The new centroids: whole parts of exact means; a cluster without members keeps its own."""
    n, length = len(before), len(before[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(n, np.int64), np.zeros((n, length), object)
        for batch in batches:
            v, own = matrix(batch.column("q")), batch.column("cluster").to_numpy()
            v = v if (np.abs(v) <= EXACT).all() else v.astype(object)
            for i in np.unique(own):
                counts[i] += int((own == i).sum())
                sums[i] += v[own == i].sum(0).astype(object)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(some, length), pa.int32()), pa.array(np.tile(np.arange(length), len(some)), pa.int32()), pa.array(np.repeat(counts[some], length), pa.int64()),
            pa.array([Decimal(int(x)) for x in sums[some].ravel()], pa.decimal128(38, 0))], names=["cluster", "place", "n", "total"])

    parts = rows.select("q", "cluster").mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    out = [list(c) for c in before]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def long_sum(c: str | Column) -> Column:
    return F.least(F.sum(F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c), F.lit(Decimal(LARGEST)))


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, **columns: str) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia and centroid (the final one, in whole numbers)."""
    spark = rows.sparkSession
    vectors = quantised(rows, length=length, scale=scale, **columns)
    centroids = starts(vectors, clusters)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    table = stored(assigned(vectors, centroids), "assigned")
    for _ in range(rounds):
        centroids = means(table, centroids)
        table, last = stored(assigned(table, centroids), "assigned"), table
        forget(last)
    # one row for each cluster
    total = table.groupBy("cluster").agg(long_sum("distance").alias("sum"))
    every = total.agg(long_sum("sum").cast("long").alias("inertia"))
    known = spark.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<long>")
    sums = known.join(total, "cluster").crossJoin(every).select("cluster", F.col("sum").cast("long").alias("cluster_inertia"), "inertia", "centroid")
    return table.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(found: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
