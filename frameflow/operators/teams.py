"""Team assignment: votes, thresholds, resets, accuracy under renaming, clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from frameflow.sources.store import table

#: Vectors that two_means() compares with all centres at once.
AT_ONCE = 4096
WINDOW, THRESHOLD, RESET = 9, 0.6, 50


def abstain(team: Column, confidence: Column, crop_ok: Column, threshold: float = THRESHOLD) -> Column:
    """0 for an unusable crop or a confidence below the threshold, else the team."""
    return F.when(~crop_ok | (confidence < threshold), F.lit(0)).otherwise(team)


def vote(raw: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row's team by the confidence-weighted vote of the player's rows around it (window//2 before, (window-1)//2 after, its
    own rows only). Team 1 wins ties; weights count to six places, so that sums in another order agree."""
    near = Window.partitionBy("clip_no", "player_id").orderBy("frame_idx").rowsBetween(-(window // 2), (window - 1) // 2)
    weight = F.when(F.col("crop_ok"), F.col("confidence")).otherwise(F.lit(0.0))
    side = lambda t: F.sum(F.when(F.col("predicted_team") == t, weight).otherwise(F.lit(0.0))).over(near)
    return raw.withColumn("voted_team", F.when(F.round(side(1) - side(2), 6) >= 0, 1).otherwise(2))


def memoised(raw: DataFrame, every: int = RESET) -> DataFrame:
    """The first confident decision since the last reset holds; before it, the row's own."""
    own = abstain(F.col("predicted_team"), F.col("confidence"), F.col("crop_ok"))
    before = Window.partitionBy("clip_no", "player_id", F.floor(F.col("frame_idx") / every)).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("memo_team", F.coalesce(F.first(F.when(own != 0, own), ignorenulls=True).over(before), own))


def majority(raw: DataFrame) -> DataFrame:
    """The most frequent team of each player; on a tie the one seen first."""
    counts = raw.groupBy("clip_no", "player_id", "predicted_team").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first_seen"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first_seen", "predicted_team")).alias("best")
    return counts.groupBy("clip_no", "player_id").agg(best).select("clip_no", "player_id", F.col("best.predicted_team").alias("track_team"), (-F.col("best.n")).cast("long").alias("votes"))


def modal(labels: DataFrame) -> DataFrame:
    """The modal label of each player without `unclear`; null on a tie."""
    counts = labels.where("true_team <> 'unclear'").groupBy("clip_no", "player_id", "true_team").agg(F.count("*").alias("n"))
    top = counts.withColumn("most", F.max("n").over(Window.partitionBy("clip_no", "player_id"))).where("n = most")
    return top.groupBy("clip_no", "player_id").agg(F.when(F.count("*") == 1, F.min("true_team")).alias("modal_team"))


def flips(raw: DataFrame, column: str = "predicted_team") -> DataFrame:
    """How often each player's team changes from one row to the next."""
    order = Window.partitionBy("clip_no", "player_id").orderBy("frame_idx")
    changed = F.lag(column).over(order) != F.col(column)
    return raw.withColumn("changed", changed).groupBy("clip_no", "player_id").agg(F.count_if("changed").cast("long").alias("flips"), F.count("*").cast("long").alias("n_rows"))


def renamed_accuracy(scored: DataFrame) -> DataFrame:
    """Rows (clip_no, team, true_team) to right, decided and all rows, each clip under the better of the two namings."""
    per = scored.groupBy("clip_no").agg(
        F.count("*").cast("long").alias("n"), F.count_if(F.col("team") != 0).cast("long").alias("decided"),
        F.count_if((F.col("team") != 0) & (F.col("team") == F.col("true_team"))).cast("long").alias("direct"))
    right = F.greatest("direct", F.col("decided") - F.col("direct"))
    return per.agg(F.sum(right).cast("long").alias("n_right"), F.sum("decided").cast("long").alias("decided"), F.sum("n").cast("long").alias("n_all"))


def binomial_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs."""
    n, low = b + c, F.least(b, c)
    terms = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.struct(F.lit(1.0).alias("choose"), F.lit(0.0).alias("total")),
                        lambda a, k: F.struct((a["choose"] * F.when(k == 0, 1.0).otherwise((n - k + 1) / k)).alias("choose"), (a["total"] + a["choose"] * F.when(k == 0, 1.0).otherwise((n - k + 1) / k)).alias("total")), lambda a: a["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * terms / F.pow(F.lit(2.0), n)))


def mcnemar(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Two by two counts of two boolean columns and the exact p."""
    counts = pairs.agg(*[F.count_if((F.col(first) == a) & (F.col(second) == b)).cast("long").alias(f"n_{int(a)}{int(b)}") for a in (True, False) for b in (True, False)])
    return counts.withColumn("p", F.round(binomial_p(F.col("n_10"), F.col("n_01")), 9))


def two_means(points: DataFrame, group: str, id_col: str, vector: str, seed: int = 42, tries: int = 10, rounds: int = 50, unit_length: bool = True, brightest_first: bool = False) -> DataFrame:
    """Two clusters of unit vectors (or of the vectors as they are) for each group by Lloyd's rounds from several starts (two rows by hash each); cluster 1 is the one whose centre comes first in
    order, or has the larger sum. Every round reads all vectors in Arrow batches, which give sums by group, start and nearest centre; a group may be of any size. What comes to the driver is
    two centres a group and start. Returns group, id, cluster and margin."""
    from frameflow.functions.boxes import margin, unit

    v = F.col(vector).cast("array<double>")
    # stored: every round reads the vectors, and none makes them of unit length again
    rows = table(points.select(group, id_col, (unit(v) if unit_length else v).alias("v")), "vectors")
    draw = lambda t: F.xxhash64(F.lit(seed), F.lit(t), id_col)
    first = rows.groupBy(group).agg(*[f("v", draw(t)).alias(f"{name}_{t}") for t in range(tries) for name, f in (("a", F.min_by), ("b", F.max_by))]).collect()
    if not first:
        return rows.select(group, id_col, F.lit(1).alias("cluster"), F.lit(0.0).alias("margin"))
    centres = {r[group]: np.array([[r[f"a_{t}"], r[f"b_{t}"]] for t in range(tries)]) for r in first}
    size, kind = len(first[0]["a_0"]), points.schema[group].dataType.simpleString()

    def summed(now: dict) -> list:
        sent = points.sparkSession.sparkContext.broadcast(now)

        def run(batches):
            # sums of all of a task's batches: a task gives one row for each group, start and centre
            n, cost, total = ({g: np.zeros(c.shape[:2] + more) for g, c in sent.value.items()} for more in ((), (), (size,)))
            for batch in batches:
                keys, every = batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, size)
                for key in keys.unique():
                    own = every[pc.equal(keys, key).to_numpy(zero_copy_only=False)] if key.is_valid else every[keys.is_null().to_numpy(zero_copy_only=False)]
                    key = key.as_py()
                    c = sent.value[key]
                    for x in (own[a : a + AT_ONCE] for a in range(0, len(own), AT_ONCE)):
                        d = ((x * x).sum(1)[:, None, None] + (c * c).sum(2)[None] - 2 * (x @ c.reshape(-1, size).T).reshape(-1, *c.shape[:2])).clip(0)
                        mine = d.argmin(2)[:, :, None] == np.arange(2)
                        n[key] += mine.sum(0)
                        cost[key] += (d * mine).sum(0)
                        total[key] += (mine.reshape(len(x), -1).T.astype(float) @ x).reshape(c.shape)
            for key in n:
                if n[key].any():
                    each = [(key, t, k, int(n[key][t, k]), float(cost[key][t, k]), total[key][t, k].tolist()) for t in range(len(n[key])) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*each, strict=True), sums, strict=True)], schema=sums)

        schema = StructType([points.schema[group], *[StructField(c, t) for c, t in (("t", IntegerType()), ("k", IntegerType()), ("n", LongType()), ("cost", DoubleType()), ("total", ArrayType(DoubleType())))]])
        sums = to_arrow_schema(schema)
        parts = rows.select(group, "v").mapInArrow(run, schema)
        return parts.groupBy(group, "t", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect()

    for _ in range(rounds):
        found, moved = summed(centres), False
        new = {g: c.copy() for g, c in centres.items()}
        for r in found:
            if r["n"]:
                new[r[group]][r["t"], r["k"]] = np.array(r["total"]) / r["n"]
        moved = not all(np.allclose(new[g], centres[g], atol=1e-6) for g in centres)
        centres = new
        if not moved:
            break
    cost = {g: np.zeros(tries) for g in centres}
    for r in summed(centres):
        cost[r[group]][r["t"]] += r["cost"]
    place = (lambda c: (-sum(c), c)) if brightest_first else None
    best = {g: sorted(centres[g][int(np.argmin(np.round(cost[g], 9)))].tolist(), key=place) for g in centres}
    both = F.broadcast(points.sparkSession.createDataFrame([(g, a, b) for g, (a, b) in best.items()], f"{group} {kind}, c1 array<double>, c2 array<double>"))
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = rows.join(both, group).select(group, id_col, far("c1").alias("d1"), far("c2").alias("d2"))
    return near.select(group, id_col, F.when(F.col("d1") <= F.col("d2"), 1).otherwise(2).alias("cluster"), margin(F.least("d1", "d2"), F.greatest("d1", "d2")).alias("margin"))


def lloyd(x: np.ndarray, seed: int = 42, tries: int = 10, rounds: int = 50) -> np.ndarray:
    """Two centres of the rows of x, the lighter (larger sum) first: the cheapest of several runs of Lloyd's rounds, each from two rows that differ if any do."""
    rng = np.random.default_rng(seed)
    # equal rows are one row with a weight
    x, weight = np.unique(x, axis=0, return_counts=True)
    kinds, w = x, weight[:, None].astype(float)
    best, least = None, np.inf
    for _ in range(tries):
        c = kinds[rng.choice(len(kinds), 2, replace=len(kinds) < 2)].astype(float)
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.stack([(x[near == k] * w[near == k]).sum(0) / w[near == k].sum() if (near == k).any() else c[k] for k in (0, 1)])
            done, c = np.allclose(new, c, atol=1e-9), new
            if done:
                break
        cost = float((((x[:, None] - c[None]) ** 2).sum(2).min(1) * weight).sum())
        if cost < least - 1e-9:
            best, least = c, cost
    return np.array(sorted(best.tolist(), key=lambda v: (-sum(v), v)))


def colour_teams(crops: DataFrame, group: str, id_col: str, colour: str) -> DataFrame:
    """Teams by jersey colour, for each group: two means over all colours, team 1 the lighter one; returns group, id, predicted_team, confidence (the margin)
    and crop_ok. A crop without a colour takes no part and gets no team (null, confidence 0). A group with fewer than two colours is an error. A group is a clip, so each is
    fitted by one task, and none comes to the driver; for groups of any size there is two_means()."""
    kinds = {f.name: f.dataType for f in crops.schema.fields}
    schema = StructType([StructField(group, kinds[group]), StructField(id_col, kinds[id_col]), StructField("predicted_team", IntegerType()), StructField("confidence", DoubleType()), StructField("crop_ok", BooleanType())])
    arrow = to_arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        known = table.column(colour).is_valid().to_numpy()
        if known.sum() < 2:
            raise ValueError(f"too few crops with a colour: {known.sum()} in {group} {table.column(group)[0].as_py()}")
        # rows of a group come in any order; lloyd() sorts them
        x = pc.list_flatten(table.column(colour)).to_numpy().reshape(int(known.sum()), -1)
        c = lloyd(x)
        d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
        team, sure = np.zeros(len(known), np.int32), np.zeros(len(known))
        team[known], sure[known] = np.where(d[:, 0] <= d[:, 1], 1, 2), d.max(1) / (d.sum(1) + 1e-9)
        return pa.table([table.column(group), table.column(id_col), pa.array(team, pa.int32(), mask=~known), pa.array(sure), pa.array(known)], schema=arrow)

    return crops.select(group, id_col, F.col(colour).cast("array<double>").alias(colour)).groupBy(group).applyInArrow(one, schema)


#: How players get their teams: each takes (crops, group, id, vector) and returns group, id, predicted_team, confidence and crop_ok.
STRATEGIES: dict[str, Callable[[DataFrame, str, str, str], DataFrame]] = {"colour": colour_teams}


def strategy(name: str) -> Callable[[Callable], Callable]:
    """Adds a strategy under a name."""

    def add(f: Callable) -> Callable:
        STRATEGIES[name] = f
        return f

    return add


@strategy("embedding")
def embedding_teams(crops: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """Two means of unit vectors; a crop without a vector gets no team."""
    found = two_means(crops.where(F.col(vector).isNotNull()), group, id_col, vector)
    out = found.select(group, id_col, F.col("cluster").alias("predicted_team"), F.col("margin").alias("confidence"), F.lit(True).alias("crop_ok"))
    none = crops.where(F.col(vector).isNull()).select(group, id_col, F.lit(None).cast("int").alias("predicted_team"), F.lit(0.0).alias("confidence"), F.lit(False).alias("crop_ok"))
    return out.unionByName(none)


def assign_teams(name: str, crops: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """Teams by the strategy of that name; an unknown one is an error that names those there are."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](crops, group, id_col, vector)
