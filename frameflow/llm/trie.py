"""The prefix trie of rebuilt conversations, by smallest-member ownership.

Each conversation is a path of turns from the root. A node (a distinct prefix) is owned by the smallest conversation that passes through it. Who owns a
node owns all nodes below it on its path, so each conversation owns a suffix of its path, and the owned rows are the trie's nodes, each once. Windows
mark the owned rows, running sums along each path give the words at and below each row, all and owned ones, and one grouping by prefix then sums over
its members: the words of occurrences less those of owned nodes are the words saved in the subtree, the owned next rows are the children, and the owned
childless ends are the leaves.

Shuffles carry 40 bytes a turn, never its text: a turn is a digest of role and text (SHA-256, cut to 128 bits) and a number of words; a prefix is its
length and the exclusive or of its turns' digests, each mixed with its depth. Windows over a prefix are salted in two levels, about the square root of all
rows each, so that a prefix which a third of all conversations share is no group of one task. Ids of conversations that end at a node are first joined in
lists of at most CHUNK ids (by their upper bits), then hashed in order while they stream past, as a SHA-256 allows no other way.

Defined results: a null turn number comes first; turns with equal numbers go by role and the digest of the text; a null role or text is empty; repeated rows
are turns of their own; rows without a conversation id belong to no conversation and are left out; an empty table has no conversation and no node; only
the named columns are read. One conversation's turns are sorted by one task, which spills; nothing holds them in memory.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word is what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The first turns of conversation c - c % FAMILY stand for the first crc32(c) % HEADS turns of conversation c.
FAMILY, HEADS = 20, 4
#: Ids of at most so many conversations, in a row of numbers, make one list.
CHUNK = 4_096
NODE = ["depth", "k1", "k2"]


def half(digest: Column, place: int) -> Column:
    """Eight bytes of a digest in hex, as a signed number."""
    return F.conv(F.substring(digest, 16 * place + 1, 16), 16, -10).cast("long")


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, k (place of the turn, from 1), a, b (its digest) and words. Texts are read once, in place."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # the role's length keeps role and text apart
    digest = F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)), 256)
    slim = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return slim.select("conv_id", F.row_number().over(order).alias("k"), half(F.col("digest"), 0).alias("a"), half(F.col("digest"), 1).alias("b"), "words")


def rebuilt(told: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns() of every rebuilt conversation, with its root: conv_id, depth (from 0), a, b, words. A conversation takes its first h turns from the first of its
    family and keeps its own after its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads).cast("long")).cast("int")
    convs = told.where("k = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first_id"))
    # at most three turns of a conversation are lent
    lent = told.where((F.col("k") < heads) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("first_id")).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "words"))).alias("lent"))
    none = F.expr("cast(array() as array<struct<k:int,a:bigint,b:bigint,words:bigint>>)")
    start = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words")))
    taken = F.filter(F.coalesce("lent", none), lambda t: t["k"] <= F.col("h"))
    front = convs.join(lent, "first_id", "left").select("conv_id", F.explode(F.concat(start, taken)).alias("t")).select("conv_id", F.lit(0).alias("part"), "t.*")
    own = told.where(F.col("k") > h).select("conv_id", F.lit(1).alias("part"), "k", "a", "b", "words")
    path = Window.partitionBy("conv_id").orderBy("part", "k")
    return front.unionByName(own).select("conv_id", (F.row_number().over(path) - 1).cast("long").alias("depth"), "a", "b", "words")


def paths(rows: DataFrame) -> DataFrame:
    """One row for each conversation and depth: the prefix up to there as depth, k1, k2, the words of its last turn, and whether the path goes on."""
    path = Window.partitionBy("conv_id").orderBy("depth")
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    mixed = lambda *c: F.when(F.col("depth") > 0, F.xxhash64("depth", *c)).otherwise(F.lit(0).cast("long"))
    return rows.select("conv_id", "depth", F.bit_xor(mixed("a", "b")).over(so_far).alias("k1"), F.bit_xor(mixed("b", "a")).over(so_far).alias("k2"), "words", F.lead("depth").over(path).isNotNull().alias("inner"))


def owned(steps: DataFrame, salts: int) -> DataFrame:
    """paths() with each prefix's smallest conversation and whether any path goes on there. Three windows: the smallest of each salt's members, the
    smallest of these, and back to the members."""
    salted = steps.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)))
    part = Window.partitionBy(*NODE, "salt")
    first = salted.select("*", F.min("conv_id").over(part).alias("m1"), F.max("inner").over(part).alias("i1"))
    chief = F.col("conv_id") == F.col("m1")
    top = Window.partitionBy(*NODE, "group")
    second = first.withColumn("group", F.when(chief, -1).otherwise(F.col("salt"))).select("*", F.min("m1").over(top).alias("m2"), F.max("i1").over(top).alias("i2"))
    known = lambda c: F.max(F.when(F.col("group") == -1, F.col(c))).over(part)
    return second.select("conv_id", *NODE, "words", "inner", known("m2").alias("owner"), known("i2").alias("passed"))


def nodes(rows: DataFrame) -> DataFrame:
    """All nodes with conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves and saved_tokens, beside their prefix."""
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below = up.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("owner") == F.col("conv_id")
    at = rows.select(
        "conv_id", *NODE, own.alias("own"), F.sum("words").over(below).alias("all_words"), F.sum(F.when(own, F.col("words")).otherwise(0)).over(below).alias("own_words"),
        F.coalesce(F.lag(own).over(up), F.lit(False)).alias("child"), F.lead("owner").over(up).alias("parent"), F.first(own & ~F.col("passed")).over(below).alias("leaf"))
    return at.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("own"), F.col("parent"))).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if("child").alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(F.col("all_words") - F.col("own_words")).alias("saved_tokens"))


def ends(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each prefix at which conversations end: the digest of their ids in order."""
    listed = rows.where("not inner").groupBy(*NODE, F.floor(F.col("conv_id") / F.lit(chunk)).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*node, digest.hexdigest()), schema, strict=True)], schema=schema)

    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, family: int = FAMILY, heads: int = HEADS, **columns: str) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations. Turn digests and the marked paths are stored, as both are read more than once."""
    told = stored(turns(rows, **columns), "turns")
    steps = stored(paths(rebuilt(told, family, heads)), "paths")
    marked = owned(steps, max(1, math.isqrt(steps.count())))
    found = nodes(marked).join(ends(steps), NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
