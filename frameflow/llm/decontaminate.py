"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into shards of a bounded number of tokens. Each shard stores, for every term, the sorted
positions at which it stands (positions count through the shard; documents are kept apart by a gap). A test
phrase is found by taking the position lists of its terms, each moved back by the term's place in the phrase,
and intersecting them from the rarest list of the shard on: what is left are the places where the whole phrase
stands (exact), or where each term stands within `slop` words of its place (proximity).

Defined results: a null text has no words; rows with equal ids stay rows of their own; phrases without words and
phrases with a null id are never found; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import LOWER, TO_LOWER, UPPER, WORD, stored

WINDOW = 10
#: Tokens of a shard: bounds a search task's memory (4 bytes a posting).
SHARD_TOKENS = 2_000_000
#: Words of test phrases that go to the tasks at once; a larger test set is searched in blocks of this size.
BLOCK_WORDS = 1_000_000

INDEX = StructType([
    StructField("shard", LongType()), StructField("term", StringType()), StructField("gaps", BinaryType()),
    StructField("doc_ids", ArrayType(LongType())), StructField("doc_words", ArrayType(LongType())),
])
MATCHES = StructType([
    StructField("shard", LongType()), StructField("ordinal", IntegerType()), StructField("doc_id", LongType()), StructField("n_words", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("items", ArrayType(LongType())),
])


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(TO_LOWER)) if text else []


def windows_of(words: list[str], n: int = WINDOW) -> Iterable[tuple[str, ...]]:
    """All runs of n words; a shorter phrase is one run, an empty one none."""
    return (tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else ()


class Codes(dict):
    """Numbers of words in the order they come in."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def short(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, seven bits in each and the lowest first; the eighth bit says that another follows. And where each number ends."""
    size = 1 + sum((numbers >= np.uint32(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out, begin = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[begin[some] + k] = (numbers[some] >> np.uint32(7 * k)) & np.uint32(127) | (size[some] > k + 1).astype(np.uint32) << np.uint32(7)
    return out, ends


def positions(lists: list[bytes]) -> list[np.ndarray]:
    """The sorted positions of each list of short differences, none of which is empty."""
    if not lists:
        return []
    flat = np.frombuffer(b"".join(lists), np.uint8)
    ends = np.flatnonzero(flat < 128) + 1
    begin = np.r_[0, ends[:-1]]
    gaps, size = np.zeros(len(ends), np.int64), ends - begin
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        gaps[some] |= (flat[begin[some] + k] & 127).astype(np.int64) << 7 * k
    last = np.searchsorted(ends, np.cumsum([len(x) for x in lists])) + 1
    at, first = np.cumsum(gaps), np.r_[0, last[:-1]]
    at -= np.repeat(at[first] - gaps[first], last - first)
    return np.split(at, last[:-1])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW, shard_tokens: int = SHARD_TOKENS, brief: bool = False) -> DataFrame:
    """The postings of a corpus as a table: one row per shard and term (differences of sorted positions, four bytes each or, if brief, as many as each takes), and one row
    per shard with a null term that lists its documents. All terms are indexed, so that any test set can be looked up."""
    arrow = to_arrow_schema(INDEX)

    def emit(shard: int, terms: Codes, codes: list, ids: list, lens: list) -> pa.RecordBatch:
        flat, n = np.concatenate(codes), len(terms)
        size = np.asarray(lens, np.int64)
        begin = np.r_[0, np.cumsum(size + gap)[:-1]]
        at = (np.arange(len(flat)) + np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size)).astype(np.uint32)
        order = np.argsort(flat, kind="stable")
        at, held = at[order], np.bincount(flat, minlength=n)
        heads = np.r_[0, np.cumsum(held)[:-1]] if n else np.empty(0, np.int64)
        gaps = np.diff(at, prepend=np.uint32(0)).astype("<u4")
        gaps[heads] = at[heads]
        gaps, ends = short(gaps) if brief else (gaps, 4 * np.arange(1, len(gaps) + 1))
        # the lists stand one after the other in one buffer: no Python value is made of any
        places = np.r_[0, ends[np.cumsum(held) - 1], gaps.nbytes].astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(places), pa.py_buffer(gaps)])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, shard)), pa.array([*terms, None], pa.string()), lists.cast(arrow.field("gaps").type),
            pa.array([None] * n + [ids], arrow.field("doc_ids").type), pa.array([None] * n + [lens], arrow.field("doc_words").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, used = TaskContext.get().partitionId() << 24, 0
        terms, codes, ids, lens = Codes(), [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                codes.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                lens.append(len(words))
                used += len(words) + gap
                if used >= shard_tokens:
                    yield emit(shard, terms, codes, ids, lens)
                    shard, used, terms, codes, ids, lens = shard + 1, 0, Codes(), [], [], []
        if ids:
            yield emit(shard, terms, codes, ids, lens)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


def phrase_starts(lists: dict[str, np.ndarray], phrase: tuple[str, ...], slop: int = 0) -> np.ndarray:
    """Places where the phrase begins: lists moved back by their offset, intersected from the rarest on.
    With slop, a term may stand up to so many words from its place; the rarest term gives the place."""
    try:
        parts = sorted(((lists[t], o) for o, t in enumerate(phrase)), key=lambda x: len(x[0]))
    except KeyError:
        return np.empty(0, np.int64)
    found = parts[0][0] - parts[0][1]
    for at, o in parts[1:]:
        if not len(found):
            break
        i = np.searchsorted(at, found + (o - slop))
        i_ok = np.minimum(i, len(at) - 1)
        found = found[(i < len(at)) & (at[i_ok] <= found + (o + slop))]
    return found


def search_shard(lists: dict[str, np.ndarray], doc_ids, doc_words, phrases: Iterable[tuple[tuple[str, ...], list[int]]], gap: int, slop: int = 0) -> Iterator[tuple]:
    """One tuple for each document of the shard: ordinal, id, words, hit spans (merged), items found. phrases: runs of words and the items that have them."""
    n = len(doc_ids)
    lens = np.asarray(doc_words, np.int64)
    begin = np.r_[0, np.cumsum(lens + gap)[:-1]] if n else np.empty(0, np.int64)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for phrase, whose in phrases:
        at = phrase_starts(lists, phrase, slop)
        if not len(at):
            continue
        at = np.unique(at[at >= 0]) if slop else at
        owner = np.searchsorted(begin, at, side="right") - 1
        for p, d in zip(at.tolist(), owner.tolist(), strict=True):
            s = p - int(begin[d])
            e = min(s + len(phrase), int(lens[d]))
            if s < e:
                hits.setdefault(d, []).append((s, e))
                items.setdefault(d, set()).update(whose)
    for d in range(n):
        spans: list[list[int]] = []
        for s, e in sorted(hits.get(d, ())):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        yield d, doc_ids[d], int(lens[d]), [{"start": s, "end": e} for s, e in spans], sorted(items.get(d, ()))


def search(index: DataFrame, phrases: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW, slop: int = 0,
           gap: int = WINDOW, block_words: int = BLOCK_WORDS, brief: bool = False) -> DataFrame:
    """All documents of the index with the word spans at which windows of the test texts stand and the ids of those texts.
    slop=0: exact phrases; slop>0: proximity matches (slop must stay below gap); brief as the index is. Only the lists of the test set's terms are read from the index, and
    moved once, to their shard. The test texts are sent in blocks of a bounded number of words, of which a task holds one at a time."""
    spark = index.sparkSession
    tests = phrases.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (4 * block_words)))
    sent = []
    for b in range(blocks):
        table: dict[tuple[str, ...], set[int]] = {}
        for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect():
            for w in windows_of(words_of(r["text"]), n):
                table.setdefault(w, set()).add(r["item_id"])
        sent.append(spark.sparkContext.broadcast([(k, sorted(v)) for k, v in table.items()]))

    def every() -> Iterator[tuple[tuple[str, ...], list[int]]]:
        for block in sent:
            yield from block.value
            if len(sent) > 1:
                del block._value  # read again from the worker's disk for the next shard

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["term"].isna()].iloc[0]
        terms = pdf[pdf["term"].notna()]
        own = terms["gaps"].tolist()
        lists = dict(zip(terms["term"], positions(own) if brief else (np.cumsum(np.frombuffer(g, "<u4").astype(np.int64)) for g in own), strict=True))
        out = [(head["shard"], *row) for row in search_shard(lists, list(head["doc_ids"]), head["doc_words"], every(), gap, slop)]
        return pd.DataFrame({f.name: pd.Series([r[i] for r in out], dtype="Int64" if f.name == "doc_id" else None) for i, f in enumerate(MATCHES.fields)})

    terms = tests.select(F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("term")).distinct()
    # as many terms as one block may have words fit into memory everywhere; more of them are joined by a shuffle
    terms = F.broadcast(terms) if blocks == 1 else terms
    wanted = index.where("term is not null").join(terms, "term", "left_semi").select(*INDEX.names).unionByName(index.where("term is null"))
    return wanted.groupBy("shard").applyInPandas(find, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The index of all terms of the documents, stored in the shared folder, and the search of the test set in it."""
    gap = n + slop
    index = stored(build_index(docs, gap=gap, shard_tokens=shard_tokens, brief=True), "postings")
    return search(index, benchmark, n=n, slop=slop, gap=gap, block_words=block_words, brief=True)
