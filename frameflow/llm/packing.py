"""Best-fit-decreasing packing of tokenised documents.

Documents are tokenised (by the tokenizers library and its json file; strings of its added tokens are those tokens), end with a separator token and are cut only where longer than a sequence: the first piece takes
the remainder, all others are full. Full pieces are sequences of their own. The other pieces (at most one a document) are
dealt by hash to groups of a bounded expected size; each group is packed longest piece first into the open bin with the
least room that still fits, found in a segment tree over remaining capacities.

Defined results: a null text is empty and is packed as its separator alone; rows with equal ids stay rows of their own;
equal lengths go by id and start; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import map_rows, stored

SEQUENCE = 1024
END = 2
#: Documents whose remainders are packed together. A group leaves about one bin part empty.
GROUP_DOCS = 8_192
#: Words that a Python worker keeps with their ids, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 400_000, 48

PIECES = StructType([
    StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()), StructField("number", LongType()),
])
PACKED = StructType([*PIECES.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])


class Words(dict):
    """Ids of words (as bytes) by the model of a tokenizers file; a word that is not known yet is looked up and kept."""

    def __init__(self, vocabulary: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            kind = json.load(f)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in kind["added_tokens"]}
        plain = not any(t[x] for t in kind["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized"))
        before = kind["pre_tokenizer"] or {}
        #: Words of byte-level vocabularies are independent of each other; any other kind of file goes through the library text by text.
        self.by_word = plain and kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.split, self.words = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None, regex.compile(PATTERN)
        # bytes that are printable stand for themselves, the others for characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printable)))}

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.coder.model.tokenize(word.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids that the library gives with add_special_tokens=False."""
        if not self.by_word:
            return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self) > KEPT_WORDS:
            self.clear()
        parts = self.split.split(text) if self.split and any(t in text for t in self.added) else [text]
        return np.frombuffer(b"".join([self.added[p] if i % 2 else b"".join(map(self.__getitem__, self.words.findall(p))) for i, p in enumerate(parts)]), "<u4")


@lru_cache(1)
def encoder(vocabulary: str) -> Words:
    """One for all tasks of a Python worker."""
    return Words(vocabulary)


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def tokenized(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """The pieces of all documents; number is below zero and every piece's own."""

    def make():
        from pyspark import TaskContext

        encode, mark = encoder(vocabulary).encode, np.array([end], np.uint32)
        state = [-((TaskContext.get().partitionId() + 1) << 32)]

        def one(doc_id, text):
            ids = np.concatenate([encode(text or ""), mark]).astype("<u4")
            out = []
            for k, (start, length) in enumerate(cuts(len(ids), size)):
                state[0] += 1
                out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), state[0]))
            return out

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


def best_fit(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; lengths come in falling order. The tree's leaves are remaining capacities and hold
    whether a bin has that much room; the leftmost occupied leaf at or above a length is the tightest fit."""
    width = 1 << size.bit_length()
    tree = [False] * (2 * width)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, n = [], [], 0
    for length in lengths:
        i, found = width + length, -1
        if tree[i]:
            found = length
        else:
            while i > 1 and not (i & 1 == 0 and tree[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < width:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                found = i - width
        if found < 0:
            b, room, n = n, size, n + 1
        else:
            b, room = rooms[found].pop(), found
            if not rooms[found]:
                mark(tree, width + found, False)
        bins.append(b)
        offsets.append(size - room)
        left = room - length
        if left:
            if not rooms[left]:
                mark(tree, width + left, True)
            rooms[left].append(b)
    return bins, offsets


def mark(tree: list[bool], i: int, on: bool) -> None:
    tree[i] = on
    while i > 1:
        i >>= 1
        up = tree[2 * i] or tree[2 * i + 1]
        if tree[i] == up:
            break
        tree[i] = up


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    """All pieces with their sequence and place in it. sequence_id: below zero for full pieces, else group and bin.
    Pieces are a stored table; only those that share a sequence are shuffled, so that very long documents cost their group one row."""
    pieces = stored(tokenized(docs, vocabulary, size, end), "pieces")
    full, rest = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    groups = max(1, round(rest.count() / group_docs))

    def bins(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "ids_crc32", "number"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        b, o = best_fit(pdf["length"].tolist(), size)
        return pdf.assign(sequence_id=np.array(b, np.int64) + (int(key[0]) << 32), offset=np.array(o, np.int64))[PACKED.names]

    # a piece's number spreads equal rows over the groups too
    key = F.pmod(F.xxhash64("doc_id", "ids_crc32", "number"), F.lit(groups))
    own = full.withColumns({"sequence_id": F.col("number"), "offset": F.lit(0).cast("long")}).select(*PACKED.names)
    return own.unionByName(rest.withColumn("bin_group", key).groupBy("bin_group").applyInPandas(bins, PACKED))
