"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A text is cut into chunks where a rolling hash over its last 32 characters has `BITS` zero bits, so that passages which documents share fall into equal
chunks wherever they stand. The chunks that occur most often over the whole table (exact counts) are gathered, encoded once as a Spark job and sent to
all tasks: at most SHARED chunks of at most LONGEST characters, so that their size has a bound whatever the input. Any other chunk is encoded where it
stands and kept by its Python worker for the next documents. Chunks are looked up by their text, never by a hash, so reuse can't change a result.

A chunk's last words may look different with what follows them, and so may the next chunk's first. At each join the last words of a chunk that lie
within REACH characters of its end are taken back, and words are encoded again from there until a word ends where a word of the next chunk begins. The
word pattern looks at most two characters past a word and never back, so from that place on both agree in every word, up to the next join. A word longer
than a chunk runs on through as many chunks as it needs. Added tokens of the file split a text before it is cut.

Defined results: a null text is empty and has no ids; rows with equal ids stay rows of their own; an empty table gives an empty result; only the named
columns are read. Files of another kind than byte-level go through the library text by text.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import map_rows
from .packing import KEPT_WORDS, Words, encoder

#: A chunk ends where this many bits of the rolling hash are zero, but not before SHORTEST and not after LONGEST characters.
BITS, SHORTEST, LONGEST = 8, 128, 2_048
#: Chunks that are encoded once for the whole table, and chunks that a Python worker keeps beside them.
SHARED, KEPT = 8_192, 8_192
#: Characters at a chunk's end within which a word may depend on what follows.
REACH = 3
#: Words at either end of a chunk whose places are kept; a join that needs more of them encodes on to the next one.
FIRST, LAST = 12, 6
#: Characters that are hashed at a time, so that a long text needs no large arrays.
BLOCK = 1 << 20
WINDOW = 32

ENCODED = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
DECODED = StructType([*ENCODED.fields, StructField("decoded", StringType())])
COUNTS = StructType([StructField("key", LongType()), StructField("n", LongType()), StructField("chars", LongType())])
GATHERED = StructType([StructField("key", LongType()), StructField("chunk", StringType())])
CHUNKS = StructType([StructField("chunk", StringType()), StructField("ends", BinaryType()), StructField("marks", BinaryType()), StructField("ids", BinaryType())])


class Chunk(NamedTuple):
    """Ids of a chunk (4 bytes each) with the ends of its first and last words, in characters and in bytes of ids."""

    ends: array
    marks: array
    ids: bytes


def rolling(text: str) -> np.ndarray:
    """A hash of the last 32 characters at each place, by doubling: five passes whatever the window."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4") * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    w = 1
    while w < WINDOW:
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return h


def cuts(text: str) -> list[int]:
    """Ends of the chunks."""
    out, last = [], 0
    for start in range(0, len(text), BLOCK):
        before = min(start, WINDOW - 1)
        h = rolling(text[start - before : start + BLOCK])[before:]
        for c in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + (start + 1)).tolist():
            while c - last > LONGEST:
                last += LONGEST
                out.append(last)
            if c - last >= SHORTEST:
                last = c
                out.append(last)
    while len(text) - last > LONGEST:
        last += LONGEST
        out.append(last)
    if last < len(text):
        out.append(len(text))
    return out


def pieces(words: Words, text: str) -> Iterator[tuple[str, list[int]]]:
    """The parts of a text between added tokens, with their chunks' ends; an added token itself has none."""
    parts = words.split.split(text) if words.split and any(t in text for t in words.added) else [text]
    for i, part in enumerate(parts):
        yield part, [] if i % 2 else cuts(part)


def encode_chunk(words: Words, chunk: str) -> Chunk:
    if len(words) > KEPT_WORDS:
        words.clear()
    found = words.words.findall(chunk)
    each = list(map(words.__getitem__, found))
    ids = b"".join(each)
    ends, marks = array("I", accumulate(map(len, found[:FIRST]))), array("I", accumulate(map(len, each[:FIRST])))
    last = max(FIRST, len(found) - LAST)
    if last < len(found):
        ends.extend(list(accumulate(map(len, found[last:]), initial=len(chunk) - sum(map(len, found[last:]))))[1:])
        marks.extend(list(accumulate(map(len, each[last:]), initial=len(ids) - sum(map(len, each[last:]))))[1:])
    return Chunk(ends, marks, ids)


def joined(words: Words, text: str, ends: list[int], chunk_of: Callable[[str], Chunk]) -> list[bytes]:
    """Ids of a part from those of its chunks. at: the place up to which words are sure."""
    out: list[bytes] = []
    at = start = 0
    for end in ends:
        if at < end:
            c = chunk_of(text[start:end])
            k = 0
            while at != start and at < end:
                if at > start:
                    k = bisect_left(c.ends, at - start)
                    if c.ends[k] == at - start:
                        k += 1
                        break
                m = words.words.match(text, at)
                out.append(words[m.group()])
                at = m.end()
            if at < end:
                k = 0 if at == start else k
                j = len(c.ends) if end == len(text) else bisect_right(c.ends, end - start - REACH)
                if j > k:
                    out.append(c.ids[c.marks[k - 1] if k else 0 : c.marks[j - 1]])
                    at = start + c.ends[j - 1]
        start = end
    return out


class Coder:
    """Encodes whole texts with the shared chunks and those that this worker has met. encoded counts the chunks that were not reused."""

    def __init__(self, words: Words, shared: dict[str, Chunk]):
        self.words, self.shared, self.own, self.encoded, self.met = words, shared, {}, 0, 0

    def chunk(self, text: str) -> Chunk:
        self.met += 1
        c = self.shared.get(text) or self.own.get(text)
        if c is None:
            c = encode_chunk(self.words, text)
            self.encoded += 1
            if len(self.own) >= KEPT:
                self.own.clear()
            self.own[text] = c
        return c

    def encode(self, text: str) -> bytes:
        """The ids that the library gives with add_special_tokens=False, as little-endian unsigned 32-bit integers."""
        if not self.words.by_word:
            return self.words.encode(text).tobytes()
        out: list[bytes] = []
        for i, (part, ends) in enumerate(pieces(self.words, text)):
            out += [self.words.added[part]] if i % 2 else joined(self.words, part, ends, self.chunk)
        return b"".join(out)


def chunk_texts(words: Words, text: str) -> Iterator[str]:
    for part, ends in pieces(words, text):
        start = 0
        for end in ends:
            yield part[start:end]
            start = end


def chunk_key(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode()) - (1 << 63)


def shared_chunks(docs: DataFrame, vocabulary: str, most: int = SHARED, text_col: str = "text") -> dict[str, Chunk]:
    """The chunks worth encoding once: those whose repetitions hold most characters, over all documents. Counts are summed in tasks before the shuffle;
    what comes to the driver is `most` keys and `most` encoded chunks."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))

    def count():
        words = encoder(vocabulary)

        def one(text):
            n = Counter(chunk_texts(words, text))
            return [(chunk_key(c), k, len(c)) for c, k in n.items()]

        return one

    counts = map_rows(texts, count, COUNTS).groupBy("key").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    best = counts.where("n > 1").orderBy(F.desc((F.col("n") - 1) * F.col("chars")), "key").limit(most).select("key").collect()
    if not best:
        return {}
    wanted = spark.sparkContext.broadcast(frozenset(r["key"] for r in best))

    def gather():
        words, left = encoder(vocabulary), set(wanted.value)

        def one(text):
            out = []
            for c in chunk_texts(words, text):
                k = chunk_key(c)
                if k in left:
                    left.discard(k)
                    out.append((k, c))
            return out

        return one

    def encode():
        words = encoder(vocabulary)

        def one(chunk):
            c = encode_chunk(words, chunk)
            return [(chunk, c.ends.tobytes(), c.marks.tobytes(), c.ids)]

        return one

    # two chunks of one key: the smaller text is shared, the other one is encoded where it stands
    once = map_rows(texts, gather, GATHERED).groupBy("key").agg(F.min("chunk").alias("chunk")).select("chunk")
    rows = map_rows(once, encode, CHUNKS).collect()
    return {r["chunk"]: Chunk(array("I", bytes(r["ends"])), array("I", bytes(r["marks"])), bytes(r["ids"])) for r in rows}


def encode(docs: DataFrame, vocabulary: str, shared: dict[str, Chunk] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text. Texts are read where they are and never shuffled."""
    if shared is None:
        shared = shared_chunks(docs, vocabulary, text_col=text_col) if encoder(vocabulary).by_word else {}
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def make():
        coder = Coder(encoder(vocabulary), sent.value)

        def one(doc_id, text):
            ids = coder.encode(text or "")
            return [(doc_id, len(ids) // 4, ids)]

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, ENCODED, chunk=256)


@lru_cache(1)
def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    words = encoder(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        kind = json.load(f)
    back = {chr(c): b for b, c in words.letters.items()}
    strings = {i: t for t, i in kind["model"]["vocab"].items()} | {t["id"]: t["content"] for t in kind["added_tokens"]}
    plain = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return [plain(strings.get(i, "")) for i in range(max(strings) + 1)]


def decode_ids(vocabulary: str, ids: bytes) -> str:
    """The text that the library gives with skip_special_tokens=False."""
    if not encoder(vocabulary).by_word:
        return encoder(vocabulary).coder.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    return b"".join(map(token_bytes(vocabulary).__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encode()'s rows with the text that their ids stand for."""

    def make():
        return lambda doc_id, n, ids: [(doc_id, n, ids, decode_ids(vocabulary, ids))]

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), make, DECODED, chunk=256)
