"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character n-grams (all hashed to buckets), a text is the mean of its words, a
linear softmax reads two classes off it. Misspelt words share n-grams with the words they come from. As all of this is
linear up to the softmax, a trained word is one number (its pull towards class 1), kept in a bounded cache.

Training takes a bounded sample of labelled rows (about `per_class` of each class by a hash of the id, equal labels of an id in proportion to their number;
twice that at most), of which it looks at whole texts; words of over 64 characters are taken apart, not cut; class weights restore the true share of class 1. Scores cover every row and read the text only.

Defined results: null and empty texts get the share of class 1 among the labels; without labels that is 0; rows with equal ids stay rows of
their own; several labels of one id are learned as several examples; a null label or id is not learned from; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import crc_mod, map_rows

BUCKETS = 1 << 20
SIZE = 4
PER_CLASS = 2000
THRESHOLD = 0.3
#: Neutral words (zero vectors) averaged into every text, so that a text of few words is not judged by one of them.
PAD = 40
#: Words kept with their value in a Python worker; the cache starts anew before a text when it is over this.
CACHE = 500_000
#: What is taken off the ends of a word.
ENDS = ".,;:?!\"'()[]{}<>|`*_-"
#: Longer words are taken apart, at signs and then every LONG characters with an overlap.
LONG, OVERLAP, SIGNS = 64, 5, re.compile(r"[\W_]+")
#: Values of words by model, for all tasks of a Python worker.
KNOWN: dict[str, dict[str, float]] = {}


def word_of(token: str) -> str:
    return token.strip(ENDS)


def tokens_of(text: str) -> list[str]:
    """The text's white-space words; those over LONG characters are split at signs, and what is still longer (scripts without
    spaces) into pieces that overlap by OVERLAP, so that every n-gram counts."""
    tokens = text.lower().split()
    if all(len(t) <= LONG for t in tokens):
        return tokens
    out = []
    for t in tokens:
        if len(t) <= LONG or len(word_of(t)) <= LONG:
            out.append(t)
            continue
        for part in SIGNS.split(t):
            if part:
                out += [part[i : i + LONG] for i in range(0, max(1, len(part) - OVERLAP), LONG - OVERLAP)]
    return out


def grams(words: list[str], low: int = 3, high: int = 5, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, and whose each is. Hashes of code points, for all words at once, so
    that every machine agrees; buckets is a power of two."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    whose = np.repeat(np.arange(len(marked)), size)
    start = np.r_[0, np.cumsum(size)[:-1]]
    with np.errstate(over="ignore"):
        place = (np.arange(len(code)) - start[whose]).astype(np.uint32)
        found, own = [np.add.reduceat((code ^ np.uint32(0x9E3779B9)) * (place * np.uint32(2654435761) | np.uint32(1)), start)], [np.arange(len(marked))]
        for k in range(low, high + 1):
            n = len(code) - k + 1
            if n < 1:
                break
            inside = np.flatnonzero(whose[:n] == whose[k - 1 :])
            h = np.full(len(inside), 2166136261 + k, np.uint32)
            for j in range(k):
                h = (h ^ code[inside + j]) * np.uint32(16777619)
            found.append(h)
            own.append(whose[inside])
        h = np.concatenate(found)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        h ^= h >> np.uint32(13)
    return (h & np.uint32(buckets - 1)).astype(np.int64), np.concatenate(own)


class Model:
    """pull: a bucket's pull towards class 1 (vector times softmax difference); bias; share: of class 1 in the labels."""

    def __init__(self, pull: np.ndarray, bias: float, share: float, scale: float):
        self.pull, self.bias, self.share, self.scale, self.name = pull, bias, share, scale, uuid.uuid4().hex

    def word(self, w: str) -> float:
        return float(self.words([w])[0]) if w else 0.0

    def words(self, words: list[str]) -> np.ndarray:
        bucket, whose = grams(words, buckets=len(self.pull))
        return np.bincount(whose, self.pull[bucket], len(words)) / np.bincount(whose, minlength=len(words))


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, share: float, steps: int = 500, size: int = SIZE, rate: float = 0.5, buckets: int = BUCKETS,
          decay: float = 1e-2) -> Model:
    """Joint training of vectors and softmax by AdaGrad on whole-text gradients, in random order, in batches. All words of the texts are learned."""
    rng = np.random.default_rng(11)
    bags = []
    for t in texts:
        bag: dict[str, int] = {}
        for token in tokens_of(t):
            w = word_of(token)
            bag[w] = bag.get(w, 0) + 1
        bags.append(bag)
    number = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag if w}))}
    flat, whose = grams(list(number), buckets=buckets) if number else (np.empty(0, np.int64), np.empty(0, np.int64))
    flat = flat[np.argsort(whose, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(whose, minlength=len(number)))].astype(np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    share_of = 1 / np.repeat(np.diff(start), np.diff(start))
    rows = []
    for bag in bags:
        ids = np.array([number[w] for w in bag if w in number], np.int64)
        n = np.array([c for w, c in bag.items() if w in number], np.float64)
        rows.append((ids, n / (PAD + sum(bag.values()))))
    emb = rng.uniform(-1e-3, 1e-3, (len(used), size))
    out = rng.normal(0, 0.1, (size, 2))
    bias = np.log(np.array([max(1 - share, 1e-6), max(share, 1e-6)]))
    # texts are long and mean signals small: vectors are read at a larger scale, the same for every text
    scale = 30.0
    at = np.zeros(len(used), np.int64)
    g_emb, g_out, g_bias = np.full(len(used), 1e-6), np.full(out.shape, 1e-6), np.full(2, 1e-6)
    step = 64
    epochs = -(-steps // max(1, len(rows) // step))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        # word vectors for this epoch's batches are gathered batch by batch from the bucket table
        for b in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // step)):
            ids, inverse = np.unique(np.concatenate([rows[i][0] for i in b]), return_inverse=True)
            if not len(ids):
                continue
            lens = start[ids + 1] - start[ids]
            pos = np.repeat(start[ids] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            bucket, part = flat[pos], share_of[pos][:, None]
            vec = np.add.reduceat(emb[bucket] * part, np.r_[0, np.cumsum(lens)[:-1]], axis=0)
            of = np.repeat(np.arange(len(b)), [len(rows[i][0]) for i in b])
            w = np.concatenate([rows[i][1] for i in b])[:, None] * scale
            hidden = np.zeros((len(b), size))
            edges = np.r_[0, np.cumsum([len(rows[i][0]) for i in b])[:-1]]
            full = np.flatnonzero([len(rows[i][0]) > 0 for i in b])
            hidden[full] = np.add.reduceat(vec[inverse] * w, edges[full], axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[b][:, None] / len(b)
            d_hidden, d_out, d_bias = p @ out.T, hidden.T @ p, p.sum(0)
            part_of = d_hidden[of] * w
            d_vec = np.stack([np.bincount(inverse, part_of[:, k], len(ids)) for k in range(size)], axis=1)
            touched = np.flatnonzero(np.bincount(bucket, minlength=len(used)))
            at[touched] = np.arange(len(touched))
            place = at[bucket]
            spread = np.repeat(d_vec, lens, axis=0) * part
            d = np.stack([np.bincount(place, spread[:, k], len(touched)) for k in range(size)], axis=1)
            g_emb[touched] += (d * d).mean(1)
            emb[touched] *= 1 - lr * decay
            emb[touched] -= lr * 0.3 * d / np.sqrt(g_emb[touched])[:, None]
            g_out += d_out * d_out
            out -= lr * 0.3 * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias -= lr * 0.1 * d_bias / np.sqrt(g_bias)
    pull = np.zeros(buckets)
    pull[used] = emb @ (out[:, 1] - out[:, 0])
    return Model(pull, float(bias[1] - bias[0]), share, scale)


def fit(docs: DataFrame, labels: DataFrame, learn=None, text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Model of the labelled rows; learn: a condition on doc_id for the rows to learn from. None without labels."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known if learn is None else known.where(learn)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return None
    share = counts.get(1, 0) / sum(counts.values())
    part = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, counts.get(0, 0)))))
    # equal labels of one id are counted first, so that an id with very many of them gives its share and not all of them
    of_id = known.groupBy("doc_id", "y").agg(F.count("*").alias("n"))
    copies = F.ceil(F.col("n") * part - F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).cast("int")
    drawn = of_id.withColumn("k", copies).where("k > 0").select("doc_id", "y", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"))
    # at most twice per_class rows of each class: the bound of the sample, whatever the table, also where documents share an id
    whole = docs.select("doc_id", F.col(text_col).alias("text")).where("text is not null")
    order = F.xxhash64(F.lit("order"), "doc_id", "text", "k")
    rows = [r for c in (0, 1) for r in whole.join(F.broadcast(drawn.where(F.col("y") == c)), "doc_id").orderBy(order).limit(2 * per_class).select("doc_id", "text", "y").collect()]
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    y = np.array([r["y"] for r in rows])
    drawn_share = y.mean()
    weight = np.where(y == 1, share / max(drawn_share, 1e-9), (1 - share) / max(1 - drawn_share, 1e-9))
    return train([r["text"] for r in rows], y, weight, share)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep and the score of every row."""
    names = [*keep, id_col]
    schema = StructType([*[docs.schema[c] for c in names], StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        if m is not None and m.name not in KNOWN:
            KNOWN.clear()
            KNOWN[m.name] = {}
        known = KNOWN[m.name] if m is not None else {}

        def one(text, *rest):
            if m is None:
                return [(*rest, 0.0)]
            tokens = tokens_of(text) if text else ()
            if not tokens:
                return [(*rest, m.share)]
            if len(known) > CACHE:
                known.clear()
            if new := [t for t in set(tokens) if t not in known]:
                stripped = [word_of(t) for t in new]
                known.update(zip(new, np.where([w != "" for w in stripped], m.words(stripped), 0.0).tolist(), strict=True))
            z = m.bias + m.scale * sum(map(known.__getitem__, tokens)) / (PAD + len(tokens))
            return [(*rest, 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))]

        return one

    return map_rows(docs.select(F.col(text_col), *names), make, schema)


def assess(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from the labels outside the held-out fold of crc32(doc_id) and scores all rows."""
    model = fit(docs, labels, crc_mod(F.col("doc_id"), folds) != held)
    return score(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
