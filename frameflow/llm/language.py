"""Language identification by hierarchical discrimination: family first, then one-versus-one linear support vector
machines between the languages of that family.

Features are relative frequencies of hashed runs of one to three characters over the whole text (letters lower-cased, all
else one space). Every machine is linear, so a text's margin is the mean of its runs' weights: one lookup a run.

The machines are fitted in numpy on a bounded sample of labelled rows (about `per_language` of each language, and no more than
`max_rows` in all, chosen by a hash of id and text; of more than `max_languages` values of lang the most frequent are learned). Prediction covers every
row and reads the text only.

Defined results: a null text or one without letters is `und` with score 0; where nothing was learned, every text is; rows
with equal ids stay rows of their own; a null id is never held out and never learned from; ties between languages go to the first in
alphabetical order; extra columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from .common import crc_mod, map_rows

UNDETERMINED = "und"
BITS = 14
PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES = 350, 1500, 200
#: Characters taken at a time; runs across a border are kept.
PART = 400_000
#: Language families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la lad oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa si ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "uralic": "et fi hu se",
    "celtic": "br cy ga gd gv",
    "sinitic": "wuu yue zh",
    "austronesian": "id jv mg mi ms sm su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(language: str) -> str:
    return FAMILY_OF.get(language.split("-")[0].lower(), language)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point 2 for a letter (category L), 1 for a mark (part of a word, but no letter by itself), else 0. Made once in a Python worker."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def runs(text: str, letter: np.ndarray, bits: int = BITS):
    """Bucket numbers of the runs of 1 to 3 characters, part by part; empty arrays where a part has no letter."""
    tail = np.full(2, 32, np.uint32)
    for a in range(0, len(text), PART):
        c = np.frombuffer(text[a : a + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letter[c]
        ok = kind > 0
        c = np.where(ok, c, np.uint32(32))
        c = c[ok | np.r_[tail[-1] != 32, ok[:-1]]]
        has = bool((kind == 2).any())
        c = np.concatenate([tail, c])
        if a + PART >= len(text) and c[-1] != 32:
            c = np.append(c, np.uint32(32))
        x, y, z = c[:-2], c[1:-1], c[2:]
        one = z * np.uint32(2654435761)
        two = (y * np.uint32(2246822519) + one) * np.uint32(3266489917)
        three = (x * np.uint32(668265263) + two) * np.uint32(374761393)
        tail = c[-2:]
        s = np.uint32(32 - bits)
        yield has, (one >> s, two >> s, three >> s)


def svm(kernel: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Dual coordinate descent for the linear machine with squared hinge loss; the rows' coefficients."""
    n = len(y)
    alpha, f = np.zeros(n), np.zeros(n)
    q = np.diag(kernel) + 1 / (2 * c)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * f[i] - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                f += kernel[i] * ((new - alpha[i]) * y[i])
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return alpha * y


class Model:
    """weights: bucket x machine; bias: per machine; machines: (left, right) names, left wins above zero."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, machines: list[tuple[str, str]]):
        self.languages, self.weights, self.bias, self.machines = languages, weights, bias, machines
        self.families: dict[str, list[str]] = {}
        for x in languages:
            self.families.setdefault(family(x), []).append(x)

    def choose(self, among: list[str], margins: dict) -> tuple[str, float]:
        """The one that wins most duels (then by its weakest duel), and the sigmoid of that weakest duel."""
        best = ("", -1, -1.0)
        for a in among:
            sure = [1 / (1 + np.exp(-np.clip(3 * margins[a, b], -40, 40))) for b in among if b != a]
            rank = (sum(s > 0.5 for s in sure), min(sure, default=1.0))
            if rank > best[1:]:
                best = (a, *rank)
        return best[0], float(best[2])

    def decide(self, means: np.ndarray) -> tuple[str, float]:
        values = means + self.bias
        margins = {}
        for (a, b), v in zip(self.machines, values, strict=True):
            margins[a, b], margins[b, a] = v, -v
        group, p = self.choose(sorted(self.families), margins) if len(self.families) > 1 else (next(iter(self.families)), 1.0)
        language, q = self.choose(self.families[group], margins)
        return language, p * q


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_cols: tuple[str, ...] = ("doc_id",), bits: int = BITS,
        per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """The machines, from a bounded sample of rows with a language; None where there is no such row."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("sample"), *key_cols, F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    # different rows are counted, as equal ones are drawn all or none
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.approx_count_distinct(draw).alias("n")).orderBy(F.desc("n"), "l").limit(max_languages).collect()}
    if not counts:
        return None
    each = min(per_language, max(1, max_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    schema = StructType([StructField("lang", StringType()), StructField("at", BinaryType()), StructField("value", BinaryType())])

    def make():
        letter = letters()

        def one(lang, text):
            total, any_letter = np.zeros(1 << bits), False
            for has, three in runs(text, letter, bits):
                any_letter |= has
                for h in three:
                    total += np.bincount(h, minlength=1 << bits)
            at = np.flatnonzero(total)
            return [(lang, at.astype("<i4").tobytes(), (total[at] / total.sum()).astype("<f4").tobytes())] if any_letter else []

        return one

    drawn = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (draw / share[F.col(lang_col)]).alias("place"))
    sample = map_rows(drawn.orderBy("place", "lang", "text").limit(max_rows).repartition(8, "place").select("lang", "text"), make, schema, 64).collect()
    if not sample:
        return None
    # buffers and no lists: the driver holds 8 bytes for each bucket of a text
    sample.sort(key=lambda r: (r["lang"], len(r["at"]), np.frombuffer(r["at"], "<i4")[:8].tolist()))
    x = np.zeros((len(sample), 1 << bits), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    langs = np.array([r["lang"] for r in sample])
    del sample
    centre = x.mean(0)
    x -= centre
    scale = 1 / max(1e-9, float(np.sqrt((x * x).sum(1).mean())))
    x *= scale
    kernel = (x @ x.T).astype(np.float64) + 1
    languages = sorted(set(langs))
    groups = np.array([family(v) for v in langs])
    duels = [(a, b, groups) for a, b in combinations(sorted(set(groups)), 2)]
    duels += [(a, b, langs) for a, b in combinations(languages, 2) if family(a) == family(b)]
    weights, bias, machines = np.zeros((1 << bits, len(duels)), np.float32), np.zeros(len(duels)), []
    for k, (a, b, of) in enumerate(duels):
        take = np.flatnonzero((of == a) | (of == b))
        coef = svm(kernel[np.ix_(take, take)], np.where(of[take] == a, 1.0, -1.0))
        w = (coef.astype(np.float32) @ x[take]) * scale
        weights[:, k], bias[k] = w, coef.sum() - float(w @ centre)
        machines.append((a, b))
    return Model(languages, weights, bias, machines)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, lang_pred and score for every row."""
    names = [*keep, id_col]
    kinds = [docs.schema[c] for c in names]
    schema = StructType([*kinds, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        letter, m = letters(), sent.value
        bits = int(len(m.weights)).bit_length() - 1 if m else BITS

        def one(text, *rest):
            if not text or m is None:
                return [(*rest, UNDETERMINED, 0.0)]
            total, n, any_letter = np.zeros(m.weights.shape[1]), 0, False
            for has, three in runs(text, letter, bits):
                any_letter |= has
                if total.size:
                    for h in three:
                        total += m.weights.take(h, axis=0).sum(0, dtype=np.float64)
                n += 3 * len(three[0])
            if not any_letter:
                return [(*rest, UNDETERMINED, 0.0)]
            language, score = m.decide(total / max(1, n))
            return [(*rest, language, min(1.0, max(0.0, score)))]

        return one

    return map_rows(docs.select(F.col(text_col), *names), make, schema)


def identify(docs: DataFrame, folds: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the rows outside fold 0 of crc32(doc_id) and predicts all rows."""
    fold = crc_mod(F.col("doc_id"), folds)
    model = fit(docs.where(fold != 0))
    out = predict(docs, model, keep=keep)
    return out.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)))
