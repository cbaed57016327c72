"""The corpus pipeline: language ID, near-duplicates, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents, the last
one the packed pieces. run() applies them to `documents`, each stage's result written as a table and read again.

Decisions: a document without a recognisable language goes, and one that the classifier is less than MIN_SCORE sure of; of each group of near-duplicates (links: 0.8 of the distinct
5-word shingles in common, compared exactly) the document with the smallest id stays (rows without an id stay; rows that share an id share its fate, and equal ones
stay once); a document with any benchmark window goes; secrets are masked in
the text, no document goes for them; all that is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm import decontaminate, language, packing, secrets, simhash
from frameflow.llm.common import forget, positional, stored, temporary

#: A duel that is lost or even has 0.5 at most; two duels one after the other multiply.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    seen = language.predict(positional(docs), language.fit(docs), id_col=own["doc_id"], text_col=own["text"], keep=tuple(x for c, x in own.items() if c != "doc_id"))
    sure = seen.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return sure.select(*[F.col(x).alias(c) for c, x in own.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = simhash.near_groups(docs)
    gone = ids.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates()
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by id and text, so that rows without an id and rows that share one get their own verdict
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    with temporary():
        found = decontaminate.decontaminate(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        bad = stored(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("key")).distinct(), "contaminated", keep=True)
    names, plain = docs.columns, positional(docs)
    own = F.xxhash64(*[f"c{names.index(c)}" for c in ("doc_id", "text")])
    # only texts that share a slot with a contaminated one are moved to be compared by their key
    slot = F.pmod(F.col("key"), F.lit(simhash.SLOTS)).cast("int").alias("slot")
    keyed, slots = plain.withColumn("key", own).select("*", slot), F.broadcast(bad.select(slot).distinct())
    left = keyed.join(slots, "slot", "left_anti").select(*plain.columns)
    left = left.unionByName(keyed.join(slots, "slot", "left_semi").join(bad, "key", "left_anti").select(*plain.columns))
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.train(secrets.findings(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", identify_language), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secret scan", mask_secrets), ("packing", pack_sequences)]

#: The stages learn models and sketch texts, which SQL can't express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with temporary():
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
        if before is not None:
            forget(before)
        before = docs
    return docs
