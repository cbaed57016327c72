"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontaminate, html_text, language, licenses, neighbours, packing, secrets, simhash, toxicity, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_chats(rows, places=False))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), forest).select("doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", F.col("f.at").alias("word"), F.sha2("f.value", 256).alias("value_sha256"), F.length("f.value").cast("long").alias("n_chars"),
                        F.col("f.probability").alias("probability"), (F.col("f.probability") >= secrets.THRESHOLD).alias("secret"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digest(clusters.cluster(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_language, op3_licenses, op4_chat, op5_secrets, op6_simhash, op7_neighbours, op8_html, op9_packing, op10_toxicity, op11_bpe, op12_prefix_trie, op13_ball_kmeans, pipeline)
    return {f.__name__: f for f in ops}


WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_sql() -> str:
    return f"""
WITH b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrase AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
           FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
size AS (SELECT DISTINCT n FROM phrase),
gram AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
         FROM d, size, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
found AS (SELECT r, i, gram.n AS n, item_id FROM gram JOIN phrase ON gram.p = phrase.p AND gram.n = phrase.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found), LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)"""


def op3_sql() -> str:
    quoted = lambda x: "'" + x + "'"
    phrases = ", ".join(f"({quoted(p)}, {quoted(x)})" for p, x in licenses.PHRASES.items())
    templates = ", ".join(f"({quoted(t)}, {quoted(x)})" for t, x in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format('text')} AS w FROM documents),
phrase AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) AS t(p, label)),
template AS (SELECT list_distinct(string_split(p, ' ')) AS p, label FROM (VALUES {templates}) AS t(p, label)),
place AS (SELECT r, i - 1 AS start, label FROM d, phrase, LATERAL (SELECT unnest(range(1, len(w) - len(p) + 2)) AS i) WHERE len(w) >= len(p) AND w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
block AS (SELECT r, b, list_distinct(w[b * {licenses.STRIDE} + 1:b * {licenses.STRIDE} + {licenses.BLOCK}]) AS w
          FROM d, LATERAL (SELECT unnest(range(0, (len(w) - 1) // {licenses.STRIDE} + 1)) AS b) WHERE len(w) > 0),
near AS (SELECT r, label, len(list_intersect(w, p)) / len(p) AS c FROM block, template WHERE len(list_intersect(w, p)) >= ceil({licenses.THRESHOLD} * len(p) - 1e-9)),
best AS (SELECT r, max(c) AS c FROM near GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM near UNION SELECT r, label FROM place) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN every USING (r)"""


def op4_sql() -> str:
    escaped = "replace(text, '\\', '\\\\')"
    for c in chat.CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    fixed = len(chat.START) + 1 + len(chat.END) + 1
    role = escaped.replace("replace(text,", "replace(role,", 1)
    return f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(replace({role}, chr(10), '\\' || chr(10))) + length({escaped})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""


def op12_sql() -> str:
    # crc32 bit by bit: 79764919 reversed is 3988292384
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(s))), lambda c, i:
      CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END) & 1 = 1 THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END) >> 1, 3988292384)
           ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END) >> 1 END), 4294967295)"""
    return rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
dig AS (SELECT conv_id, turn, r, sha256(CAST(length(r) AS VARCHAR) || ':' || r || t) AS g, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM said),
told AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(g ORDER BY turn NULLS FIRST, r, g) AS gs, list(w ORDER BY turn NULLS FIRST, r, g) AS ws FROM dig GROUP BY conv_id),
own AS (SELECT *, CAST({crc} % {trie.HEADS} AS INT) AS h FROM told),
path AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.gs[1:o.h], []), o.gs[o.h + 1:]) AS gs, list_concat(coalesce(b.ws[1:o.h], []), o.ws[o.h + 1:]) AS ws FROM own o LEFT JOIN told b ON b.conv_id = o.conv_id - o.conv_id % {trie.FAMILY}),
step AS (SELECT conv_id, d, gs[1:d] AS g, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, d = len(gs) AS done FROM path, LATERAL (SELECT unnest(range(0, len(gs) + 1)) AS d)),
node AS MATERIALIZED (SELECT d, array_to_string(g, ' ') AS p, any_value(g) AS g, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, bool_and(done) AS childless, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (done), '')) AS e FROM step GROUP BY d, array_to_string(g, ' ')),
below AS (SELECT a AS d, array_to_string(g[1:a], ' ') AS p, sum((n - 1) * w) AS saved, count(*) FILTER (childless) AS leaves, count(*) FILTER (d = a + 1) AS children FROM node, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, children AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.e AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.p = node.p LEFT JOIN node up ON up.d = node.d - 1 AND up.p = array_to_string(node.g[1:node.d - 1], ' ')"""


def op13_sql() -> str:
    n, k = clusters.LENGTH, clusters.CLUSTERS
    parts = []
    for i in range(clusters.ROUNDS + 1):
        if i:
            parts.append(f"""c{i} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{i - 1} c LEFT JOIN
  (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i - 1} JOIN cell USING (r) GROUP BY k, i) m ON m.k = c.k AND m.i = c.i)""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM
  (SELECT r, c.k AS k, CAST(sum((cell.x - c.x) * (cell.x - c.x)) AS BIGINT) AS d FROM cell JOIN c{i} c ON c.i = cell.i GROUP BY r, c.k)) WHERE place = 1)""")
    last = clusters.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}),
cell AS MATERIALIZED (SELECT r, i, q[i] AS x FROM v, LATERAL (SELECT unnest(range(1, {n + 1})) AS i)),
c0 AS MATERIALIZED (SELECT k, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS k FROM v) JOIN cell USING (r) WHERE k < {k}),
{(','+chr(10)).join(parts)},
sums AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM a{last} GROUP BY k),
sha AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{last} GROUP BY k)
SELECT vec_id, CAST(a.k AS INT) AS cluster, a.d AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM sums) AS inertia, h AS centroid_sha256
FROM v JOIN a{last} a USING (r) JOIN sums ON sums.k = a.k JOIN sha ON sha.k = a.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": op1_sql(), "op3_licenses": op3_sql(), "op4_chat": op4_sql(), "op12_prefix_trie": op12_sql(), "op13_ball_kmeans": op13_sql()}
