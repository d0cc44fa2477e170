"""Registered queries of the training-data operators: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import (decontaminate, exact, lm, mixing, negatives, ngram_join, packing, passages, pii, quality, repair, toxicity,
                            urls)
from corpuscope.llm.tables import table


def crc_remainder(column: str, parts: int):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Rules:
    """Rules learned from the labels that are not held out."""
    learned = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_remainder("doc_id", 5) != 0)
    return quality.fit_quality(docs, learned)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_remainder("doc_id", 4) != 2)
    lexicon = toxicity.learn_lexicon(docs, learned)
    return toxicity.toxicity_scores(docs, lexicon).select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_matches", "n_words")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT FROM documents) AS part
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sizes),
sums AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT AS remaining,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open
  FROM ranked
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, remaining::DOUBLE / open >= (3 * source_size)::DOUBLE / weight AS capped FROM sums),
level AS (SELECT remaining, open FROM capped WHERE NOT capped ORDER BY open DESC LIMIT 1),
rates AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE
              ELSE (weight * (SELECT remaining FROM level))::DOUBLE / (SELECT open FROM level) END AS target,
         ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM capped),
placed AS (
  SELECT b.*, source_size, target, shift, coalesce(target / nullif(source_size, 0)::DOUBLE, 0.0::DOUBLE) AS rate,
         row_number() OVER (PARTITION BY b.source ORDER BY size, part, doc_id NULLS LAST) AS place
  FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),
counted AS (
  SELECT *, (floor(rate) + floor((rate - floor(rate)) * place + shift)
             - floor((rate - floor(rate)) * (place - 1) + shift))::BIGINT AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM counted
"""

def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i0, i0 + k - 1), ' ') AS win
       FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i0
             FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i0, k, array_to_string(list_slice(ws, i0, i0 + k - 1), ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i0
             FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
m AS (SELECT doc_id, i0, k, item_id FROM dw JOIN iw USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(generate_series(i0, i0 + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i0, k FROM m)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i0, i0 + k - 1), ' ') AS gram
      FROM (SELECT doc_id, ws, least(4, len(ws)) AS k, unnest(generate_series(1, len(ws) - least(4, len(ws)) + 1)) AS i0
            FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, lowest), doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS lowest FROM reach GROUP BY 1) USING (doc_id)
"""

def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.fit_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda s: s == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.lm_scores(docs, lm.train(docs, lm.vocabulary(docs)))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double"))))
    vectors = rows.select("vec_id", moved.alias("label"), whole.alias("embedding"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 3
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations")), dropped_col="dropped")


# Places: 0 nothing yet, 1 after s, 2 after u, 3 after a. `ins` are inserts before a row, `op` what is done with the row.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS f
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, range(2) r(k) WHERE f <> 0 AND (k = 0 OR f = 3)),
firsts AS (
  SELECT *, rtrim(text, E' 	

') AS shown,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen
  FROM damaged),
r AS (
  SELECT *, row_number() OVER o AS i, lag(role[1]) OVER o || role[1] AS pair,
         CASE WHEN shown = '' THEN 1 WHEN seen > 1 THEN 2 WHEN shown[-1] IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault
  FROM firsts WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id),
ins(f, t, cost, letters, said) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
op(f, t, cost, letter, initial, role) AS (VALUES
  (0, 0, 2, 'D', NULL, NULL), (1, 1, 2, 'D', NULL, NULL), (2, 2, 2, 'D', NULL, NULL), (3, 3, 2, 'D', NULL, NULL),
  (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL), (3, 2, 0, 'K', 'u', NULL),
  (0, 2, 1, 'R', NULL, 'user'), (1, 2, 1, 'R', NULL, 'user'), (2, 3, 1, 'R', NULL, 'assistant'), (3, 2, 1, 'R', NULL, 'user')),
move AS (SELECT ins.f, op.t, ins.cost + op.cost AS cost, letters || letter AS letters, said, letter, initial, role, ins.t AS at
         FROM ins JOIN op ON op.f = ins.t),
dp(conv_id, i, place, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'said': ''} FROM facts
  UNION ALL
  SELECT dp.conv_id, r.i, m.t, min({
    'cost': best.cost + m.cost + CASE WHEN m.letter <> 'D' AND fault = 3 THEN 5 ELSE 0 END,
    'audit': best.audit || m.letters,
    'said': best.said || m.said || CASE WHEN m.letter = 'D' THEN '' ELSE
            CASE WHEN m.at = 0 THEN '' ELSE chr(10) END || coalesce(m.role, r.role) || ':' || r.text END})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
          JOIN move m ON m.f = dp.place AND (m.letter = 'D' OR fault NOT IN (1, 2) AND (m.initial IS NULL OR m.initial = r.role[1]))
  GROUP BY dp.conv_id, r.i, m.t),
ended AS (
  SELECT dp.conv_id, min({'cost': best.cost + ins.cost, 'audit': best.audit || letters, 'said': best.said || ins.said}) AS best
  FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i JOIN ins ON ins.f = place AND ins.t IN (0, 3)
  GROUP BY dp.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


QUERIES = {
    "op1_passages": (op1_passages, None),
    "op2_quality": (op2_quality, None),
    "op3_mix_sources": (op3_mix_sources, OP3_SQL),
    "op4_ngram_join": (op4_ngram_join, OP4_SQL),
    "op5_decontaminate": (op5_decontaminate, OP5_SQL),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_urls": (op7_urls, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_personal_data": (op9_personal_data, None),
    "op10_lm_scores": (op10_lm_scores, None),
    "op11_packing": (op11_packing, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_conversation_repair": (op13_conversation_repair, OP13_SQL),
}
