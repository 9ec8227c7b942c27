"""The registered queries of the training-data operators."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm.common import small_frames, table
from arterial.llm.covertree import TOP_K_SQL, top_k_products
from arterial.llm.mixing import mix_to_targets
from arterial.llm.mixlm import mix_scores
from arterial.llm.neardup import NEAR_SQL, near_duplicates
from arterial.llm.pieces import encode_checked
from arterial.llm.rules import apply_rules, fit_quality_rules
from arterial.llm.secretscan import scan_secrets
from arterial.llm.sharding import histogram_shards
from arterial.llm.surrogates import replace_entities
from arterial.llm.toxicity import fit_toxicity, score_toxicity

#: The setting that names the key of surrogates; under one key, runs agree.
SURROGATE_KEY = "spark.arterial.surrogateKey"
#: The public vocabulary that op6 and the pipeline encode with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates, under the session's key, or
    one that is drawn for this run and thrown away."""
    key = spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(32)
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and mixing-model log probabilities of every document."""
    small_frames(spark)
    return mix_scores(table(spark, sf_dir, "documents"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the learned rules."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_quality_rules(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate texts of every document; its smallest id is kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    encoded = encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return encoded.select("doc_id", "n_pieces", "n_byte_pieces", "exact", "ids")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document and those linked from parts."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and taken words of every document."""
    mixed = mix_to_targets(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3, seed=17)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal bytes."""
    placed = histogram_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every query vector."""
    return top_k_products(table(spark, sf_dir, "embeddings"), k=5, every=50)


def base_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of every document without its model: the columns that SQL can express."""
    found = op2_lmscore(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 says of every document without its rules."""
    return op3_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base secrets op7 finds in every document."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op8."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_lmscore": op2_lmscore,
    "op3_rules": op3_rules,
    "op4_toxicity": op4_toxicity,
    "op5_neardup": op5_neardup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "base_lmscore": base_lmscore,
    "base_rules": base_rules,
    "base_secrets": base_secrets,
    "base_mixing": base_mixing,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text by its definition, bit by bit."""
    step = "z"
    for _ in range(8):
        step = f"[CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END for y in [{step}]][1]"
    codes = f"[CAST(ascii(ch) AS BIGINT) for ch in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: [{step} for z in [xor(a, b)]][1]), 4294967295)"


LM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 1, false) AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT (SELECT coalesce(sum(c), 0) FROM c) AS words, (SELECT count(*) FROM c) AS v, (SELECT count(*) FROM d WHERE NOT held_out) AS ends),
f AS (SELECT ends, words + ends AS n, CAST(words + ends AS DOUBLE) + (v + CASE WHEN ends > 0 THEN 1 ELSE 0 END + 1) / 2.0 AS den FROM s),
b AS (SELECT doc_id, count(c) AS known, sum(log10((coalesce(c, 0) + 0.5) / den)) AS lp FROM t LEFT JOIN c USING (w), f GROUP BY doc_id)
SELECT d.doc_id, held_out, CAST(len(w) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + CASE WHEN ends > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens,
  round(coalesce(lp, 0) + log10((ends + 0.5) / den), 4) AS base_score
FROM d LEFT JOIN b USING (doc_id), f
"""

RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7)),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM g JOIN r USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(p.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)
"""

SECRETS_SQL = r"""
SELECT doc_id,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) if length(x) >= 6]) AS BIGINT) AS n_assign,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') if length(x) >= 20]) AS BIGINT) AS n_access,
  CAST(len([x for x in regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') if length(x) >= 24]) AS BIGINT) AS n_hex
FROM documents
"""


def _levels(rounds: int) -> str:
    """Water levels over sources not yet clamped; a level only rises, so a few more rounds change nothing."""
    first = "l0 AS (SELECT sum(z) / sum(w) AS level FROM s WHERE z > 0)"
    return ", ".join([first, *(f"l{k} AS (SELECT coalesce(max(level), 0) AS level FROM (SELECT level FROM l{k - 1} UNION ALL SELECT ((SELECT sum(z) FROM s) - sum(CASE WHEN 3 * z <= w * level THEN 3 * z ELSE 0 END)) / nullif(sum(CASE WHEN 3 * z <= w * level THEN 0 ELSE w END), 0) FROM s, l{k - 1}))" for k in range(1, rounds))])


MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, z, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM (SELECT source, CAST(sum(size) AS DOUBLE) AS z FROM d GROUP BY source)),
{_levels(40)}
SELECT doc_id, size, CAST(z AS BIGINT) AS source_size, round(least(3 * z, w * level), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l39
"""

#: Hashes, learned models and automata can't be expressed in SQL; what can of their queries is in
#: the ``base_`` queries, and tests/llm holds the rest against brute-force versions.
ORACLES = {
    "op5_neardup": NEAR_SQL, "op10_topk": TOP_K_SQL, "base_lmscore": LM_SQL, "base_rules": RULES_SQL, "base_secrets": SECRETS_SQL, "base_mixing": MIXING_SQL,
}
