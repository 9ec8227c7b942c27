"""The corpus pipeline: five stages over the documents, each by one training-data operator.

A stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and returns
them too; the last returns the encoded documents. Null ids and null texts pass every
stage that doesn't decide on them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm.common import checkpointed, small_frames, table
from arterial.llm.mixing import mix_to_targets
from arterial.llm.neardup import near_duplicates
from arterial.llm.pieces import encode_pieces
from arterial.llm.secretscan import scan_secrets
from arterial.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Ids to remove, up to which they are broadcast; above, they are joined.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null and empty texts score as texts
    without words; repeated rows are judged alike. An empty table stays empty."""
    small_frames(spark)
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), machine).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group at similarity 0.8 of five-word shingles.

    Of rows repeated under one id, those of the same words stay once; rows of other words
    stay too. Documents without words and null ids all stay. An empty table stays empty."""
    found = near_duplicates(docs, width=5, percent=80)
    found = checkpointed(found.where(F.col("doc_id").isNotNull()))
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = found.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if not repeated.head(1):
        return left
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.btrim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    named = left.join(repeated, "doc_id", "left_semi").withColumn("__words", F.coalesce(words, F.lit("")))
    rest = [c for c in COLUMNS if c != "doc_id"]
    once = named.where("__words <> ''").groupBy("doc_id", "__words").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    others = left.join(repeated, "doc_id", "left_anti").select(*COLUMNS)
    return others.unionByName(once.select(*COLUMNS)).unionByName(named.where("__words = ''").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found in them replaced by a mark. Null and empty texts and
    texts without findings stay as they are. An empty table stays empty."""
    scanned = scan_secrets(docs.select(*COLUMNS))
    text = F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted"))
    chars = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return scanned.withColumn("n_chars", chars).withColumn("text", text).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, each time whole.

    Texts without words are taken 0 times; equal rows are taken alike. An empty table stays empty."""
    mixed = mix_to_targets(docs.select(*COLUMNS), weights=(5, 2, 1), max_epochs=3, seed=17, whole=True).where("taken > 0")
    copies = (F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, repeated rows each. Null and empty texts have no
    pieces. An empty table gives an empty result."""
    encoded = encode_pieces(docs.select(*COLUMNS), PIECES)
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Learned models, hashes and automata have no counterpart in SQL; the tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
