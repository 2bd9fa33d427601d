"""Corpus pipeline: quality filter, line dedup, near-duplicate filter, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes each
stage's result to the shared folder and reads it again, so a lost executor costs one stage's tasks. Stages that
hand texts to Python set the session's batch size, unless it has one; `run` takes that back at its end.

Defined cases: a row with a null id is never a duplicate of another row, takes part in all stages and keeps its
null id; rows of one id are one document to the near-duplicate stage, which keeps one of them; a null or empty
text is scored like any other, has no lines or words to lose, and counts as a row without tokens when sources are
mixed; a document left without words by line dedup goes; texts are never cut, however long; extra columns, also
those named like inner ones, are carried to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bag_minhash, bpe_words, line_dedup, mixing, quality, queries
from corpusloom.runtime import BATCH_SETTING, materialize, small_batches

QUALITY_THRESHOLD = 0.3
# Chunks of the encoder: the executors' memory is also used by the stages before it.
CHUNK_BYTES = 4 << 20
# Batches of texts that go to Python, instead of 10,000 rows or 64 MB; one batch is one chunk of the encoder.
BATCH_BYTES = 3 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model is trained on the labelled ones among `docs`."""
    small_batches(spark, BATCH_BYTES)
    forest = quality.train(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, name="__score").where(F.col("__score") >= QUALITY_THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; n_chars follows the text."""
    small_batches(spark, BATCH_BYTES)
    left = line_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark, BATCH_BYTES)
    return bag_minhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, a repeated one as several rows."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and digests of the ids and of the decoded text."""
    small_batches(spark, BATCH_BYTES)
    coded = bpe_words.encode_texts(docs, queries.vocabulary(), chunk_bytes=CHUNK_BYTES)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

# Boosted trees and merges by rank are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    own = small_batches(spark, BATCH_BYTES)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
    finally:
        if own:
            spark.conf.unset(BATCH_SETTING)
    return docs
