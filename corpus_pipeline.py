"""From raw documents to sampled training tokens: five stages, each an operator of ``quadrat.llm`` on what the one before kept.

1. ``language_id``: documents without a language (``und``), or in which no language has half of the letters, go. A missing ``lang``
   is filled with the prediction.
2. ``ngram_join``: of each group of near copies (five-word shingles, Jaccard of 0.8 or more, and chains of such) the document
   with the smallest ``doc_id`` stays.
3. ``substring_dedup``: sentences and lines that an earlier document has are cut; documents left without words go.
4. ``mixing``: sources are mixed to their target weights; a document comes once for each pass that takes words of it,
   with the words taken.
5. ``sentencepiece``: sampled piece ids of each row.

Stages 1 to 4 return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import language_id, mixing, ngram_join, sentencepiece_sampling, substring_dedup
from quadrat.llm.shared import Kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.predict(docs, language_id.learned(docs), ["text", "lang", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_repeats(docs, carry=["lang", "source", "n_chars"], whole_lines=True)
    kept = found.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.mix(docs)).select(*COLUMNS)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.sample_pieces(docs).select("doc_id", "n_chars", "n_pieces", "ids")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("sentencepiece", sampled_pieces),
]

#: Learned languages, samples and permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    kept = Kept(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = kept.keep(docs)
    return docs
