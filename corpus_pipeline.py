"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm import classifier, common, decontaminate, near_duplicates, pieces, suffixes

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Each row is judged by its own text: null and empty ones by
    the offset alone, repeated ones alike, rows without a doc_id like any others."""
    return classifier.good_documents(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of five-word shingles, as for any stage without a contract of
    its own): the one with the smallest doc_id, one without an id only if none has; of different texts under one id one
    of their group; a repeated row once. Null, empty and blank texts are near to nothing and stay, a repeated row once."""
    return near_duplicates.representatives(docs, near_duplicates.Settings(words=5))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that occur more than once; what a cut leaves of a character goes with it. All rows stay,
    each with its own text, whatever their doc_ids; repeated rows repeat each other and are cut alike, null texts stay
    null, and n_chars follows the text."""
    keyed = docs.withColumn("_row", common.row_key())
    cut = suffixes.repeated_bytes(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "kept_text").dropDuplicates(["_row"])
    rows = keyed.withColumn("_null", F.col("text").isNull()).drop("text", "n_chars").join(cut, "_row")
    rows = rows.withColumn("text", F.when(~F.col("_null"), F.col("kept_text"))).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, each row judged by its own text; null and empty ones have none and stay."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of what is left, row by row; null and empty texts have the end id alone."""
    return pieces.encode_and_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encode),
]
#: Neither the classifier nor the encoder can be written in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written to the shared folder and read by the next. What a stage
    writes for itself, and what it read, is removed once its result stands."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as keep:
            docs = keep(common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
