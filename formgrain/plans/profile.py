"""Batch profile of an asset collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators.lines import line_stats


def asset_results(assets: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows of the assets that were found and recognised, and error rows of all others:
    ``missing_file`` or ``not_recognised``.

    ``assets`` carries the measured file facts and ``error``; ``recognised(sample_id, text, lines)``
    the recognition results.
    """
    count, mean = line_stats(F.col("lines"))
    seen = recognised.select("sample_id", "text", "lines", F.lit(True).alias("_seen"))
    joined = assets.join(seen, "sample_id", "left").withColumn(
        "error", F.coalesce("error", F.when(F.col("_seen").isNull(), F.lit("not_recognised"))))
    done = joined.where(F.col("error").isNull()).select(
        "sample_id", "category", "kind", "path", F.col("found_bytes").alias("size_bytes"),
        F.col("found_sha256").alias("sha256"), count.alias("num_lines"), mean.alias("confidence"),
        F.coalesce(preview(F.col("text")), F.lit("")).alias("text_preview"), F.lit("ok").alias("status"),
    )
    return done, joined.where(F.col("error").isNotNull()).select("sample_id", "path", "error")


def summary(results: DataFrame) -> DataFrame:
    """Counts and confidence figures by category and by kind, from one pass over the results."""
    grouped = results.groupingSets([["category"], ["kind"]], "category", "kind").agg(
        F.grouping("category").alias("_by_kind"),
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("num_lines"), 2).alias("avg_num_lines"),
        F.round(F.min("confidence"), 4).alias("min_confidence"),
        F.round(F.max("confidence"), 4).alias("max_confidence"),
    )
    return grouped.select(
        F.when(F.col("_by_kind") == 1, F.lit("kind")).otherwise(F.lit("category")).alias("grouped_by"),
        F.when(F.col("_by_kind") == 1, F.col("kind")).otherwise(F.col("category")).alias("name"),
        "count", "avg_confidence", "avg_num_lines", "min_confidence", "max_confidence",
    )


def totals(results: DataFrame, errors: DataFrame) -> DataFrame:
    both = results.select(F.lit(1).alias("ok")).unionByName(errors.select(F.lit(0).alias("ok")))
    return both.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("num_processed"),
        F.count(F.when(F.col("ok") == 0, 1)).alias("num_errors"),
    ).withColumn("status", F.when(F.col("num_errors") == 0, F.lit("pass")).otherwise(F.lit("fail")))
