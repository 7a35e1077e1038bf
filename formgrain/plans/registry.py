"""Document kinds as a table: routing, expected fields and quality thresholds by version, without a change of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import families
from ..functions.text import blank
from .process import process

#: ``reads_as``: the registered family that reads the kind (null: the kind's own name). ``fields``: those expected of it.
#: ``quality``: defects that count, with the scores from which they send an image to the enhanced path or to review.
KIND_SCHEMA = "plugin string, version int, enabled boolean, reads_as string, fields array<string>, quality array<struct<rule:string,enhanced:double,review:double>>"


def current(kinds: DataFrame) -> DataFrame:
    """The last version of each kind; a kind whose last version is disabled is not in force."""
    rest = [c for c in kinds.columns if c not in ("plugin", "version")]
    last = kinds.where("plugin IS NOT NULL").groupBy("plugin").agg(F.max_by(F.struct("version", *rest), F.struct("version", F.to_json(F.struct(*rest)))).alias("k"))
    return last.select("plugin", "k.*").where("enabled")


def shipped_kinds(spark) -> DataFrame:
    """The registered families as kinds, version 0, with the default thresholds."""
    rows = [(name, 0, True, name, families.get(name).config.get("fields"), [(r, 0.5, 0.8) for r in families.get(name).config.get("quality_rules", [])])
            for name in families.names()]
    return spark.createDataFrame(rows, KIND_SCHEMA)


def routed(results: DataFrame, kinds: DataFrame) -> DataFrame:
    """Results with ``kind`` (what they came as), ``kind_version`` and, as ``plugin``, the family that reads them.

    A kind that is unknown, or disabled, or read by a family nobody registered, leaves ``plugin`` null, so the job
    rejects its documents. One join on the kind's name, on tables and streams alike.
    """
    reader = F.coalesce("reads_as", "plugin")
    table = current(kinds).select(F.col("plugin").alias("kind"), F.col("version").alias("kind_version"), F.when(reader.isin(families.names()), reader).alias("_reader"))
    return results.withColumnRenamed("plugin", "kind").join(table, "kind", "left").withColumnRenamed("_reader", "plugin")


def process_kinds(results: DataFrame, kinds: DataFrame, overrides: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """The document job over kinds; every document comes out, with its kind and the version it was routed by."""
    return process(routed(results, kinds), overrides, as_of, keep_unrouted=True, keep=("kind", "kind_version"))


def completeness(processed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind and expected field: documents, documents with a value, and the share without. Unrouted documents and
    kinds that expect nothing are left out."""
    expected = current(kinds).select(F.col("plugin").alias("kind"), F.array_distinct("fields").alias("fields"))
    value = F.try_element_at("field_values", F.col("field"))
    return (
        processed.where("plugin IS NOT NULL").select("kind", "field_values").join(expected, "kind")
        .select("kind", "field_values", F.explode("fields").alias("field"))
        .groupBy("kind", "field")
        .agg(F.count(F.lit(1)).alias("num_documents"), F.count(F.when(~blank(value) & (value != "[]"), 1)).alias("num_present"))
        .withColumn("missing_rate", 1 - F.col("num_present") / F.col("num_documents"))
    )


def quality_route(scores: DataFrame, kinds: DataFrame) -> DataFrame:
    """Add ``route``, ``passed`` and ``reasons`` to ``scores(plugin, quality MAP<rule, defect>)`` by the kind's own thresholds.

    A kind with no rules, or not in force, has nothing to go by and is sent to review with the reason ``no_rules``. A
    rule without a score is taken as 0.
    """
    rules = current(kinds).select("plugin", F.col("quality").alias("_rules"))
    defect = lambda r: F.coalesce(F.try_element_at("quality", r["rule"]), F.lit(0.0))
    known = F.size("_rules") > 0
    reached = F.transform(F.filter("_rules", lambda r: defect(r) >= r["enhanced"]), lambda r: r["rule"])
    return (
        scores.join(rules, "plugin", "left")
        .withColumn("reasons", F.when(known, reached).otherwise(F.array(F.lit("no_rules"))))
        .withColumn("route", F.when(~F.coalesce(known, F.lit(False)) | F.exists("_rules", lambda r: defect(r) >= r["review"]), F.lit("review"))
                    .when(F.size("reasons") > 0, F.lit("enhanced")).otherwise(F.lit("normal")))
        .withColumn("passed", F.size("reasons") == 0)
        .drop("_rules")
    )
