"""Combining records of one document: overrides, sources, card sides, tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.structs import pinned


def override_maps(overrides: DataFrame) -> DataFrame:
    """Provided values ``(doc_id, field, value[, seq])`` as one map per document.

    Repeated fields are reduced first (the last ``seq`` wins), so a map holds each field once
    however many rows were provided for it.
    """
    order = F.col("seq") if "seq" in overrides.columns else F.lit(0)
    latest = overrides.where("field IS NOT NULL").groupBy("doc_id", "field").agg(
        F.max(F.struct(order.alias("seq"), F.col("value"))).alias("last")
    )
    return latest.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.col("last.value")))).alias("overrides")
    )


def merged_struct(docs: DataFrame, fields: str) -> tuple[Column, Column]:
    """The struct column ``fields`` with the values of the map ``overrides`` in place of its own, and the provided
    values that the struct has no field for.

    Text fields only take text; list fields take a JSON list. A field that is provided as null becomes null.
    """
    merged = []
    for f in docs.schema[fields].dataType.fields:
        given = F.try_element_at("overrides", F.lit(f.name))
        if f.dataType.typeName() != "string":
            given = F.from_json(given, f.dataType)
        has = F.coalesce(F.map_contains_key("overrides", F.lit(f.name)), F.lit(False))
        merged.append(F.when(has, given).otherwise(F.col(fields)[f.name]).alias(f.name))
    names = F.array(*[F.lit(f.name) for f in docs.schema[fields].dataType.fields])
    return F.struct(*merged), F.map_filter("overrides", lambda k, _: ~F.array_contains(names, k))


def apply_overrides(docs: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace the provided fields of the ``fields`` struct; provided fields that the family does not know are kept as
    the map ``provided``. An override without a field name says nothing and is left out.
    """
    if overrides is None:
        return docs
    joined = docs.join(override_maps(overrides), "doc_id", "left")
    merged, unknown = merged_struct(joined, "fields")
    return pinned(joined.withColumn("provided", unknown), {"fields": merged}).drop("overrides")


def merge_fields(parsed: DataFrame, provided: DataFrame) -> DataFrame:
    """The same on long tables ``(doc_id, field, value)``: what is provided wins, even when null."""
    q = provided.groupBy("doc_id", "field").agg(F.max(F.struct("value")).alias("given"))
    return parsed.join(q, ["doc_id", "field"], "full_outer").select(
        "doc_id", "field",
        F.when(F.col("given").isNotNull(), F.col("given.value")).otherwise(F.col("value")).alias("value"),
        F.col("given").isNotNull().alias("provided"),
    )


def select_by_source(results: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Best result per document and field: by source, then confidence, then value.

    ``results(doc_id, field, value, confidence, source)``. All steps are combined aggregates.
    """
    order = priority or rules.SOURCE_PRIORITY
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    return results.groupBy("doc_id", "field").agg(
        F.max(
            F.struct(rank.alias("rank"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "value", "source")
        ).alias("best"),
        F.avg("confidence").alias("mean_confidence"),
        F.count(F.lit(1)).alias("num_results"),
    ).select(
        "doc_id", "field", F.col("best.value").alias("value"), F.col("best.source").alias("source"),
        F.col("best.confidence").alias("confidence"), "mean_confidence", "num_results",
    )


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is outside a closed vocabulary."""
    return df.where(~F.col(column).isin(allowed) | F.col(column).isNull())


def vocabulary_violations(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    """Add ``violations``: the names of the columns whose value is null or outside its closed vocabulary. Rows that keep
    to all of them have none, so both sides of the check come out of one pass."""
    broken = [F.when(F.col(c).isNull() | ~F.col(c).isin(list(values)), F.lit(c)) for c, values in allowed.items()]
    return df.withColumn("violations", F.filter(F.array(*broken), lambda c: c.isNotNull()))


def pair_sides(cards: DataFrame) -> DataFrame:
    """One row per card from its sides ``(case_id, doc_id, fields)``.

    One combined aggregate does it: no join, so a case with many copies of a side makes no
    pairs. The side with the lowest ``doc_id`` stands for the card; warnings tell what is
    missing or repeated and the counts say how often.
    """
    side = F.col("fields.document_side")
    pick = lambda name: F.min(F.when(side == name, F.struct("doc_id", "fields")))
    grouped = cards.groupBy("case_id").agg(
        pick("front").alias("front"), pick("back").alias("back"),
        F.count(F.when(side == "front", 1)).alias("num_fronts"),
        F.count(F.when(side == "back", 1)).alias("num_backs"),
    )
    warnings = F.filter(
        F.array(
            F.when(F.col("num_fronts") == 0, F.lit("missing_front")),
            F.when(F.col("num_backs") == 0, F.lit("missing_back")),
            F.when(F.col("num_fronts") > 1, F.lit("repeated_front")),
            F.when(F.col("num_backs") > 1, F.lit("repeated_back")),
        ),
        lambda w: w.isNotNull(),
    )
    return grouped.withColumn("warnings", warnings)


def attach_tags(annotations: DataFrame, tags: DataFrame) -> DataFrame:
    """Add ``quality_tags`` to annotations from ``tags(sample_id, tag, score, note)``.

    Repeats of a tag are reduced to the worst score before tags are gathered, so what is
    gathered per sample is bounded by the number of distinct tags.
    """
    once = tags.groupBy("sample_id", "tag").agg(F.max(F.struct("score", "note")).alias("worst"))
    gathered = once.groupBy("sample_id").agg(
        F.array_sort(
            F.collect_list(F.struct("tag", F.col("worst.score").alias("score"), F.col("worst.note").alias("note")))
        ).alias("quality_tags")
    )
    return annotations.drop("quality_tags").join(gathered, "sample_id", "left")


def tag_rows(annotations: DataFrame) -> DataFrame:
    return annotations.select("sample_id", F.explode("quality_tags").alias("t")).select("sample_id", "t.*")


def relation_rows(annotations: DataFrame) -> DataFrame:
    """Relations with the text of both ends, looked up inside the annotation itself."""
    text_of = lambda region_id: F.get(
        F.filter("regions", lambda r: r["region_id"] == region_id), 0
    )["text"]
    return annotations.select(
        "sample_id",
        F.explode(
            F.transform(
                "relations",
                lambda r: F.struct(
                    r["from_id"].alias("from_id"), r["to_id"].alias("to_id"),
                    r["relation_type"].alias("relation_type"),
                    text_of(r["from_id"]).alias("from_text"), text_of(r["to_id"]).alias("to_text"),
                ),
            )
        ).alias("r"),
    ).select("sample_id", "r.*")


def fields_long(docs: DataFrame, fields_map: Column | str = "field_values") -> DataFrame:
    return docs.select("doc_id", "plugin", F.explode(fields_map).alias("field", "value"))
