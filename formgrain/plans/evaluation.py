"""Extraction quality against golden fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structs import pinned, unfold

CRITICAL_FIELDS = [
    "id_number", "mrz_lines", "passport_number", "passenger_name", "ticket_number",
    "departure_station", "arrival_station", "diagnosis", "visit_date",
]


def compare(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per golden document with the outcome of every expected field.

    ``golden(doc_id, expected MAP)`` and ``predicted(doc_id, field_values MAP, ...)`` each hold
    one row per document, so a single join on ``doc_id`` is all that moves; fields are compared
    inside the row, null equal to null, a field that was not predicted being null. The family is the golden row's,
    if it names one. A golden document without a prediction counts as not accepted and up for review.
    """
    extra = [c for c in predicted.columns if c not in golden.columns and c != "field_values"]
    joined = golden.join(predicted.select("doc_id", "field_values", *extra), "doc_id", "left")
    joined = joined.withColumns({
        name: F.coalesce(name, F.lit(value)) for name, value in (("accepted", False), ("decision", "review")) if name in joined.columns})
    outcome = F.transform(
        F.map_entries("expected"),
        lambda e: F.struct(
            e["key"].alias("field"), e["value"].alias("expected"),
            F.try_element_at("field_values", e["key"]).alias("predicted"),
            e["value"].eqNullSafe(F.try_element_at("field_values", e["key"])).alias("matched"),
        ),
    )
    return pinned(joined, {"outcome": outcome}).drop("field_values", "expected")


def document_scores(compared: DataFrame) -> DataFrame:
    """Expected and matched fields per document; it passes when all match and there is at least one."""
    total = F.size("outcome")
    hit = F.size(F.filter("outcome", lambda o: o["matched"]))
    rate = F.when(total > 0, hit / total).otherwise(F.lit(0.0))
    return (
        compared.withColumn("num_fields", total)
        .withColumn("num_matched_fields", hit)
        .withColumn("field_exact_match_rate", rate)
        .withColumn("status", F.when(rate == 1.0, F.lit("pass")).otherwise(F.lit("fail")))
    )


def totals(scored: DataFrame) -> DataFrame:
    """Totals over all documents; no documents at all pass."""
    return scored.agg(
        F.count(F.lit(1)).alias("num_fixtures"),
        F.count(F.when(F.col("status") == "pass", 1)).alias("num_passed"),
        F.count(F.when(F.col("status") == "fail", 1)).alias("num_failed"),
        F.coalesce(F.sum("num_fields"), F.lit(0)).alias("num_fields"),
        F.coalesce(F.sum("num_matched_fields"), F.lit(0)).alias("num_matched_fields"),
    ).select(
        "*",
        F.when(F.col("num_fields") > 0, F.col("num_matched_fields") / F.col("num_fields")).otherwise(F.lit(0.0))
        .alias("overall_field_exact_match_rate"),
        F.when(F.col("num_failed") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
    )


def field_rows(compared: DataFrame) -> DataFrame:
    keep = [c for c in ("doc_id", "plugin") if c in compared.columns]
    return unfold(compared, "outcome", *keep).select(*keep, "item.*")


def evaluation_report(compared: DataFrame, needs_review: Column) -> DataFrame:
    """Per family and per field within it: exact match, F1 and support; per family also the
    share of documents with all fields right and the share sent to review.

    One pass: every document gives a row per expected field and one row for itself, and all are
    reduced to counts per family and field before anything moves. The rollup then adds up counts.
    """
    whole = F.forall("outcome", lambda o: o["matched"]) & (F.size("outcome") > 0)
    parts = F.transform(
        "outcome",
        lambda o: F.struct(
            o["field"].alias("field"), o["matched"].alias("matched"),
            o["expected"].isNotNull().alias("asked"), o["predicted"].isNotNull().alias("given"),
            F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("boolean").alias("review"),
        ),
    )
    nothing = F.lit(None).cast("boolean")
    itself = F.struct(
        F.lit(None).cast("string").alias("field"), nothing.alias("matched"), nothing.alias("asked"),
        nothing.alias("given"), whole.alias("passed"), needs_review.alias("review"),
    )
    number = lambda c: F.count(F.when(c, 1))
    item = lambda name: F.col(f"item.{name}")
    counts = (
        unfold(compared, F.concat(parts, F.array(itself)), "plugin")
        .groupBy("plugin", item("field").alias("field"))
        .agg(
            F.count(item("matched")).alias("support"), number(item("matched")).alias("hits"),
            number(item("matched") & item("asked")).alias("right"),
            (number(item("asked")) + number(item("given"))).alias("values"),
            F.count(item("passed")).alias("documents"), number(item("passed")).alias("passed"),
            number(item("review")).alias("review"),
        )
    )
    added = counts.rollup("plugin", "field").agg(
        F.grouping("plugin").alias("_no_plugin"), F.grouping("field").alias("_no_field"),
        *[F.sum(c).alias(c) for c in ("support", "hits", "right", "values", "documents", "passed", "review")],
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    overall = F.col("_no_field") == 1
    return added.where((F.col("_no_plugin") == 0) & (overall | F.col("field").isNotNull())).select(
        "plugin", "field",
        share("hits", "support").alias("exact_match"),
        (2 * share("right", "values")).alias("f1"),
        "support",
        F.when(overall, share("passed", "documents")).alias("document_success_rate"),
        F.when(overall, share("review", "documents")).alias("review_rate"),
    )


def quality_metrics(compared: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Per family: exact match of critical fields, MRZ lines, dates and numbers, document success,
    review rate and false accepts, in one combined aggregate over documents with ``accepted`` and
    ``decision``."""
    critical = critical or CRITICAL_FIELDS

    def rate(keep) -> Column:
        asked = F.sum(F.size(F.filter("outcome", keep)))
        hit = F.sum(F.size(F.filter("outcome", lambda o: keep(o) & o["matched"])))
        return hit / F.nullif(asked, F.lit(0))

    whole = (F.size("outcome") > 0) & F.forall("outcome", lambda o: o["matched"])
    return compared.groupBy("plugin").agg(
        F.count(F.lit(1)).alias("num_documents"),
        rate(lambda o: F.lit(True)).alias("field_exact_match"),
        rate(lambda o: o["field"].isin(critical)).alias("critical_field_exact_match"),
        rate(lambda o: o["field"] == "mrz_lines").alias("mrz_line_exact_match"),
        rate(lambda o: F.contains(o["field"], F.lit("date"))).alias("date_exact_match"),
        rate(lambda o: F.endswith(o["field"], F.lit("number"))).alias("number_exact_match"),
        F.avg(whole.cast("int")).alias("document_success_rate"),
        F.avg((F.col("decision") == "review").cast("int")).alias("review_rate"),
        (F.count(F.when(F.col("accepted") & ~whole, 1)) / F.nullif(F.count(F.when(F.col("accepted"), 1)), F.lit(0)))
        .alias("false_accept_rate"),
    )


def write_report(name: str, totals_row: DataFrame, results: DataFrame, path: str, generated_at: Column, **header: str) -> None:
    """A one-row JSON header with the totals, and the results as JSON lines beside it.

    Results are written by all tasks; they are never gathered into one document.
    """
    head = totals_row.select(
        F.lit("0.2.0").alias("schema_version"), F.lit(name).alias("report_name"),
        F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.struct(*[F.lit(v).alias(k) for k, v in header.items()] or [F.lit("formgrain").alias("engine")]).alias("runner"),
        F.struct("*").alias("totals"),
    )
    head.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/header")
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/results")
