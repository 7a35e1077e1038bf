"""Decisions, review queue, root causes, candidates and completeness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.checks import id_number_codes
from ..functions.geometry import bounding_box
from ..functions.text import blank, pick
from ..families.base import has_severity
from ..operators.labels import labelled_values
from ..operators.lines import with_rows

# Root cause of an issue code, by the way the code ends or starts; the first that fits counts.
CAUSE_PATTERNS = [
    (r"^missing_mrz_lines$|^mrz_parse_failed$", "ocr_error"),
    (r"^missing_", "parser_error"),
    (r"^(length|format)_invalid$", "ocr_error"),
    (r"_check_failed$|^checksum_invalid$", "ocr_error"),
    (r"^invalid_", "schema_error"),
    (r"_mismatch$|^same_", "validator_error"),
    (r"_invalid$", "ocr_error"),
    (r"^(blur|glare|shadow|low_contrast|occlusion)", "quality_error"),
    (r"^(cropped|page_curvature)", "detect_error"),
    (r"^(layout|region|reading_order)_", "layout_error"),
]
UNCLASSIFIED = "unclassified"


def is_conflict(code: Column) -> Column:
    """Codes that say two readings disagree rather than that one is wrong."""
    return F.endswith(code, F.lit("_mismatch"))


def decide(issues: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """Four-way decision: errors reject, disagreeing readings and low confidence go to review,
    warnings are accepted as such. A missing confidence counts as low."""
    hard_error = F.exists(issues, lambda i: (i["severity"] == "error") & ~is_conflict(i["code"]))
    conflict = F.exists(issues, lambda i: is_conflict(i["code"]))
    low = F.coalesce(confidence, F.lit(0.0)) < threshold
    return (
        F.when(hard_error, F.lit("reject"))
        .when(conflict | low, F.lit("review"))
        .when(F.size(issues) > 0, F.lit("accept_with_warning"))
        .otherwise(F.lit("accept"))
    )


def with_decision(processed: DataFrame, threshold: float = 0.6) -> DataFrame:
    return processed.withColumn("decision", decide(F.col("issues"), F.col("confidence"), threshold))


def review_queue(decided: DataFrame) -> DataFrame:
    """Documents to look at, with the evidence: chosen fields, the lines each chosen value occurs
    in, the errors and all lines with their boxes. It is all in the row, so nothing is joined."""
    chosen = F.filter(F.map_entries("field_values"), lambda e: ~blank(e["value"]))
    evidence = F.transform(
        chosen,
        lambda e: F.struct(
            e["key"].alias("field"), e["value"].alias("value"),
            F.filter(
                F.transform("rows", lambda r, i: F.struct((i + 1).alias("line_no"), r["text"].alias("text"), bounding_box(r["box"]).alias("bbox"))),
                lambda r: F.contains(r["text"], e["value"]),
            ).alias("candidates"),
        ),
    )
    return with_rows(decided.where(F.col("decision") == "review")).select(
        "doc_id", "plugin", "confidence", evidence.alias("evidence"),
        F.filter("issues", lambda i: i["severity"] == "error").alias("errors"),
        F.col("rows").alias("lines"),
    )


def root_cause(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, cause in CAUSE_PATTERNS:
        out = out.when(F.regexp_like(code, F.lit(pattern)), F.lit(cause))
    return out.otherwise(F.lit(UNCLASSIFIED))


def failures_by_cause(issues: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """Issue counts per root cause, family and code.

    ``causes(code, root_cause[, plugin])`` names causes by code, for one family or (null) for all; the patterns cover the
    codes it does not list, and what nobody knows is ``unclassified``. Issues are counted before they meet the table.
    """
    counts = issues.groupBy("plugin", "code").agg(F.count(F.lit(1)).alias("num_issues"))
    cause = root_cause(F.col("code"))
    if causes is not None:
        known = causes if "plugin" in causes.columns else causes.withColumn("plugin", F.lit(None).cast("string"))
        own = known.where("plugin IS NOT NULL").groupBy("plugin", "code").agg(F.min("root_cause").alias("_own"))
        shared = known.where("plugin IS NULL").groupBy("code").agg(F.min("root_cause").alias("_shared"))
        counts = counts.join(own, ["plugin", "code"], "left").join(shared, "code", "left")
        cause = F.coalesce("_own", "_shared", cause)
    return counts.select("plugin", cause.alias("root_cause"), "code", "num_issues")


def with_candidates(queue: DataFrame, ranked: DataFrame) -> DataFrame:
    """The review queue with what else was found: ``candidates``, per field the ranked values and their evidence.

    ``ranked``: as of ``operators.candidates.ranked``, a few rows per document and field. Documents without any get an
    empty list.
    """
    shown = F.struct("field", "rank", "value", "score", "anchored", "valid", "line_no", "bbox")
    per_document = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(shown)).alias("candidates"))
    joined = queue.join(per_document, "doc_id", "left")
    return joined.withColumn("candidates", F.coalesce("candidates", F.array().cast(per_document.schema["candidates"].dataType)))


def top_failures(issues: DataFrame, k: int = 10, period: Column | None = None) -> DataFrame:
    """The k most frequent (family, code) of every period, ties by name. Counting comes first,
    so ranking sees one row per code and never the issues themselves."""
    from pyspark.sql import Window

    period = F.lit("all") if period is None else period
    counts = issues.groupBy(period.alias("period"), "plugin", "code").agg(F.count(F.lit(1)).alias("num_issues"))
    order = Window.partitionBy("period").orderBy(F.desc("num_issues"), "plugin", "code")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(
        "root_cause", root_cause(F.col("code"))
    )


def number_candidates(docs: DataFrame, as_of: Column, aliases: Mapping | None = None) -> DataFrame:
    """Candidates for the identity number of each document, with what speaks for them.

    Recall: every number-like text, and every value that follows a number label. Score: label
    0.4, valid number 0.4, line score 0.2.
    """
    found = labelled_values(F.col("rows"), {"id_number": (aliases or rules.BOOKLET_ALIASES)["id_number"]})
    near = F.transform(
        found,
        lambda x: F.struct(
            F.upper(pick(F.translate(x["value"], " ", ""), rules.BOOKLET_ID_NUMBER)).alias("value"),
            x["score"].alias("line_score"), F.lit(True).alias("labelled"),
        ),
    )
    loose = F.flatten(
        F.transform(
            "rows",
            lambda r: F.transform(
                F.regexp_extract_all(F.translate(r["text"], " ", ""), F.lit(rules.BOOKLET_ID_NUMBER), F.lit(0)),
                lambda v: F.struct(
                    F.upper(v).alias("value"), r["score"].alias("line_score"), F.lit(False).alias("labelled")
                ),
            ),
        )
    )
    every = F.filter(F.concat(near, loose), lambda c: c["value"].isNotNull())
    scored = F.transform(
        F.array_distinct(every),
        lambda c: F.struct(
            (
                F.when(c["labelled"], 0.4).otherwise(0.0)
                + F.when(F.size(id_number_codes(c["value"], as_of)) == 0, 0.4).otherwise(0.0)
                + c["line_score"] * 0.2
            ).alias("score"),
            c["value"].alias("value"), c["labelled"].alias("labelled"), c["line_score"].alias("line_score"),
        ),
    )
    return docs.withColumn("candidates", scored)


def choose_candidate(docs: DataFrame) -> DataFrame:
    """Best-scored candidate per document; the greater value decides ties."""
    return docs.withColumn("chosen", F.array_max("candidates")["value"])


def completeness(processed: DataFrame, expected: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Per family and configured field: documents, documents with a value, and the share without.

    The field list of the row's family is unfolded inside the row; a list is empty when it has no items.
    """
    expected = expected or rules.EXPECTED_FIELDS
    lists = F.create_map(
        *[x for p, fs in expected.items() for x in (F.lit(p), F.array(*[F.lit(f) for f in fs]))]
    )
    value = F.try_element_at("field_values", F.col("field"))
    return (
        processed.select("plugin", "field_values", F.explode(F.try_element_at(lists, F.col("plugin"))).alias("field"))
        .groupBy("plugin", "field")
        .agg(
            F.count(F.lit(1)).alias("num_documents"),
            F.count(F.when(~blank(value) & (value != "[]"), 1)).alias("num_present"),
        )
        .withColumn("missing_rate", 1 - F.col("num_present") / F.col("num_documents"))
    )


def quality_route(
    scores: DataFrame,
    thresholds: tuple[float, float] = (0.5, 0.8),
    rule_lists: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """Add ``route``, ``passed`` and ``reasons`` to ``scores(plugin, quality MAP<rule, defect>)``.

    A defect from the second threshold on sends the image to review, one from the first on to
    the enhanced path. Only the rules of the row's family count; a family without rules uses all.
    """
    enhanced, review = thresholds
    rule_lists = rule_lists or rules.QUALITY_RULES
    lists = F.create_map(
        *[x for p, rs in rule_lists.items() for x in (F.lit(p), F.array(*[F.lit(r) for r in rs]))]
    )
    relevant = F.coalesce(F.try_element_at(lists, F.col("plugin")), F.array_sort(F.map_keys("quality")))
    staged = scores.withColumn("_rules", relevant)
    defect = lambda r: F.coalesce(F.try_element_at("quality", r), F.lit(0.0))
    return (
        staged.withColumn("reasons", F.filter("_rules", lambda r: defect(r) >= enhanced))
        .withColumn(
            "route",
            F.when(F.exists("_rules", lambda r: defect(r) >= review), F.lit("review"))
            .when(F.size("reasons") > 0, F.lit("enhanced"))
            .otherwise(F.lit("normal")),
        )
        .withColumn("passed", F.size("reasons") == 0)
        .drop("_rules")
    )
