"""Field candidates from a rule table: recall, scoring and normalisation over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import id_number_codes
from ..functions.geometry import bounding_box
from ..functions.text import blank, iso_date, non_empty, strip
from .labels import _label_and_value

#: ``anchor``: label before the value, on its line or alone on the line above; null recalls from every line.
#: ``pattern``: what counts as a value. ``normal``: text, upper, compact, date or route. ``check``: none, id_number, date
#: or route. ``weight``: what the anchor is worth. ``near``: what standing at the field's anchor is worth.
RULE_SCHEMA = "plugin string, field string, anchor string, pattern string, normal string, check string, weight double, near double"
VALID, READ = 0.4, 0.2
#: Distance of centres at which nearness counts half.
REACH = 50.0


def normalised(value: Column, normal: Column) -> Column:
    """The value in the spelling its rule asks for; null if it has none."""
    upper = F.upper(strip(value))
    return (
        F.when(normal == "date", iso_date(value))
        .when(normal == "upper", upper)
        .when(normal == "compact", F.regexp_replace(upper, r"\s+", ""))
        .when(normal == "route", F.regexp_replace(upper, r"\s*(-|–|→|至)\s*", "-"))
        .otherwise(non_empty(strip(value)))
    )


def well_formed(value: Column, check: Column, as_of: Column) -> Column:
    """Whether a normalised value passes the check its rule names; values of rules without a check do."""
    day = F.try_to_date(value, "yyyy-MM-dd")
    ends = F.split(value, "-")
    return (
        F.when(check == "id_number", F.size(id_number_codes(value, as_of)) == 0)
        .when(check == "date", F.coalesce(day <= as_of, F.lit(False)))
        .when(check == "route", (F.size(ends) == 2) & (F.get(ends, 0) != F.get(ends, 1)))
        .otherwise(F.lit(True))
    )


def _distance(a: Column, b: Column) -> Column:
    middle = lambda box, x: (box[f"{x}1"] + box[f"{x}2"]) / 2
    return F.abs(middle(a, "x") - middle(b, "x")) + F.abs(middle(a, "y") - middle(b, "y"))


def candidates(docs: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Rows ``(doc_id, plugin, field, value, score, anchored, valid, line_no, bbox)``, one per document, field and value.

    ``docs(doc_id, plugin, rows)``, one row each; ``rules`` as RULE_SCHEMA, where a family has any number of fields and a
    field any number of rules. Recall: what a rule's pattern finds in the lines, or after its anchor. Score: the anchor's
    weight, 0.4 for a value that passes its check, up to ``near`` by the distance from the field's first anchor, and 0.2
    of the line's score. The best evidence for a value counts; of equal evidence the first line. Rules reach documents
    by one join on ``plugin``; all else happens inside the document's row, so a document is never taken apart over tasks.
    """
    label = lambda r: _label_and_value(r["text"])
    per_field = rules.groupBy("plugin", "field").agg(
        F.array_sort(F.collect_set(F.struct(F.upper("anchor").alias("anchor"), "pattern", "normal", "check", "weight", "near"))).alias("rules"))
    joined = docs.select("doc_id", "plugin", "rows").join(per_field, "plugin")
    rows = F.col("rows")
    anchors = F.filter("rows", lambda r: F.exists("rules", lambda q: label(r)[0] == q["anchor"]))
    staged = joined.withColumn("_anchor", bounding_box(F.get(anchors, 0)["box"]))

    def found(rule: Column) -> Column:
        def of_line(row: Column, i: Column) -> Column:
            name, value = label(row)
            following = F.get(rows, i + 1)
            alone = rule["anchor"].isNotNull() & value.isNull()
            text = F.when(rule["anchor"].isNull(), row["text"]).when(name == rule["anchor"], F.when(alone, following["text"]).otherwise(value))
            line = F.when(alone, following).otherwise(row)
            box = bounding_box(line["box"])
            distance = F.coalesce(_distance(box, F.col("_anchor")), F.lit(float("inf")))

            def scored(raw: Column) -> Column:
                value = normalised(raw, rule["normal"])
                valid = well_formed(value, rule["check"], as_of)
                score = (
                    F.when(rule["anchor"].isNotNull(), rule["weight"]).otherwise(F.lit(0.0)) + F.when(valid, VALID).otherwise(0.0)
                    + F.coalesce(rule["near"], F.lit(0.0)) / (1 + distance / REACH) + READ * line["score"]
                )
                return F.struct(
                    value.alias("value"), score.alias("score"), rule["anchor"].isNotNull().alias("anchored"), valid.alias("valid"),
                    F.when(alone, i + 2).otherwise(i + 1).alias("line_no"), box.alias("bbox"),
                )

            return F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), scored)

        return F.flatten(F.filter(F.transform(rows, of_line), lambda x: x.isNotNull()))

    hits = staged.select("doc_id", "plugin", "field", F.explode(F.flatten(F.transform("rules", found))).alias("c")).where(~blank(F.col("c.value")))
    evidence = F.struct("c.score", "c.anchored", "c.valid", (-F.col("c.line_no")).alias("place"), "c.bbox")
    best = hits.groupBy("doc_id", "plugin", "field", F.col("c.value").alias("value")).agg(F.max(evidence).alias("e"))
    return best.select(
        "doc_id", "plugin", "field", "value", "e.score", "e.anchored", "e.valid", (-F.col("e.place")).alias("line_no"), "e.bbox")


def ranked(found: DataFrame, shown: int = 5) -> DataFrame:
    """The best ``shown`` candidates of each document and field, as ``rank`` 1 and on; of equal scores the greater value first."""
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), F.desc("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)


def chosen(found: DataFrame) -> DataFrame:
    """One row per document and field: the best value, its score, and how far ahead of the next one it is (null if alone)."""
    best = ranked(found, 2).groupBy("doc_id", "plugin", "field").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("value", "score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return best.select("doc_id", "plugin", "field", "first.value", "first.score", (F.col("first.score") - F.col("second")).alias("lead"))
