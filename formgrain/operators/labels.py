"""Values that follow a label, on the same line or on the next one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty, strip


def alias_pairs(aliases: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(upper-case alias, field) pairs. An alias may name one field only and holds no colon."""
    pairs: dict[str, str] = {}
    for field, names in aliases.items():
        for name in names:
            key = name.upper()
            if ":" in key or "：" in key:
                raise ValueError(f"alias {name!r} holds a colon")
            if pairs.setdefault(key, field) != field:
                raise ValueError(f"alias {name!r} names both {pairs[key]} and {field}")
    return list(pairs.items())


def _label_and_value(text: Column) -> tuple[Column, Column]:
    plain = F.translate(text, "：", ":")
    colon = F.instr(plain, ":")
    label = F.upper(F.substring_index(plain, ":", 1))
    value = F.when(colon > 0, strip(F.substr(plain, colon + 1)))
    return label, non_empty(value)


def labelled_values(rows: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Every (field, value) found in the rows, in reading order.

    The part of a line before its first colon decides the label, so one map lookup per line
    serves all fields. A label that stands alone takes the next line.
    """
    lookup = F.create_map(*[F.lit(part) for pair in alias_pairs(aliases) for part in pair])

    def read(row: Column, i: Column) -> Column:
        label, value = _label_and_value(row["text"])
        following = F.get(rows, i + 1)["text"]
        return F.struct(
            F.try_element_at(lookup, label).alias("field"),
            F.coalesce(value, following).alias("value"),
            row["score"].alias("score"),
        )

    return F.filter(F.transform(rows, read), lambda x: x["field"].isNotNull() & x["value"].isNotNull())


def first_value(found: Column, field: str) -> Column:
    return F.get(F.filter(found, lambda x: x["field"] == field), 0)["value"]


def label_values_of_lines(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same rule over a line table ``(doc_id, line_no, text)`` and an alias table
    ``(alias, field)``: one row per document and field, the first in reading order.

    A label that stands alone takes the next line: the column ``next_text`` if the table has it, as that of
    ``explode_lines`` does, else an equi-join on ``(doc_id, line_no)``, in which only such labels take part and no side is
    broadcast. A document that holds a large share of all lines is spread over tasks either way. The last step keeps a
    running minimum, combined before the shuffle.
    """
    label, value = _label_and_value(F.col("text"))
    nested = "next_text" in lines.columns
    keyed = lines.select("doc_id", "line_no", label.alias("alias"), value.alias("value"), *(["next_text"] if nested else []))
    known = aliases.select(F.upper("alias").alias("alias"), "field").distinct()
    hits = keyed.join(known, "alias").drop("alias")
    if nested:
        found = hits.select("doc_id", "line_no", "field", F.coalesce("value", "next_text").alias("value")).where("value IS NOT NULL")
    else:
        following = lines.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("next_text"))
        # Lines unfolded from documents count as no larger than these, so their size says nothing against a broadcast.
        below = hits.where(F.col("value").isNull()).drop("value").join(following.hint("merge"), ["doc_id", "line_no"])
        found = hits.where(F.col("value").isNotNull()).unionByName(below.withColumnRenamed("next_text", "value"))
    return (
        found
        .groupBy("doc_id", "field")
        .agg(F.min(F.struct("line_no", "value")).alias("first"))
        .select("doc_id", "field", F.col("first.line_no").alias("line_no"), F.col("first.value").alias("value"))
    )
