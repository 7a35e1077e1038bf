"""Documents as ordered lines, nested or exploded.

The nested shape (one row per document, an array of lines) is the working shape: every
per-document rule is then a projection, so extraction needs no shuffle and runs unchanged
on a stream. The exploded shape serves line tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box
from ..functions.structs import built_once, unfold
from ..functions.text import let, split_lines, strip

BOX_TYPE = "array<array<double>>"
LINES_TYPE = "array<struct<box:array<array<double>>,text:string,score:double>>"


def _text_rows(text: Column) -> Column:
    return F.transform(
        F.filter(F.transform(split_lines(text), strip), lambda t: t != ""),
        lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("score"), F.lit(None).cast(BOX_TYPE).alias("box")),
    )


def _no_rows() -> Column:
    return F.array().cast(f"array<struct<text:string,score:double,box:{BOX_TYPE}>>")


def rows_of(lines: Column, text: Column) -> Column:
    """Non-blank lines in reading order; the document text split into lines when there are none.

    Boxes stay as they came: only the few lines a rule compares by place get a bounding box.
    """
    recognised = F.filter(
        F.transform(
            lines,
            lambda l: F.struct(
                strip(l["text"]).alias("text"),
                F.coalesce(l["score"], F.lit(0.0)).alias("score"),
                l["box"].alias("box"),
            ),
        ),
        lambda r: r["text"] != "",
    )
    return let(recognised, lambda r: F.when(F.size(r) > 0, r).otherwise(F.coalesce(_text_rows(text), _no_rows())))


def with_rows(docs: DataFrame) -> DataFrame:
    """Add ``rows``, the cleaned lines of each document. ``text`` or ``lines`` may be absent."""
    have = set(docs.columns)
    return docs.withColumn("rows", _rows("lines" in have, "text" in have))


@built_once
def _rows(has_lines: bool, has_text: bool) -> Column:
    text = F.col("text") if has_text else F.lit(None).cast("string")
    return rows_of(F.col("lines"), text) if has_lines else F.coalesce(_text_rows(text), _no_rows())


def joined_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def explode_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per line with its 1-based position and the text of the next line, plus the kept document columns."""
    following = lambda r, i: F.struct(r["text"].alias("text"), r["score"].alias("score"), r["box"].alias("box"), F.get("rows", i + 1)["text"].alias("next_text"))
    return (
        unfold(with_rows(docs), F.transform("rows", following), *(keep or ("doc_id",)), numbered=True)
        .select(
            *(keep or ("doc_id",)),
            (F.col("pos") + 1).alias("line_no"),
            F.col("item.text").alias("text"),
            F.col("item.score").alias("score"),
            bounding_box(F.col("item.box")).alias("bbox"),
            F.col("item.next_text").alias("next_text"),
        )
    )


def line_stats(lines: Column) -> tuple[Column, Column]:
    """Number of lines and their mean score (0.0 without lines), over the raw line array."""
    count = F.greatest(F.size(lines), F.lit(0))
    scores = F.transform(lines, lambda l: F.coalesce(l["score"], F.lit(0.0)))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return count, F.when(count > 0, total / count).otherwise(F.lit(0.0))
