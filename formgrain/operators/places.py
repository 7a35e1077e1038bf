"""Gazetteer hits and anchored candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.geometry import bounding_box, centre_distance
from ..functions.text import contains_any, let, squeeze_upper, unspaced_upper


def line_tokens(rows: Column) -> Column:
    """Every line in the form that gazetteers and anchors are compared in."""
    return F.transform(rows, lambda r: unspaced_upper(r["text"]))


def places_in_order(tokens: Column, names: Sequence[str]) -> Column:
    """Distinct gazetteer names that fill a whole line, first seen first."""
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(list(names))))


def anchor_box(rows: Column, tokens: Column, anchors: Sequence[str] = tuple(rules.NAME_ANCHORS)) -> Column:
    """Box of the first line that mentions an anchor word."""
    keys = [a.replace(" ", "") for a in anchors]
    at = F.array_position(F.transform(tokens, lambda t: contains_any(t, keys)), True).cast("int")
    # Position 0 stands for no such line; there is no element before the first.
    return let(F.get(rows, at - 1)["box"], bounding_box)


def name_candidates(rows: Column, anchor: Column, excluded: Sequence[str]) -> Column:
    """Lines that read like a Latin person name, as (distance to anchor, negative score, text)."""
    latin = F.filter(rows, lambda r: F.regexp_like(F.upper(r["text"]), F.lit(rules.LATIN_LINE)))
    shaped = F.transform(latin, lambda r: F.struct(squeeze_upper(r["text"]).alias("text"), r["score"].alias("score"), r["box"].alias("box")))
    named = F.filter(
        shaped,
        lambda c: (F.length(c["text"]) <= rules.NAME_MAX_LENGTH)
        & ~c["text"].isin(list(excluded))
        & ~contains_any(c["text"], rules.NAME_EXCLUDED_PARTS)
        & F.regexp_like(c["text"], F.lit(rules.PERSON_NAME)),
    )
    # Places are compared for the few lines that the text leaves.
    return F.transform(
        named,
        lambda c: F.struct(
            centre_distance(bounding_box(c["box"]), anchor).alias("distance"), (-c["score"]).alias("penalty"), c["text"].alias("text"),
        ),
    )


def nearest_name(rows: Column, anchor: Column, excluded: Sequence[str]) -> Column:
    """Closest candidate; the better score, then the text decide ties."""
    return F.array_min(name_candidates(rows, anchor, excluded))["text"]


def place_route_of_lines(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """First and second distinct gazetteer name per document of a line table.

    ``gazetteer(token)`` is joined on the token; whether it is broadcast is left to its size.
    Lines are reduced to one row per document and name before the shuffle, and the ranking keeps
    two rows per document in every task before it moves any, so no document is gathered whole.
    """
    tokens = lines.select("doc_id", "line_no", unspaced_upper(F.col("text")).alias("token"))
    seen = (
        tokens.join(gazetteer.select("token").distinct(), "token")
        .groupBy("doc_id", "token")
        .agg(F.min("line_no").alias("line_no"))
    )
    order = Window.partitionBy("doc_id").orderBy("line_no", "token")
    ranked = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    return ranked.groupBy("doc_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("token"))).alias("departure"),
        F.max(F.when(F.col("rank") == 2, F.col("token"))).alias("arrival"),
    )


def nearest_candidate(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per document the candidate nearest to the document's anchor.

    ``candidates(doc_id, text, score, bbox)`` and at most one ``anchors(doc_id, bbox)`` row per
    document. A document without anchor still gets a result: distance is then the same for all.
    """
    paired = candidates.join(anchors.select("doc_id", F.col("bbox").alias("anchor")), "doc_id", "left")
    ranked = paired.select(
        "doc_id",
        F.struct(
            centre_distance(F.col("bbox"), F.col("anchor")).alias("distance"),
            (-F.col("score")).alias("penalty"),
            "text",
        ).alias("rank"),
    )
    return (
        ranked.groupBy("doc_id")
        .agg(F.min("rank").alias("best"))
        .select("doc_id", F.col("best.text").alias("text"), F.col("best.distance").alias("distance"))
    )
