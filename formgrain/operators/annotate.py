"""Recognised lines as region and field annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box
from ..functions.text import file_stem
from .lines import LINES_TYPE

RELATIONS_TYPE = "array<struct<from_id:string,to_id:string,relation_type:string>>"
TAGS_TYPE = "array<struct<tag:string,score:double,note:string>>"


def annotate(docs: DataFrame, sample_id: Column | None = None) -> DataFrame:
    """One annotation per document. Every raw line, blank or not, is a region and a field."""
    sample_id = file_stem(F.col("doc_id").cast("string")) if sample_id is None else sample_id
    number = lambda i: (i + 1).cast("string")
    lines = F.coalesce("lines", F.array().cast(LINES_TYPE))
    regions = F.transform(
        lines,
        lambda l, i: F.struct(
            F.concat(F.lit("r"), number(i)).alias("region_id"),
            F.lit("ocr_line").alias("label"),
            bounding_box(l["box"]).alias("bbox"),
            F.array().cast("array<struct<x:double,y:double>>").alias("polygon"),
            l["text"].alias("text"),
            F.create_map(F.lit("score"), l["score"].cast("string")).alias("attributes"),
        ),
    )
    fields = F.transform(
        lines,
        lambda l, i: F.struct(
            F.concat(F.lit("ocr_line_"), number(i)).alias("field_name"),
            l["text"].alias("value"),
            F.concat(F.lit("r"), number(i)).alias("region_id"),
            l["score"].alias("confidence"),
        ),
    )
    none = lambda t: F.array().cast(t)
    return docs.select(
        sample_id.alias("sample_id"),
        F.col("plugin").alias("doc_type"),
        regions.alias("regions"),
        fields.alias("fields"),
        none(RELATIONS_TYPE).alias("relations"),
        none(TAGS_TYPE).alias("quality_tags"),
    )
