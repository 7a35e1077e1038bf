"""What a document family is: an extraction and a validation, both DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structs import built_once, pinned, with_fields
from ..functions.text import blank, message_of
from ..operators.lines import with_rows

ISSUE_TYPE = "struct<code:string,message:string,severity:string,field:string>"
ISSUES_TYPE = "array<struct<seq:int,code:string,message:string,severity:string,field:string>>"


@dataclass(frozen=True)
class Reading:
    """Extraction as columns over ``rows``: named stages, each built on the ones before, then the fields.

    The names of stages start with ``_``. Families may share a name; the stages under it must have one type then.
    """

    stages: list[dict[str, Column]]
    fields: dict[str, Column]

    def of(self, docs: DataFrame) -> DataFrame:
        """Documents with the ``fields`` struct."""
        names = [name for stage in self.stages for name in stage]
        for stage in self.stages:
            docs = docs.withColumns(stage)
        return with_fields(docs, self.fields).drop(*names)


@dataclass(frozen=True)
class Family:
    """``reading`` describes the extraction as columns, so that all families are read in one pass over a mixed table;
    ``extract``, for what columns cannot express, adds a ``fields`` struct to documents that carry ``rows`` and gets a
    pass of its own. ``rules`` turns that struct into an array of issues; ``score`` grades the outcome."""

    name: str
    extract: Callable[[DataFrame], DataFrame] | None = None
    rules: Callable[[Column, Column], Column] | None = None
    score: Callable[[Column, Column], Column] | None = None
    version: str = "0.1.0"
    description: str = ""
    backbones: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("document-plugin",)
    config: dict = field(default_factory=dict)
    reading: Callable[[], Reading] | None = None

    def columns(self) -> Reading:
        """The reading; a family without a parser yields its name as only field."""
        return self.reading() if self.reading else Reading([], {"doc_type": F.lit(self.name)})


def issue(when: Column, code: str | Column, field_name: str, severity: str = "error", message: str | None = None) -> Column:
    """One issue when the condition holds, else null."""
    code = F.lit(code) if isinstance(code, str) else code
    text = F.lit(message) if message else message_of(code)
    return F.when(
        when,
        F.struct(
            code.alias("code"), text.alias("message"),
            F.lit(severity).alias("severity"), F.lit(field_name).alias("field"),
        ),
    )


def issues_for_codes(codes: Column, field_name: str, severity: str = "error") -> Column:
    """One issue per code of an array."""
    return F.transform(codes, lambda c: issue(F.lit(True), c, field_name, severity))


def issue_list(*parts: Column) -> Column:
    """Array of the issues that hold, in rule order."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE_TYPE}>")


def missing(fields: Column, name: str, severity: str = "error") -> Column:
    return issue(blank(fields[name]), f"missing_{name}", name, severity)


def numbered(issues: Column) -> Column:
    return F.transform(
        issues,
        lambda x, i: F.struct(
            (i + 1).alias("seq"), x["code"].alias("code"), x["message"].alias("message"),
            x["severity"].alias("severity"), x["field"].alias("field"),
        ),
    )


def has_severity(issues: Column, severity: str) -> Column:
    return F.exists(issues, lambda x: x["severity"] == severity)


def strict_score(accepted: Column, issues: Column) -> Column:
    return F.when(accepted, F.lit(1.0)).otherwise(F.lit(0.0))


def extract(docs: DataFrame, family: Family) -> DataFrame:
    """Add ``rows`` and ``fields``; a family without a parser yields no fields."""
    return family.extract(with_rows(docs)) if family.extract else family.columns().of(with_rows(docs))


@built_once
def issues_of(family_rules: Callable | None, as_of: str | None, fields: str = "fields") -> Column:
    """Numbered issues of the struct column ``fields``."""
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return numbered(family_rules(F.col(fields), today) if family_rules else no_issues())


def validate(docs: DataFrame, family: Family, as_of: str | None = None) -> DataFrame:
    """Add ``issues``, ``accepted`` and ``score``. A family without rules accepts everything.

    ``as_of`` (ISO text) is the day birth dates may not lie after; by default today.
    """
    out = pinned(docs, {"issues": issues_of(family.rules, as_of)})
    out = out.withColumn("accepted", ~has_severity(F.col("issues"), "error"))
    score = family.score or strict_score
    return out.withColumn("score", score(F.col("accepted"), F.col("issues")))


def as_text_map(docs: DataFrame, fields: str = "fields") -> Column:
    """The struct column ``fields`` as a map of text; lists and structs as JSON, nulls kept."""
    entries = []
    for f in docs.schema[fields].dataType.fields:
        value = F.col(fields)[f.name]
        if f.dataType.typeName() in ("array", "struct", "map"):
            value = F.to_json(value)
        entries += [F.lit(f.name), value.cast("string")]
    return F.create_map(*entries)
