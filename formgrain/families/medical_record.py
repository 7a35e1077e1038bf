"""Outpatient medical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.structs import built_once
from ..functions.text import age_text, iso_date, record_gender, split_items
from ..operators.labels import first_value, labelled_values
from ..operators.lines import joined_text
from .base import Family, Reading, issue_list, missing


@built_once
def _found(aliases) -> Column:
    return labelled_values(F.col("rows"), aliases or rules.RECORD_ALIASES)


@built_once
def _fields() -> dict[str, Column]:
    read = lambda name: first_value(F.col("_found"), name)
    rows = F.col("rows")
    heading = F.get(F.filter(F.slice(rows, 1, 3), lambda r: F.contains(r["text"], F.lit("医院"))), 0)["text"]
    dated = read("visit_date")
    return {
        "doc_type": F.lit("medical_record"),
        "hospital_name": F.coalesce(read("hospital_name"), heading),
        "patient_name": read("patient_name"),
        "gender": record_gender(read("gender")),
        "age": age_text(read("age")),
        # The whole text is searched only when no line is labelled as the date.
        "visit_date": F.when(dated.isNotNull(), iso_date(dated)).otherwise(iso_date(joined_text(rows))),
        "department": read("department"),
        "diagnosis": split_items(read("diagnosis")),
        "medications": split_items(read("medications")),
        "notes": read("notes"),
    }


def medical_record_reading(aliases=None) -> Reading:
    return Reading([{"_found": _found(aliases)}], _fields())


def extract_medical_record(docs: DataFrame, aliases=None) -> DataFrame:
    return medical_record_reading(aliases).of(docs)


def medical_record_rules(fields: Column, as_of: Column) -> Column:
    return issue_list(missing(fields, "patient_name"), missing(fields, "visit_date", "warning"))


def medical_record_score(accepted: Column, issues: Column) -> Column:
    return F.when(accepted, F.lit(1.0)).otherwise(F.lit(0.5))


MEDICAL_RECORD = Family(
    "medical_record", rules=medical_record_rules, score=medical_record_score,
    description="outpatient medical record", reading=medical_record_reading,
    config={"fields": rules.EXPECTED_FIELDS["medical_record"], "quality_rules": rules.QUALITY_RULES["medical_record"]},
)
