"""Household booklet, member page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.checks import birth_date_in_id, birth_digits_in_id, id_number_codes
from ..functions.structs import built_once
from ..functions.text import blank, booklet_gender, contains_any, iso_date, pick_or_keep, strip
from ..operators.labels import first_value, labelled_values
from .base import Family, Reading, issue, issue_list, issues_for_codes, missing, no_issues


def _marked_household_id(rows: Column) -> Column:
    """Number on the first line that mentions the household number anywhere."""
    line = F.get(F.filter(rows, lambda r: F.contains(r["text"], F.lit("户号"))), 0)["text"]
    return pick_or_keep(line, rules.HOUSEHOLD_ID)


def _line_below_address(rows: Column) -> Column:
    """Line below the first line that starts with the address label and has no colon."""
    below = F.transform(
        rows,
        lambda r, i: F.when(
            F.startswith(r["text"], F.lit("住址")) & ~contains_any(r["text"], [":", "："]),
            F.get(rows, i + 1)["text"],
        ),
    )
    return F.get(F.filter(below, lambda t: t.isNotNull()), 0)


@built_once
def _stages(aliases) -> tuple[Column, Column]:
    found = labelled_values(F.col("rows"), aliases or rules.BOOKLET_ALIASES)
    return found, pick_or_keep(first_value(F.col("_found"), "id_number"), rules.BOOKLET_ID_NUMBER)


@built_once
def _fields() -> dict[str, Column]:
    rows = F.col("rows")
    read = lambda name: first_value(F.col("_found"), name)
    return {
        "doc_type": F.lit("hukou_booklet"),
        "household_id": F.coalesce(pick_or_keep(read("household_id"), rules.HOUSEHOLD_ID), _marked_household_id(rows)),
        "householder_name": read("householder_name"),
        "address": F.coalesce(read("address"), _line_below_address(rows)),
        "member_name": read("member_name"),
        "relation_to_head": read("relation_to_head"),
        "gender": booklet_gender(read("gender")),
        "birth_date": F.coalesce(iso_date(read("birth_date")), birth_date_in_id(F.col("_id"))),
        "id_number": F.col("_id"),
    }


def hukou_booklet_reading(aliases=None) -> Reading:
    found, number = _stages(aliases)
    return Reading([{"_found": found}, {"_id": number}], _fields())


def extract_hukou_booklet(docs: DataFrame, aliases=None) -> DataFrame:
    return hukou_booklet_reading(aliases).of(docs)


def hukou_booklet_rules(fields: Column, as_of: Column, relations=None) -> Column:
    relations = relations or rules.RELATION_TOKENS
    id_number, birth = fields["id_number"], fields["birth_date"]
    gender, relation = fields["gender"], fields["relation_to_head"]
    has_id = ~blank(id_number)
    before = issue_list(
        issue(blank(fields["member_name"]) & blank(fields["householder_name"]), "missing_member_name", "member_name"),
        missing(fields, "household_id", "warning"),
        issue(~blank(gender) & ~gender.isin(rules.GENDERS), "invalid_gender", "gender", "warning"),
        issue(
            ~blank(relation) & ~contains_any(relation, relations),
            "invalid_relation_to_head", "relation_to_head", "warning",
        ),
    )
    number = F.when(has_id, issues_for_codes(id_number_codes(F.upper(strip(id_number)), as_of), "id_number"))
    carried = birth_digits_in_id(id_number)
    after = issue_list(
        issue(
            has_id & ~blank(birth) & carried.isNotNull() & (birth != carried),
            "birth_date_mismatch", "birth_date", "warning", "birth date does not match id number",
        ),
        issue(~has_id & ~blank(birth), "missing_id_number", "id_number", "warning"),
    )
    return F.concat(before, F.coalesce(number, no_issues()), after)


def hukou_booklet_score(accepted: Column, issues: Column) -> Column:
    clean = F.size(issues) == 0
    return F.when(~accepted, F.lit(0.0)).when(clean, F.lit(1.0)).otherwise(F.lit(0.8))


HUKOU_BOOKLET = Family(
    "hukou_booklet", rules=hukou_booklet_rules, score=hukou_booklet_score,
    description="household booklet member page", reading=hukou_booklet_reading,
    config={"fields": rules.EXPECTED_FIELDS["hukou_booklet"], "quality_rules": rules.QUALITY_RULES["hukou_booklet"]},
)
