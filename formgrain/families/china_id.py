"""Resident identity card, front or back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.checks import id_number_codes
from ..functions.structs import built_once
from ..functions.text import after_mark, blank, compact, contains_any, non_empty, pick, strip
from .base import Family, Reading, issue, issue_list, issues_for_codes

FIELDS = [
    "document_side", "name", "gender", "ethnicity", "birth_date", "address",
    "id_number", "issuing_authority", "valid_from", "valid_to",
]


def is_back(rows: Column) -> Column:
    back = F.exists(rows, lambda r: contains_any(r["text"], rules.ID_BACK_MARKS))
    front = F.exists(rows, lambda r: F.contains(r["text"], F.lit(rules.ID_FRONT_MARK)))
    return back & ~front


def _first(lines: Column, read) -> Column:
    return F.get(F.filter(F.transform(lines, read), lambda v: v.isNotNull()), 0)


def _last(lines: Column, read) -> Column:
    return F.try_element_at(F.filter(F.transform(lines, read), lambda v: v.isNotNull()), F.lit(-1))


def _marked(lines: Column, mark: str) -> Column:
    return _first(lines, lambda t: non_empty(after_mark(t, mark)))


def _address(lines: Column) -> Column:
    """Text from the first address mark up to the line that carries the number label.

    Bare labels in between are skipped; a later address mark adds what follows it.
    """
    opens = lambda t: F.contains(t, F.lit("住址"))
    start = F.array_position(F.transform(lines, opens), True)
    section = F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))
    closes = F.transform(section, lambda t: contains_any(t, rules.ID_NUMBER_LABELS) & ~opens(t))
    stop = F.array_position(closes, True)
    body = F.slice(section, 1, F.when(stop > 0, stop - 1).otherwise(F.size(section)).cast("int"))
    chunks = F.transform(
        body,
        lambda t: F.when(opens(t), after_mark(t, "住址")).when(t.isin(rules.ID_BARE_LABELS), F.lit("")).otherwise(t),
    )
    return F.when(start > 0, non_empty(F.array_join(chunks, "")))


def _validity(lines: Column) -> tuple[Column, Column]:
    """Start and end of validity: the first written range, else what the last validity label carries."""
    ranged = F.filter(lines, lambda t: F.regexp_like(t, F.lit(rules.VALIDITY_RANGE)))
    written = F.get(ranged, 0)
    split = lambda t: F.split(non_empty(after_mark(t, "有效期限")), rules.VALIDITY_SEPARATOR, 2)
    start = F.when(written.isNotNull(), F.regexp_extract(written, rules.VALIDITY_RANGE, 1))
    end = F.when(written.isNotNull(), F.regexp_extract(written, rules.VALIDITY_RANGE, 2))
    loose_start = _last(lines, lambda t: F.get(split(t), 0))
    loose_end = _last(lines, lambda t: F.get(split(t), 1))
    return (
        F.when(written.isNotNull(), start).otherwise(loose_start),
        F.when(written.isNotNull(), end).otherwise(loose_end),
    )


@built_once
def _stages() -> dict[str, Column]:
    return {"_lines": F.transform("rows", lambda r: compact(r["text"])), "_back": is_back(F.col("rows"))}


@built_once
def _fields() -> dict[str, Column]:
    lines, back = F.col("_lines"), F.col("_back")
    front = lambda c: F.when(~back, c)
    valid_from, valid_to = _validity(lines)
    return {
        "document_side": F.when(back, F.lit("back")).otherwise(F.lit("front")),
        "name": front(_marked(lines, "姓名")),
        "gender": front(_last(lines, lambda t: pick(t, rules.ID_GENDER, 1))),
        "ethnicity": front(_last(lines, lambda t: pick(t, rules.ID_ETHNICITY, 1))),
        "birth_date": front(_marked(lines, "出生")),
        "address": front(_address(lines)),
        "id_number": front(F.upper(_first(lines, lambda t: pick(t, rules.ID_NUMBER)))),
        "issuing_authority": F.when(back, _marked(lines, "签发机关")),
        "valid_from": F.when(back, valid_from),
        "valid_to": F.when(back, valid_to),
    }


def china_id_reading() -> Reading:
    return Reading([_stages()], _fields())


def extract_china_id(docs: DataFrame) -> DataFrame:
    return china_id_reading().of(docs)


def id_number_issues(id_number: Column, as_of: Column) -> Column:
    """Issues of an identity number; a missing one is an issue by itself."""
    codes = id_number_codes(F.upper(strip(id_number)), as_of)
    gone = F.array(issue(F.lit(True), "missing_id_number", "id_number", message="ID number is missing"))
    return F.when(blank(id_number), gone).otherwise(issues_for_codes(codes, "id_number"))


def china_id_rules(fields: Column, as_of: Column) -> Column:
    """Both sides are judged by the number, so a back side is never accepted."""
    return id_number_issues(fields["id_number"], as_of)


def china_id_side_rules(fields: Column, as_of: Column) -> Column:
    """Optional variant: a back side is judged by its authority and dates instead."""
    back = issue_list(
        *[issue(blank(fields[f]), f"missing_{f}", f) for f in ("issuing_authority", "valid_from", "valid_to")]
    )
    return F.when(fields["document_side"] == "back", back).otherwise(id_number_issues(fields["id_number"], as_of))


CHINA_ID = Family("china_id", rules=china_id_rules, description="resident identity card", reading=china_id_reading)
