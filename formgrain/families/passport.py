"""Passport with a two-line machine-readable zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.checks import mrz_check_digit, mrz_values
from ..functions.structs import built_once
from ..functions.text import comparable, compact, non_empty
from .base import Family, Reading, issue, issue_list

MRZ_FIELDS = [
    "document_code", "issuing_country", "surname", "given_names", "passport_number",
    "nationality", "birth_date", "sex", "expiry_date", "personal_number",
]


def mrz_pair(rows: Column) -> Column:
    """The two zone lines: from the first that opens a passport and has a successor, else the first two."""
    cleaned = F.transform(rows, lambda r: F.translate(compact(F.upper(r["text"])), "«", "<"))
    lines = F.filter(cleaned, lambda t: F.regexp_like(t, F.lit(rules.MRZ_LINE)))
    openers = F.transform(
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda t: F.startswith(t, F.lit("P<"))
    )
    start = F.greatest(F.array_position(openers, True), F.lit(1)).cast("int")
    return F.when(F.size(lines) >= 2, F.slice(lines, start, 2)).otherwise(F.array().cast("array<string>"))


def mrz_date(digits: Column) -> Column:
    """Six digits as ISO text; years from 50 belong to the last century."""
    century = F.when(F.substring(digits, 1, 2) >= "50", F.lit("19")).otherwise(F.lit("20"))
    iso = F.concat(century, F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
    return F.when(F.regexp_like(digits, F.lit(r"^[0-9]{6}\z")), iso)


def _plain(c: Column) -> Column:
    return F.btrim(F.translate(c, "<", " "))


def mrz_record(first: Column, second: Column) -> Column:
    """Fields by position, names split at the first double filler."""
    names = F.substring(first, 6, 39)
    gap = F.instr(names, "<<")
    family_name = F.when(gap > 0, F.substr(names, F.lit(1), gap - 1)).otherwise(names)
    given = F.when(gap > 0, F.substr(names, gap + 2)).otherwise(F.lit(""))
    part = lambda start, size: F.substring(second, start, size)
    return F.struct(
        F.substring(first, 1, 2).alias("document_code"),
        F.substring(first, 3, 3).alias("issuing_country"),
        _plain(family_name).alias("surname"),
        _plain(given).alias("given_names"),
        F.translate(part(1, 9), "<", "").alias("passport_number"),
        part(11, 3).alias("nationality"),
        mrz_date(part(14, 6)).alias("birth_date"),
        F.nullif(part(21, 1), F.lit("<")).alias("sex"),
        mrz_date(part(22, 6)).alias("expiry_date"),
        non_empty(F.rtrim(part(29, 14), F.lit("<"))).alias("personal_number"),
    )


@built_once
def _stages() -> tuple[Column, Column]:
    pair = F.col("_pair")
    return mrz_pair(F.col("rows")), F.when(F.size(pair) == 2, mrz_record(F.get(pair, 0), F.get(pair, 1)))


@built_once
def _fields() -> dict[str, Column]:
    return {
        "document_variant": F.lit("passport"),
        "mrz_lines": F.col("_pair"),
        "mrz_fields": F.col("_mrz"),
        **{f: F.col("_mrz")[f] for f in MRZ_FIELDS},
    }


def passport_reading() -> Reading:
    pair, record = _stages()
    return Reading([{"_pair": pair}, {"_mrz": record}], _fields())


def extract_passport(docs: DataFrame) -> DataFrame:
    return passport_reading().of(docs)


def mrz_codes(first: Column, second: Column) -> Column:
    """Failed check digits of a zone, in rule order.

    Every character is turned into its value once; each check then reads its positions.
    """
    values = mrz_values(second)
    digit = lambda at: F.substring(second, at, 1)
    span = lambda start, size: F.slice(values, start, size)
    whole = F.concat(span(1, 10), span(14, 7), span(22, 7), span(29, 15))
    checks = [
        ("passport_number_check_failed", span(1, 9), 10),
        ("birth_date_check_failed", span(14, 6), 20),
        ("expiry_date_check_failed", span(22, 6), 28),
        ("personal_number_check_failed", span(29, 14), 43),
        ("final_check_failed", whole, 44),
    ]
    failed = F.array(*[F.when(mrz_check_digit(v) != digit(at), F.lit(code)) for code, v, at in checks])
    readable = F.regexp_like(first, F.lit(rules.MRZ_LINE)) & F.regexp_like(second, F.lit(rules.MRZ_LINE))
    return F.when(readable, F.filter(failed, lambda x: x.isNotNull())).otherwise(F.array(F.lit("mrz_parse_failed")))


def passport_rules(fields: Column, as_of: Column) -> Column:
    lines = fields["mrz_lines"]
    codes = F.when(F.size(lines) == 2, mrz_codes(F.upper(F.get(lines, 0)), F.upper(F.get(lines, 1))))
    zone = F.transform(codes, lambda c: issue(F.lit(True), c, "mrz"))
    no_zone = F.array(issue(F.lit(True), "missing_mrz_lines", "mrz_lines", message="missing passport mrz lines"))
    visible = issue_list(
        *[
            issue(
                fields["mrz_fields"][f].isNotNull()
                & fields[f].isNotNull()
                & (comparable(fields["mrz_fields"][f]) != comparable(fields[f])),
                f"{f}_mismatch", f, message=f"{f} does not match mrz",
            )
            for f in rules.MRZ_COMPARED_FIELDS
        ]
    )
    return F.concat(F.coalesce(zone, no_zone), visible)


PASSPORT = Family("passport", rules=passport_rules, description="passport with machine-readable zone", reading=passport_reading)
