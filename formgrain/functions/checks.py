"""Check digits and calendar checks of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import ascii_digits, let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def id_check_char(id_number: Column) -> Column:
    """Check character of an 18-character identity number, computed from its first 17 digits."""
    digits = F.transform(F.split(F.substring(id_number, 1, 17), ""), lambda d: F.ascii(d) - F.lit(48))
    weights = F.array(*[F.lit(w) for w in rules.ID_WEIGHTS])
    total = _total(F.zip_with(digits, weights, lambda d, w: d * w))
    return F.substring(F.lit(rules.ID_CHECK_CHARS), total % 11 + 1, F.lit(1))


def mrz_values(text: Column) -> Column:
    """Numeric value of every character: digits as they are, letters from 10, filler 0."""
    return F.transform(
        F.split(text, ""),
        lambda ch: F.greatest(F.instr(F.lit(rules.MRZ_ALPHABET), ch) - 1, F.lit(0)),
    )


def mrz_check_digit(values: Column) -> Column:
    """Check digit over an array of character values, as text."""
    weights = F.array(*[F.lit(w) for w in rules.MRZ_WEIGHTS])
    weighted = F.transform(values, lambda v, i: v * F.get(weights, i % 3))
    return (_total(weighted) % 10).cast("string")


def compact_date(digits: Column) -> Column:
    """Calendar date of eight digits, null when there is no such day."""
    return F.when(F.substring(digits, 1, 4) != "0000", F.try_to_date(digits, "yyyyMMdd"))


def birth_date_in_id(id_number: Column) -> Column:
    """Birth date carried by an identity number, ISO text; null unless it is a real day."""
    shaped = (F.length(id_number) == 18) & F.regexp_like(id_number, F.lit(r"(?U)^\d{17}"))
    day = compact_date(ascii_digits(F.substring(id_number, 7, 8)))
    return F.when(shaped, F.date_format(day, "yyyy-MM-dd"))


def birth_digits_in_id(id_number: Column) -> Column:
    """The same eight digits with dashes, whether or not they name a real day."""
    shaped = (F.length(id_number) == 18) & F.regexp_like(id_number, F.lit(r"(?U)^\d{17}"))
    part = lambda start, size: F.substring(id_number, start, size)
    return F.when(shaped, F.concat_ws("-", part(7, 4), part(11, 2), part(13, 2)))


def id_number_codes(id_number: Column, as_of: Column) -> Column:
    """Codes of everything wrong with a non-empty, normalised identity number, in rule order."""
    return let(id_number, lambda v: _id_number_codes(v, as_of))


def _id_number_codes(id_number: Column, as_of: Column) -> Column:
    birth = compact_date(ascii_digits(F.substring(id_number, 7, 8)))
    region_bad = ~F.substring(id_number, 1, 2).isin(rules.PROVINCE_CODES) | (F.substring(id_number, 1, 6) == "000000")
    birth_bad = F.coalesce(birth > as_of, F.lit(True))
    check_bad = F.substring(id_number, 18, 1) != id_check_char(ascii_digits(id_number))
    deep = F.array(
        F.when(region_bad, F.lit("region_code_invalid")),
        F.when(birth_bad, F.lit("birth_date_invalid")),
        F.when(check_bad, F.lit("checksum_invalid")),
    )
    return (
        F.when(F.length(id_number) != 18, F.array(F.lit("length_invalid")))
        .when(~F.regexp_like(id_number, F.lit(r"(?U)^\d{17}[\dX]\z")), F.array(F.lit("format_invalid")))
        .otherwise(F.filter(deep, lambda x: x.isNotNull()))
    )
