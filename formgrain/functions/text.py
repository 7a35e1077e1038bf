"""Text cleaning and picking, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(rules.WHITESPACE))


def compact(c: Column) -> Column:
    """Remove all white space."""
    return F.translate(c, rules.WHITESPACE, "")


def squeeze_upper(c: Column) -> Column:
    """Upper case of stripped text with every run of white space as one blank.

    The pattern passes over single blanks, so most texts are left as they are.
    """
    return F.regexp_replace(F.upper(c), rules.LOOSE_BLANKS, " ")


def unspaced_upper(c: Column) -> Column:
    """Upper case without ASCII blanks: the form gazetteers and anchors are compared in."""
    return F.replace(F.upper(c), F.lit(" "), F.lit(""))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def non_empty(c: Column) -> Column:
    """The text unless it is empty. In conditions and lambdas ``nullif`` would compute its argument twice, nested ones more often."""
    return F.get(F.filter(F.array(c), lambda v: v != ""), 0)


def split_lines(c: Column) -> Column:
    return F.split(c, rules.LINE_BREAKS)


def pick(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null when there is none."""
    return non_empty(F.regexp_extract(c, pattern, group))


def pick_or_keep(c: Column, pattern: str) -> Column:
    """Upper-cased first match in the text without blanks, else the stripped text."""
    return let(c, lambda v: F.coalesce(F.upper(pick(F.translate(v, " ", ""), pattern)), strip(v)))


def after_mark(c: Column, mark: str) -> Column:
    """What follows the first occurrence of a mark, without label padding; null if it does not occur."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.btrim(F.substr(c, at + F.lit(len(mark))), F.lit(rules.LABEL_PADDING)))


def contains_any(c: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | F.contains(c, F.lit(token))
    return out


def ascii_digits(c: Column) -> Column:
    return F.translate(c, rules.FULLWIDTH_DIGITS, "0123456789")


def iso_date(c: Column) -> Column:
    """First date-like text as zero-padded ISO text. It is not checked against the calendar."""
    found = pick(c, rules.DATE_TEXT)
    numbers = lambda v: F.split(F.btrim(F.regexp_replace(v, "[^0-9]", " ")), " ")
    padded = lambda v: F.transform(numbers(v), lambda n: F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))
    return let(ascii_digits(found), lambda v: F.array_join(padded(v), "-"))


def split_items(c: Column) -> Column:
    """Enumerated items as an array; empty when the text is missing."""
    items = F.transform(F.split(c, rules.ITEM_SEPARATOR), strip)
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def booklet_gender(c: Column) -> Column:
    return let(
        strip(c),
        lambda v: F.when(F.contains(F.upper(v), F.lit("FEMALE")) | (v == "女"), F.lit("女"))
        .when(F.contains(F.upper(v), F.lit("MALE")) | (v == "男"), F.lit("男"))
        .otherwise(v),
    )


def record_gender(c: Column) -> Column:
    """Gender mentioned anywhere in the value; FEMALE is looked for before the MALE it contains."""
    return let(
        c,
        lambda v: F.when(F.contains(v, F.lit("男")), F.lit("男"))
        .when(F.contains(v, F.lit("女")), F.lit("女"))
        .when(F.contains(F.upper(v), F.lit("FEMALE")), F.lit("女"))
        .when(F.contains(F.upper(v), F.lit("MALE")), F.lit("男"))
        .otherwise(strip(v)),
    )


def age_text(c: Column) -> Column:
    return let(c, lambda v: F.coalesce(pick(v, rules.AGE_YEARS, 1), pick(v, r"(?U)\d+"), strip(v)))


def comparable(c: Column) -> Column:
    return F.upper(F.translate(F.coalesce(c, F.lit("")), " ", ""))


def message_of(code: Column) -> Column:
    return F.translate(code, "_", " ")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; the fixed in-memory name when there is no path."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.when(path.isNull(), F.lit("in_memory_sample")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+\z", ""))


def preview(c: Column, width: int = 120) -> Column:
    return F.substring(c, 1, width)
