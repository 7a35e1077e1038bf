"""Exact positional splits and hash splits of a dataset."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType

#: Quantiles read off the sketch of a pass, and its accuracy: ranks are off by at most one in so many rows.
QUANTILES, ACCURACY = 2_000, 20_000
#: Most different keys between two quantiles that are counted one by one; with more, that range gets a sketch of its own.
COUNTED = 100_000
#: Bytes of a text that one number holds in order; the sketch counts in double precision.
PREFIX = 6


def _number(keys: DataFrame, skip: int) -> Column:
    """``k`` as something that quantiles can be taken of, in an order that never contradicts that of ``k``, though it
    may hold different keys for equal: a number in double precision, for texts the bytes from ``skip`` on."""
    kind = keys.schema["k"].dataType
    if isinstance(kind, DatetimeType):
        return F.col("k")
    if isinstance(kind, NumericType):
        return F.col("k").cast("double")
    if kind.typeName() == "boolean":
        return F.col("k").cast("int")
    held = F.hex(F.substring(F.col("k").cast("binary"), 1 + skip, PREFIX))
    return F.conv(F.rpad(held, 2 * PREFIX, "0"), 16, 10).cast("bigint")


def _sketched(number: str) -> Column:
    points = ", ".join(f"{i / QUANTILES}D" for i in range(QUANTILES + 1))
    return F.expr(f"percentile_approx({number}, array({points}), {ACCURACY})").alias("quantiles")


def key_at(keys: DataFrame, position: int, total: int | None = None, quantiles: list | None = None, skip: int = 0) -> tuple[object, int, int]:
    """The value of ``k`` at a 0-based position of the ascending order, the position among its equals, and their number.

    ``k`` is never null. A mergeable quantile sketch (``total`` and ``quantiles``, if the caller has it) brackets the
    position; one exact count of the keys in the bracket and of the rows below it finds the key. That is two passes, in
    which counts move and no row does. Only a bracket of more than ``COUNTED`` different keys takes more: it is narrowed
    to one number, or to what lies between two neighbouring quantiles, a thousandth of the rows.
    """
    number = _number(keys, skip)
    if quantiles is None:
        total, quantiles = keys.select(number.alias("q")).agg(F.count("*"), _sketched("q")).first()
    # One quantile further on both sides than the sketch's error can reach.
    near = position / total * QUANTILES
    low, high = F.lit(quantiles[max(0, math.floor(near) - 2)]), F.lit(quantiles[min(QUANTILES, math.ceil(near) + 2)])
    place = F.when(number < low, 0).when(number == low, 1).when(number < high, 2).when(number == high, 3).otherwise(4)

    def counted(value: Column, places: list[int]) -> list | None:
        """Rows (value, count) at the places, below them first under the value null; none if they are too many."""
        known = keys.where(place <= max(places)).groupBy(F.when(place.isin(places), value).alias("v")).agg(F.count("*").alias("n")).limit(COUNTED + 1).collect()
        return sorted((r for r in known if r["v"] is None), key=len) + sorted((r for r in known if r["v"] is not None), key=lambda r: r["v"]) if len(known) <= COUNTED else None

    def at(rows: list, position: int) -> tuple[object, int, int]:
        for r in rows:
            if position < r["n"]:
                return r["v"], position, r["n"]
            position -= r["n"]
        raise AssertionError("the sketch missed the position")

    rows = counted(F.col("k"), [1, 2, 3])
    if rows is not None:
        return at(rows, position)
    chosen, rest, _ = at(counted(place, [1, 2, 3]), position)
    if chosen == 2:
        rows = counted(number, [2])
        if rows is None:
            return key_at(keys.where(place == 2), rest, skip=skip)
        value, rest, _ = at(rows, position)
        number_is = number == F.lit(value)
    else:
        number_is = place == chosen
    return key_at(keys.where(number_is), rest, skip=skip + PREFIX)


def positional_split(samples: DataFrame, order_key: str, train_ratio: float = 0.8, tie_key: str | None = None) -> DataFrame:
    """Add ``split``: the first ``int(n * ratio)`` rows in order of ``order_key``, then ``tie_key``, are ``train``, the rest ``val``.

    Null keys come first. Rows that share the key at the boundary need a ``tie_key`` that is never null and tells them apart;
    without one the split is refused rather than wrong. The key column is read twice (store an input that is dear to
    compute, or that changes, first), its rows at the boundary up to three times more if it takes a tie key; then the
    split is a plain comparison, so no row is ever sorted or shuffled.
    """
    key = F.col(order_key)
    keys = samples.select(key.alias("k"), (F.col(tie_key) if tie_key else F.lit(None).cast("string")).alias("t"))
    total, known, quantiles = keys.select(_number(keys, 0).alias("q")).agg(F.count("*"), F.count("q"), _sketched("q")).first()
    pivot = math.floor(total * train_ratio)
    if pivot <= 0:
        return samples.withColumn("split", F.lit("val"))
    if pivot >= total:
        return samples.withColumn("split", F.lit("train"))
    nulls = total - known
    if pivot <= nulls:
        before, at, equals, rest = F.lit(False), key.isNull(), keys.where("k IS NULL"), pivot
        if pivot == nulls:
            before, rest = at, 0
    else:
        boundary, rest, _ = key_at(keys.where("k IS NOT NULL").select("k"), pivot - nulls, known, quantiles)
        before, at, equals = key.isNull() | (key < F.lit(boundary)), key == F.lit(boundary), keys.where(F.col("k") == F.lit(boundary))
    if rest:
        rows, told, different = equals.agg(F.count("*"), F.count("t"), F.count_distinct("t")).first()
        if not rows == told == different:
            raise ValueError(f"{rows} rows share the {order_key} at the boundary; a tie_key must tell them apart")
        tie, _, _ = key_at(equals.select(F.col("t").alias("k")), rest)
        before = before | (at & (F.col(tie_key) < F.lit(tie)))
    return samples.withColumn("split", F.when(F.coalesce(before, F.lit(False)), F.lit("train")).otherwise(F.lit("val")))


def hash_share(key: str, shares: int = 10_000) -> Column:
    """One of ``shares`` shares of a key's values: the first 32 bits of the MD5 of its text."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % shares


def hash_split(samples: DataFrame, key: str, train_ratio: float = 0.8) -> DataFrame:
    """A split that a row keeps when others come and go; sizes are only approximate. A null key goes to ``val``."""
    return samples.withColumn(
        "split", F.when(hash_share(key) < F.lit(int(10_000 * train_ratio)), F.lit("train")).otherwise(F.lit("val"))
    )


def layers(samples: DataFrame, key: str, is_golden: Column, is_hard: Column, train_ratio: float = 0.8) -> DataFrame:
    """Add ``layer``: golden rows, then hard ones, then train and validation by hash of the key."""
    split = hash_split(samples, key, train_ratio)
    layer = F.when(is_golden, F.lit("golden")).when(is_hard, F.lit("hard")).otherwise(F.col("split"))
    return split.withColumn("layer", layer).drop("split")


def hard_share(samples: DataFrame, is_hard: Column, minimum: float = 0.2) -> DataFrame:
    """Share of hard samples per split and whether it reaches the required minimum."""
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count(F.when(is_hard, 1)).alias("num_hard"),
    ).withColumn("enough_hard", F.col("num_hard") >= F.col("num_samples") * minimum)


def key_hash(key: str) -> Column:
    """The first 60 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def working_set(samples: DataFrame, key: str, is_hard: Column, size: int, share: float = 0.2) -> DataFrame:
    """At most ``size`` rows, of which at least ``share`` are hard, drawn by hash of the key: rows come and go without
    moving the others, and a repeated run draws the same.

    Hard rows fill their share, and more if there are too few others; others are taken only as far as the hard ones at
    hand allow. Each stratum keeps the rows whose hash lies below an exact threshold, found by ``key_at``, so no row is
    sorted or shuffled. ``key`` tells rows apart; copies of a key stay together, and if the last places of a stratum
    would cut through them they are left out. Rows whose hardness is null count as not hard.
    """
    hard = F.coalesce(is_hard, F.lit(False))
    hashed = samples.select(key_hash(key).alias("k"), hard.alias("hard"))
    num_hard, num_easy = hashed.agg(F.count(F.when(F.col("hard"), 1)), F.count(F.when(~F.col("hard"), 1))).first()
    least = Fraction(str(share))

    def threshold(stratum: DataFrame, have: int, want: int) -> tuple[int, int]:
        """The hash below which rows are taken, and their number."""
        if want >= have:
            return 1 << 60, have
        boundary, before, _ = key_at(stratum.select("k"), want)
        return boundary, want - before

    below_hard, taken = threshold(hashed.where("hard"), num_hard, max(math.ceil(size * least), size - num_easy))
    rest = size - taken if not least else min(size - taken, math.floor(taken / least) - taken)
    below_easy, _ = threshold(hashed.where("NOT hard"), num_easy, max(0, rest))
    return samples.where(key_hash(key) < F.when(hard, F.lit(below_hard)).otherwise(F.lit(below_easy)))


def dataset_summary(samples: DataFrame) -> DataFrame:
    """Number of samples and sorted distinct document types; a missing type counts as ``unknown``."""
    per_type = samples.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_samples"),
        F.array_sort(F.collect_list("doc_type")).alias("doc_types"),
    )
