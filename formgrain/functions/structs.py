"""Columns of structs and arrays that the optimizer would otherwise compute repeatedly."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUILT: dict[tuple, Any] = {}


def built_once(make: Callable) -> Callable:
    """Keep the column expressions a function returns, per argument and driver connection.

    What was kept for an earlier connection is dropped. Building a large expression takes thousands of small calls into the JVM, and the
    expressions of a family are the same for every query and every micro-batch.
    """

    @functools.wraps(make)
    def wrapper(*args):
        key = (SparkContext._gateway, make.__module__, make.__qualname__, args)
        try:
            known = key in _BUILT
        except TypeError:  # an argument that cannot be a key
            return make(*args)
        if not known:
            for old in [k for k in _BUILT if k[0] is not SparkContext._gateway]:
                del _BUILT[old]
            _BUILT[key] = make(*args)
        return _BUILT[key]

    return wrapper


def pinned(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever is asked of them later.

    The optimizer copies a column's expression into every later mention of it, and into any
    filter on it that it moves towards the scan. With expressions over whole documents that
    costs repeated work and plans that grow without bound. An explode of one element computes
    its values where it stands and lets nothing through; it neither shuffles nor adds rows.
    """
    kept = [c for c in df.columns if c not in values]
    once = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_pinned")
    return df.select(*kept, once).select(*kept, *[F.col("_pinned")[k].alias(k) for k in values])


def with_fields(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the ``fields`` struct."""
    return pinned(docs, {"fields": F.struct(*[v.alias(k) for k, v in values.items()])})


def unfold(df: DataFrame, array: Column | str, *keep: str, numbered: bool = False) -> DataFrame:
    """One row per array element as ``item``, with its position ``pos`` when numbered.

    An inner explode makes the optimizer test the array for content below the explode, which
    computes the array a second time; the outer form with a test on its output does not.
    """
    if numbered:
        out = df.select(*keep, F.posexplode_outer(array).alias("pos", "item"))
        return out.where(F.col("pos").isNotNull())
    out = df.select(*keep, F.explode_outer(array).alias("item"))
    return out.where(F.col("item").isNotNull())
