"""Boxes of recognised lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import FAR_AWAY
from .text import let

def bounding_box(quad: Column) -> Column:
    """Axis-aligned box around four corner points; null for anything else."""

    def around(q: Column) -> Column:
        xs, ys = ([F.get(F.get(q, i), j) for i in range(4)] for j in (0, 1))
        whole = reduce(Column.__and__, [v.isNotNull() for v in xs + ys], F.size(q) == 4)
        return F.when(
            whole,
            F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2")),
        )

    return let(quad, around)


def centre_distance(a: Column, b: Column) -> Column:
    """Manhattan distance of box centres; very far when either box is missing."""

    def apart(p: Column) -> Column:
        dx = (p["x1"] + p["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
        dy = (p["y1"] + p["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
        return F.coalesce(F.abs(dx) + F.abs(dy), F.lit(FAR_AWAY))

    return let(a, apart)
