"""Document families by name. Register your own with :func:`register`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import ISSUES_TYPE, Family, Reading, as_text_map, extract, has_severity, issues_of, strict_score, validate
from .china_id import CHINA_ID
from .hukou_booklet import HUKOU_BOOKLET
from .medical_record import MEDICAL_RECORD
from .passport import PASSPORT
from .tickets import BOARDING_PASS, TRAIN_TICKET

_FAMILIES: dict[str, Family] = {}


def register(family: Family) -> None:
    _FAMILIES[family.name] = family


def unregister(name: str) -> None:
    _FAMILIES.pop(name, None)


def registered(spark: SparkSession) -> DataFrame:
    """The registered families as a table, to join with what came in."""
    rows = [(f.name, f.version, f.description, list(f.backbones), list(f.tags), f.config.get("fields")) for f in map(get, names())]
    return spark.createDataFrame(rows, "name string, version string, description string, backbones array<string>, tags array<string>, fields array<string>")


def get(name: str) -> Family:
    return _FAMILIES[name]


def names() -> list[str]:
    return sorted(_FAMILIES)


for _family in (CHINA_ID, PASSPORT, HUKOU_BOOKLET, TRAIN_TICKET, BOARDING_PASS, MEDICAL_RECORD):
    register(_family)

__all__ = [
    "ISSUES_TYPE", "Family", "Reading", "as_text_map", "extract", "get", "has_severity", "issues_of", "names", "register", "registered", "strict_score",
    "unregister", "validate",
]
