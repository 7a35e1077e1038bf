"""Boarding passes and train tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.structs import built_once
from ..functions.text import contains_any, pick
from ..operators.lines import joined_text
from ..operators.places import anchor_box, line_tokens, nearest_name, places_in_order
from .base import Family, Reading, issue, issue_list, missing


def _absent() -> Column:
    return F.lit(None).cast("string")


@built_once
def _boarding_stages(airports: tuple[str, ...]) -> list[dict[str, Column]]:
    rows, tokens = F.col("rows"), F.col("_tokens")
    return [
        {"_tokens": line_tokens(rows)},
        {"_text": joined_text(rows), "_places": places_in_order(tokens, airports), "_anchor": anchor_box(rows, tokens)},
    ]


@built_once
def _boarding_fields(airports: tuple[str, ...]) -> dict[str, Column]:
    rows, text, places = F.col("rows"), F.col("_text"), F.col("_places")
    return {
        "document_variant": F.lit("boarding_pass"),
        "passenger_name": nearest_name(rows, F.col("_anchor"), rules.BOARDING_STOPWORDS + list(airports)),
        "flight_number": F.translate(pick(text, rules.FLIGHT_NUMBER, 1), " ", ""),
        "ticket_number": pick(text, rules.TICKET_NUMBER, 1),
        "departure_date": pick(text, rules.FLIGHT_DATE),
        "departure_airport": F.get(places, 0),
        "arrival_airport": F.get(places, 1),
        "gate": pick(text, rules.GATE),
        "seat_no": _absent(),
    }


def boarding_pass_reading(airports=None) -> Reading:
    airports = tuple(airports or rules.AIRPORTS)
    return Reading(_boarding_stages(airports), _boarding_fields(airports))


def extract_boarding_pass(docs: DataFrame, airports=None) -> DataFrame:
    return boarding_pass_reading(airports).of(docs)


def _train_number(rows: Column) -> Column:
    """Best-scored line whose first number-like token carries a letter; ties go to the greater text."""
    found = F.transform(
        rows,
        lambda r: F.struct(r["score"].alias("score"), pick(F.upper(r["text"]), rules.TRAIN_NUMBER, 1).alias("value")),
    )
    lettered = F.filter(found, lambda x: x["value"].isNotNull() & ~F.regexp_like(x["value"], F.lit(r"(?U)^\d+\z")))
    return F.array_max(lettered)["value"]


@built_once
def _train_stages(stations: tuple[str, ...], airports: tuple[str, ...]) -> list[dict[str, Column]]:
    rows, text, tokens = F.col("rows"), F.col("_text"), F.col("_tokens")
    flying = contains_any(F.upper(text), ["BOARDING", "FLIGHT"]) | F.contains(text, F.lit("登机牌"))
    named = F.when(F.col("_flying"), places_in_order(tokens, airports)).otherwise(places_in_order(tokens, stations))
    return [
        {"_text": joined_text(rows), "_tokens": line_tokens(rows)},
        {"_flying": flying, "_anchor": anchor_box(rows, tokens)},
        {"_places": named},
    ]


@built_once
def _train_fields(stations: tuple[str, ...], airports: tuple[str, ...]) -> dict[str, Column]:
    rows, text, flying, places = F.col("rows"), F.col("_text"), F.col("_flying"), F.col("_places")
    excluded = [*rules.TRAIN_STOPWORDS, *airports, *stations]
    return {
        "document_variant": F.when(flying, F.lit("boarding_pass_like")).otherwise(F.lit("train_ticket")),
        "ticket_number": pick(text, rules.TICKET_NUMBER, 1),
        "passenger_name": nearest_name(rows, F.col("_anchor"), excluded),
        "train_number": F.when(flying, F.translate(pick(text, rules.FLIGHT_NUMBER, 1), " ", ""))
        .otherwise(_train_number(rows)),
        "departure_station": F.get(places, 0),
        "arrival_station": F.get(places, 1),
        "departure_time": pick(text, rules.TRAIN_DEPARTURE),
        "seat_no": _absent(),
        "fare": _absent(),
        "gate": pick(text, rules.GATE),
    }


def train_ticket_reading(stations=None, airports=None) -> Reading:
    stations, airports = tuple(stations or rules.TRAIN_STATIONS), tuple(airports or rules.AIRPORTS)
    return Reading(_train_stages(stations, airports), _train_fields(stations, airports))


def extract_train_ticket(docs: DataFrame, stations=None, airports=None) -> DataFrame:
    return train_ticket_reading(stations, airports).of(docs)


def boarding_pass_rules(fields: Column, as_of: Column) -> Column:
    same = fields["departure_airport"] == fields["arrival_airport"]
    return issue_list(
        *[missing(fields, f) for f in rules.BOARDING_REQUIRED],
        issue(
            same & (fields["departure_airport"] != ""), "same_departure_arrival", "arrival_airport",
            message="departure and arrival cannot be same",
        ),
    )


def train_ticket_rules(fields: Column, as_of: Column) -> Column:
    return issue_list(*[missing(fields, f) for f in rules.TRAIN_REQUIRED])


BOARDING_PASS = Family(
    "boarding_pass", rules=boarding_pass_rules, description="boarding pass", reading=boarding_pass_reading,
    config={"fields": rules.EXPECTED_FIELDS["boarding_pass"], "quality_rules": rules.QUALITY_RULES["boarding_pass"]},
)
TRAIN_TICKET = Family(
    "train_ticket", rules=train_ticket_rules, description="train ticket", reading=train_ticket_reading,
    config={"fields": rules.EXPECTED_FIELDS["train_ticket"], "quality_rules": rules.QUALITY_RULES["train_ticket"]},
)
