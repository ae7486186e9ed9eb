"""Text, time, JSON and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Items are free-form objects: every key is kept, values as text (nested ones as JSON).
ITEMS_SCHEMA = "array<map<string,string>>"


#: A route as it is stored: its numbers are decimals.
_POINT = "struct<lat:decimal(20,10),lon:decimal(20,10)>"
ROUTE_STORED = f"array<struct<from:{_POINT},to:{_POINT},weight:decimal(20,10)>>"


def to_iso(ts: Column) -> Column:
    """ISO text as the event tables keep it: the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(micros.endswith(".000000"), whole).otherwise(micros)


def from_iso(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def parse_id(text: Column) -> Column:
    """Missing, empty and ``None`` are null, anything else an integer."""
    return F.nullif(F.trim(text), F.lit("None")).try_cast("bigint")


def coordinate_text(value: Column) -> Column:
    return value.cast("string")


def parse_coordinate(text: Column) -> Column:
    return text.try_cast("double")


def items_to_json(items: Column) -> Column:
    return F.to_json(items)


def items_from_json(text: Column) -> Column:
    return F.from_json(text, ITEMS_SCHEMA)


def items_variant(text: Column) -> Column:
    """Items of any shape: numbers stay numbers, objects and lists may nest. Text that is no JSON gives null."""
    return F.try_parse_json(text)


def variant_text(items: Column) -> Column:
    """Compact JSON; the keys of an object are in order."""
    return F.to_json(items)


def derived_event_id(*key: Column) -> Column:
    """Eight hex digits that a retried task produces again, unlike a random id."""
    return F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8)


def route_as(route: Column, number_type: str) -> Column:
    """A route with every number cast, e.g. to ``decimal(20,10)`` for storage or back to ``double``."""

    def point(p: Column) -> Column:
        return F.struct(p["lat"].cast(number_type).alias("lat"), p["lon"].cast(number_type).alias("lon"))

    return F.transform(
        route,
        lambda hop: F.struct(
            point(hop["from"]).alias("from"),
            point(hop["to"]).alias("to"),
            hop["weight"].cast(number_type).alias("weight"),
        ),
    )


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-even rounding for display; results keep raw values."""
    return F.bround(value, digits)
