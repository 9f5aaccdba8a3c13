"""Names for SQL: the Python functions, registered in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text, tokens
from ..operators import extract

TOOLS = {
    "search_flights": "Flight search over captured pages: from, to, date, return_date, seat, adults, children_ages, trip_type, max_stops",
    "search_hotels": "Hotel search over captured pages: location, checkin_date, checkout_date, adults, children_ages, min_guest_rating, stars, amenities, min_price, max_price",
}


#: What each argument of a tool is, and which must be given.
ARGUMENTS = {
    "search_flights": (
        schemas.FLIGHT_TOOL_INPUT,
        {
            "from": "origin airport code", "to": "destination airport code", "date": "departure date, YYYY-MM-DD", "return_date": "return date, YYYY-MM-DD", "seat": "cabin: economy, premium_economy, business, first",
            "adults": "number of adults", "children_ages": "age of each child", "trip_type": "round-trip or one-way", "max_stops": "most stops",
        },
        ["from", "to", "date", "adults"],
    ),
    "search_hotels": (
        schemas.HOTEL_TOOL_INPUT,
        {
            "location": "place to search", "checkin_date": "first night, YYYY-MM-DD", "checkout_date": "day of departure, YYYY-MM-DD", "adults": "number of adults", "children_ages": "age of each child, 1 to 17", "min_guest_rating": "least guest rating: 3.5, 4.0 or 4.5",
            "stars": "hotel classes, 2 to 5", "amenities": "amenity names", "min_price": "least price a night", "max_price": "highest price a night",
        },
        ["location", "checkin_date", "checkout_date", "adults"],
    ),
}


def input_schema(tool: str) -> dict:
    """The JSON Schema of a tool's arguments; ``request_id`` names the captured page."""
    kind, told, required = ARGUMENTS[tool]
    properties = {f.name: schemas.json_schema(f.dataType, f.name) | {"description": told[f.name]} for f in kind.fields}
    properties["request_id"] = {"type": "string", "description": "which captured page to read"}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": properties, "required": required}


class FlightsFromHtml:
    """Table function: ``SELECT * FROM pages, LATERAL flights_from_html(html)``."""

    def eval(self, html: str):
        for pos, c in enumerate(extract.flight_cards(html) if html is not None else []):
            yield (pos, *c.values())


class HotelsFromHtml:
    def eval(self, html: str):
        for pos, c in enumerate(extract.hotel_cards(html) if html is not None else []):
            yield (pos, *c.values())


#: SQL bodies of scalar functions; ``parse_duration`` and ``layovers`` are ``text``'s patterns.
SQL_FUNCTIONS = {
    "parse_duration": "(t STRING) RETURNS INT RETURN CASE WHEN t IS NOT NULL THEN coalesce(try_cast(regexp_extract(t, '(?U)(\\\\d+)\\\\s*h', 1) AS INT), 0) * 60 + coalesce(try_cast(regexp_extract(t, '(?U)(\\\\d+)\\\\s*m', 1) AS INT), 0) END",
}


@F.udf(schemas.LAYOVERS)
def _layovers(labels):
    """Rows of SQL callers; frames use the native column function."""
    return None if labels is None else text.find_layovers(labels)


def register(spark: SparkSession) -> list[str]:
    """Register codecs, card extractors, text and table functions; returns their names.

    ``tfs_encode`` and ``ts_encode`` take a request as a struct and don't validate it.
    """
    functions = {
        "tfs_encode": tokens.request_encoder(schemas.FLIGHT_REQUEST),
        "ts_encode": tokens.request_encoder(schemas.HOTEL_REQUEST),
        "layovers": _layovers,
        "tfs_decode": tokens._decoder(schemas.FLIGHT_REQUEST, tokens.decode_flight),
        "ts_decode": tokens._decoder(schemas.HOTEL_REQUEST, tokens.decode_hotel),
        "flight_cards": extract.flight_cards_udf(),
        "hotel_cards": extract.hotel_cards_udf(),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    tables = {"flights_from_html": (FlightsFromHtml, schemas.FLIGHT_CARD), "hotels_from_html": (HotelsFromHtml, schemas.HOTEL_CARD)}
    for name, (cls, schema) in tables.items():
        out = "pos int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.udtf.register(name, F.udtf(cls, returnType=out))
    return [*functions, *SQL_FUNCTIONS, *tables]
