"""Explicit schemas of requests, pages, results and responses; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PASSENGERS = T.ArrayType(_struct(type=S, count=L))

FLIGHT_REQUEST = _struct(
    request_id=S, from_airport=S, to_airport=S, depart_date=S, return_date=S, cabin_class=S, passengers=PASSENGERS, trip_type=S, max_stops=I, preferred_airlines=T.ArrayType(S)
)

HOTEL_REQUEST = _struct(
    request_id=S, version=I, adults=L, children_ages=T.ArrayType(I), loc_q_search=S, loc_ts_name=S, loc_ts_id=S, loc_ts_coords=S,
    checkin_date=S, checkout_date=S, nights=I, used_guests_dropdown=I, currency=S, sort_order=S, min_guest_rating=D,
    hotel_stars=T.ArrayType(I), amenities=T.ArrayType(S), min_price=I, max_price=I,
)

PAGE = _struct(request_id=S, url=S, status=I, html=S)

SEGMENT = _struct(
    airline=S, flight_number=S, departure_airport=S, arrival_airport=S, departure_time=S, arrival_time=S, arrival_plus_days=I, duration_minutes=I, aircraft=S
)
LAYOVER = _struct(_airport_code=S, airport_city=S, duration_minutes=I)
LAYOVERS = T.ArrayType(LAYOVER)
ITINERARY = _struct(request_id=S, pos=I, id=S, flights=T.ArrayType(SEGMENT), price=I, currency=S, duration_minutes=I, **{"class": S}, layovers=T.ArrayType(LAYOVER))

HOTEL = _struct(request_id=S, pos=I, name=S, price=S, rating=D, reviews=L, amenities=T.ArrayType(S), location_rating=S, star_class=S, url=S, address=S)

#: What the page extractors return, before any conversion: text as it stands in the page.
FLIGHT_CARD = _struct(airline=S, departure=S, arrival=S, plus_days=S, duration=S, price=S, layover_labels=T.ArrayType(S))
HOTEL_CARD = _struct(name=S, price=S, rating=S, reviews=S, amenities=T.ArrayType(S), location_rating=S, star_class=S, href=S)

FLIGHT_TOOL_INPUT = _struct(**{"from": S, "to": S, "date": S, "return_date": S, "seat": S, "adults": L, "children_ages": T.ArrayType(I), "trip_type": S, "max_stops": I})
HOTEL_TOOL_INPUT = _struct(
    location=S, checkin_date=S, checkout_date=S, adults=L, children_ages=T.ArrayType(I), min_guest_rating=D, stars=T.ArrayType(I), amenities=T.ArrayType(S), min_price=I, max_price=I
)

FLIGHT_RESPONSE = _struct(
    search_flights=_struct(
        total=L,
        query=_struct(**{"from": S, "to": S, "date": S, "curr": S, "seat": S, "search_url": S}),
        results=T.ArrayType(_struct(price=I, airlines=T.ArrayType(S), dur_min=I, layover=T.ArrayType(_struct(city=S, dur_min=I)))),
        warnings=T.ArrayType(S),
    )
)
HOTEL_RESPONSE = _struct(
    search_hotels=_struct(
        total=L,
        query=_struct(**{"loc": S, "in": S, "out": S, "curr": S, "search_url": S}),
        results=T.ArrayType(_struct(name=S, price=I, rating=D, stars=I, amenities=T.ArrayType(S))),
        warnings=T.ArrayType(S),
    )
)

TOKEN_VECTORS = _struct(
    total_cases=I,
    cases=T.ArrayType(
        _struct(
            name=S,
            input=_struct(
                from_airport=S, to_airport=S, depart_date=S, cabin_class=S, trip_type=S,
                passengers=_struct(adults=I, children=I, infants_in_seat=I, infants_on_lap=I), max_stops=I,
            ),
            expected_tfs=S,
        )
    ),
)

#: Response fields that may be left out, and the number that may be negative.
OPTIONAL = {"warnings", "layover", "stars", "amenities"}
UNBOUNDED = {"stars"}


def json_schema(kind: T.DataType, name: str = "") -> dict:
    """The JSON Schema (draft 07) of a response type: closed objects, numbers from 0 up."""
    if isinstance(kind, T.StructType):
        body = {
            "type": "object",
            "additionalProperties": False,
            "required": [f.name for f in kind.fields if f.name not in OPTIONAL],
            "properties": {f.name: json_schema(f.dataType, f.name) for f in kind.fields},
        }
        return body if name else {"$schema": "http://json-schema.org/draft-07/schema#"} | body
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, f"{name}[]")}
    if isinstance(kind, T.StringType):
        return {"type": "string"}
    number = {"type": "number" if isinstance(kind, T.DoubleType) else "integer"}
    return number if name in UNBOUNDED else number | {"minimum": 0}
