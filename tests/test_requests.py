"""Validation order and messages, constructors and builders."""

import pytest
from pyspark.sql import functions as F

from tripquarry import schemas
from tripquarry.operators import requests
from tripquarry.sources import readers

FLIGHT = {"request_id": "1", "from_airport": "SFO", "to_airport": "JFK", "depart_date": "2025-07-15", "return_date": None, "cabin_class": "economy", "passengers": [("adult", 1)], "trip_type": "round_trip", "max_stops": None, "preferred_airlines": None}
HOTEL = dict(zip(schemas.HOTEL_REQUEST.names, ("1", 1, 2, [], "Oslo", "", "", "", "2026-01-25", "2026-01-31", 0, 0, "USD", None, None, [], [], None, None)))


def error(spark, schema, base, change, rule):
    row = base | change
    return spark.createDataFrame([tuple(row[n] for n in schema.names)], schema).select(rule.alias("e")).first()["e"]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({}, None),
        ({"from_airport": "", "to_airport": ""}, "Origin airport is required"),
        ({"to_airport": None}, "Destination airport is required"),
        ({"passengers": []}, "At least one adult is required"),
        ({"passengers": None}, "At least one adult is required"),
        ({"passengers": [("adult", 0), ("child", 1)]}, "At least one adult is required"),
        ({"passengers": [("infant_in_seat", 1)]}, "At least one adult is required"),
        ({"passengers": [("adult", 1), ("infant_on_lap", 1), ("infant", 1)]}, "Cannot have more infants on lap (2) than adults (1)"),
        ({"passengers": [("adult", 1), ("adult", 1), ("infant_on_lap", 2)]}, None),
        ({"depart_date": "2025-02-30"}, "Invalid depart date format"),
        ({"return_date": "soon"}, "Invalid return date format"),
        ({"return_date": "2025-07-14"}, "Return date must be on or after departure date"),
        ({"return_date": "2025-07-15"}, None),
        ({"return_date": "2025-07-14", "trip_type": "one_way"}, None),
    ],
)
def test_flight_rules(spark, change, message):
    assert error(spark, schemas.FLIGHT_REQUEST, FLIGHT, change, requests.flight_error()) == message


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({}, None),
        ({"adults": 1, "children_ages": [5]}, None),
        ({"adults": 0}, "At least one adult is required"),
        ({"adults": 5, "children_ages": [5] * 5}, "Maximum 6 guests allowed"),
        ({"children_ages": [0]}, "Children ages must be between 1 and 17 (ages 0-1 are encoded as 1)"),
        ({"checkin_date": "x", "checkout_date": "y"}, "Invalid checkin date"),
        ({"checkout_date": "y"}, "Invalid checkout date"),
        ({"checkout_date": "2026-01-24"}, "Checkout must be after check-in"),
        ({"checkout_date": "2026-02-25"}, "Stay must be 30 nights or fewer"),
        ({"max_price": 0}, "Price must be positive"),
        ({"min_price": -1}, "Price must be positive"),
        ({"min_price": 9, "max_price": 8}, "Minimum price cannot be greater than maximum price"),
        ({"hotel_stars": [1]}, "Star rating must be between 2 and 5"),
    ],
)
def test_hotel_rules(spark, change, message):
    assert error(spark, schemas.HOTEL_REQUEST, HOTEL, change, requests.hotel_error()) == message


def test_dates_against_today(spark):
    today = F.to_date(F.lit("2025-07-16"))
    assert error(spark, schemas.FLIGHT_REQUEST, FLIGHT, {}, requests.flight_date_error(today)) == "Departure date cannot be in the past"
    assert error(spark, schemas.FLIGHT_REQUEST, FLIGHT, {"depart_date": "2025-07-16"}, requests.flight_date_error(today)) is None


def test_tool_inputs(spark):
    rows = [("a", '{"from":"LHR","to":"IST","date":"2025-07-15","adults":2,"children_ages":[5,8],"trip_type":"round-trip","max_stops":2}'), ("b", "nonsense")]
    got = requests.flight_requests_from_tool(readers.parse_flight_inputs(spark.createDataFrame(rows, "request_id string, input string"))).orderBy("request_id").collect()
    assert (got[0]["cabin_class"], got[0]["trip_type"], got[0]["max_stops"]) == ("economy", "round_trip", 2)
    assert [(p["type"], p["count"]) for p in got[0]["passengers"]] == [("adult", 2), ("child", 2)]
    assert got[1]["from_airport"] is None
    hotel = requests.hotel_requests_from_tool(readers.parse_hotel_inputs(spark.createDataFrame([("a", '{"location":"x","checkin_date":"2026-01-25","checkout_date":"2026-01-31","adults":2,"amenities":["pool","swiming_pool","spa"]}')], "request_id string, input string"))).first()
    assert hotel["amenities"] == ["pool", "spa"] and hotel["warnings"][0].startswith("Unknown amenity(s): swiming_pool. Valid amenities: indoor_pool")


def test_builders(spark):
    day = F.to_date(F.lit("2025-07-15"))
    built = requests.FlightBuilder(F.lit("SFO"), F.lit("JFK"), day).max_stops(F.lit(0)).trip_type(F.lit("one_way")).build(spark.range(1), F.col("id")).first()
    assert (built["depart_date"], built["max_stops"], built["validation_error"]) == ("2025-07-15", None, None)
    stay = requests.HotelBuilder(F.lit("Oslo"), day, F.date_add(day, 3)).adults(F.lit(1)).price_range(F.lit(10), None).build(spark.range(1), F.col("id")).first()
    assert (stay["nights"], stay["min_price"], stay["validation_error"]) == (3, 10, None)


def test_arguments(spark):
    row = {"request_id": "1", "from": "sfo", "to": "jfk", "date": "2025/07/15", "return_date": None, "cabin": "PE", "adults": "2", "children": "0", "infants_in_seat": "0", "infants_on_lap": "1", "trip": "RT", "max_stops": "0", "airlines": "UA, LH"}
    got = readers.flight_arguments(spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` string" for n in row))).first()
    assert (got["from_airport"], got["depart_date"], got["cabin_class"], got["trip_type"], got["max_stops"], got["preferred_airlines"]) == ("SFO", "2025-07-15", "premium_economy", "round_trip", None, ["UA", "LH"])


def test_hotel_arguments_without_prices(spark):
    row = {"request_id": "1", "location": "x", "checkin": "2026-01-25", "checkout": "2026-01-31", "adults": "2", "children": "0,7", "rating": None, "amenities": "ev-charger,nope", "stars": "", "min_price": None, "max_price": "99.9", "currency": "usd", "sort": "lowest"}
    got = readers.hotel_arguments(spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row))).first()
    assert (got["min_price"], got["max_price"], got["children_ages"], got["hotel_stars"], got["sort_order"], got["currency"], got["nights"]) == (None, 99, [1, 7], [], "lowest_price", "USD", 6)
    assert got["amenities"] == ["ev_charger"] and got["unknown_amenities"] == ["NOPE"]


def test_command_line_dry_run(spark, capsys):
    from tripquarry import cli

    assert cli.main(["flights", "-f", "sfo", "-t", "jfk", "-d", "2025-07-15", "--trip", "oneway", "--dry-run"], spark) == 0
    assert "tfs=GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC&" in capsys.readouterr().out
    assert cli.main(["hotels", "--location", "x", "--checkin", "2026-01-25", "--checkout", "2026-01-24", "--dry-run"], spark) == 1
