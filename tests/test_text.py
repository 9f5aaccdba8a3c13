"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tripquarry import domains
from tripquarry.functions import text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "minutes"), [("6h 30m", 390), ("1h", 60), ("45m", 45), ("", 0), ("11 hr 5 min", 665), ("99999999999h", 0), (None, None)])
def test_duration(spark, given, minutes):
    assert value(spark, text.parse_duration(F.lit(given).cast("string"))) == minutes


@pytest.mark.parametrize(("given", "want"), [("10:30 AM", "10:30"), ("22:45", "22:45"), ("10:30 AM", "10:30"), ("", "")])
def test_time(spark, given, want):
    assert value(spark, text.normalize_time(F.lit(given))) == want


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("Layover (1 of 2) is a 11 hr 29 min layover at A in Los Angeles. Layover (2 of 2) is a 3 hr layover at B in Nadi.", [("Los Angeles", 689), ("Nadi", 180)]),
        ("1 hr 30 min layover in Montréal.", [("Montréal", 90)]),
        ("4 hr layover in Paris. 2 hr layover in Tel-Aviv.", [("Paris", 240), ("Tel-Aviv", 120)]),
        ("2h layover at John F. Kennedy in New York.", [("New York", 120)]),
        ("45 min layover in Oslo.", []),  # no hours, no stop: kept as it is
    ],
)
def test_layovers(spark, label, want):
    got = value(spark, text.layovers(F.array(F.lit(label))))
    assert [(g["airport_city"], g["duration_minutes"]) for g in got] == want


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.parse_price(F.lit("€12.50")), 1250),
        (lambda: text.parse_price(F.lit("free")), None),
        (lambda: text.parse_price(F.lit("99999999999")), None),
        (lambda: text.parse_reviews(F.lit("(4,294,967,295)")), 4294967295),
        (lambda: text.parse_reviews(F.lit("4294967296")), None),
        (lambda: text.parse_rating(F.lit(" 4.5 ")), 4.5),
        (lambda: text.parse_rating(F.lit("1d")), None),
        (lambda: text.parse_stars(F.lit(" 4 ")), 4),
        (lambda: text.parse_stars(F.lit("0")), None),
        (lambda: text.parse_stars(F.lit("4-star")), None),
        (lambda: text.parse_plus_days(F.lit("++2 days")), 2),
        (lambda: text.parse_plus_days(F.lit("next")), 0),
        (lambda: text.arrival_text(F.lit("6:15"), F.lit(1)), "6:15 +1d"),
        (lambda: text.itinerary_id(F.lit("SFO"), F.lit("JFK"), F.lit(3)), "241515785603"),
        (lambda: text.itinerary_id(F.lit("S-O"), F.lit("ZZZZZZZZ"), F.lit(123)), "000000123"),
        (lambda: text.base36(F.lit("1Z141Z3")), 4294967295),
        (lambda: text.base36(F.lit("1Z141Z4")), 0),
        (lambda: text.percent_encode(F.lit("a b*~é/")), "a%20b%2A~%C3%A9%2F"),
        (lambda: text.format_duration(F.lit(0)), "0h"),
        (lambda: text.format_duration(F.lit(125)), "2h 05m"),
        (lambda: text.format_duration(F.lit(45)), "45m"),
        (lambda: text.format_times(F.lit(None).cast("string"), F.lit("9:00")), "??:?? → 9:00"),
        (lambda: text.whole_price(F.lit(1e12)), 2147483647),
        (lambda: text.whole_price(F.lit(-2.9)), -2),
        (lambda: text.whole_price(F.lit(None).cast("double")), None),
        (lambda: text.format_duration(F.lit(None).cast("int")), None),
        (lambda: text.rating_code(F.lit(3.0)), 7),
        (lambda: text.children_list(F.lit("0, 7")), [1, 7]),
        (lambda: text.children_list(F.lit("1,x")), None),
        (lambda: text.children_list(F.lit("")), []),
        (lambda: text.star_list(F.lit("1,5")), [1, 5]),
        (lambda: text.star_list(F.lit("6")), None),
        (lambda: text.amenity_list(F.lit("ev-charger, pool")), ["EV_CHARGER", "POOL"]),
        (lambda: text.iso_date(text.parse_iso_date(F.lit("2025-7-5"))), "2025-07-05"),
        (lambda: text.parse_iso_date(F.lit("2025-02-30")), None),
        (lambda: text.iso_date(text.parse_cli_date(F.lit("2025/07/05"))), "2025-07-05"),
        (lambda: domains.SEAT.canonical(F.lit("premium")), "premium_economy"),
        (lambda: domains.SEAT.canonical(F.lit("Economy")), None),
        (lambda: domains.SEAT_CLI.canonical(F.lit("PE")), "premium_economy"),
        (lambda: domains.AMENITY.canonical(F.lit("AC")), "air_conditioned"),
        (lambda: domains.AMENITY.name(F.lit(61)), "ev_charger"),
        (lambda: domains.sort_order(F.lit("relevance")), None),
        (lambda: domains.TRIP.from_wire_name(F.lit("ONE_WAY")), "one_way"),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == want


def test_stops_label(spark):
    stop = lambda city, m: F.struct(F.lit(city).cast("string").alias("airport_city"), F.lit(m).cast("int").alias("duration_minutes"))
    assert value(spark, text.format_stops(F.array(stop("Oslo", 120)))) == "1 stop: 2h@Oslo"
    assert value(spark, text.format_stops(F.array(stop("Oslo", None), stop(None, 45)))) == "2 stops: ??@Oslo, 45m@Unknown"
    assert value(spark, text.format_stops(F.slice(F.array(stop("x", 1)), 1, 0))) == "direct"
