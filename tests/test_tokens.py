"""Codecs: golden tokens, an independent encoder, and round trips."""

import base64

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripquarry import domains, schemas
from tripquarry.functions import tokens, wire
from tripquarry.operators import requests

# Known tokens of one-leg requests (from, to, date, class, trip, passengers, token).
GOLDEN = [
    ("SFO", "JFK", "2025-07-15", "economy", "one_way", [("adult", 1)], "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC"),
    ("SFO", "JFK", "2025-07-15", "economy", "one_way", [("adult", 1), ("child", 1)], "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0ICAQJIAZgBAg=="),
    ("SFO", "JFK", "2025-07-15", "economy", "one_way", [("adult", 1), ("infant_in_seat", 1)], "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0ICAQNIAZgBAg=="),
    ("SFO", "JFK", "2025-07-15", "economy", "round_trip", [("adult", 2), ("infant_on_lap", 1)], "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IDAQEESAGYAQE="),
    ("SFO", "LHR", "2025-09-15", "business", "round_trip", [("adult", 1)], "GhoSCjIwMjUtMDktMTVqBRIDU0ZPcgUSA0xIUkIBAUgDmAEB"),
    ("SFO", "JFK", "2025-07-15", "economy", "multi_city", [("adult", 1)], "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAED"),
    ("LAX", "ORD", "2025-08-15", "business", "one_way", [("adult", 2)], "GhoSCjIwMjUtMDgtMTVqBRIDTEFYcgUSA09SREICAQFIA5gBAg=="),
    ("SFO", "JFK", "2025-08-15", "economy", "one_way", [("adult", 2), ("child", 1), ("infant_in_seat", 1)], "GhoSCjIwMjUtMDgtMTVqBRIDU0ZPcgUSA0pGS0IEAQECA0gBmAEC"),
]
HOTEL_TOKEN = "CAEaIAoCGgASGhIUCgcI6g8QARgZEgcI6g8QARgfGAYyAggBKgkKBToDRVVSGgA"


def flights(spark, rows):
    full = [(str(i), f, t, d, r, c, [{"type": k, "count": n} for k, n in p], trip, stops, air) for i, (f, t, d, r, c, trip, p, stops, air) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FLIGHT_REQUEST)


def test_golden_flight_tokens(spark):
    frame = flights(spark, [(f, t, d, None, c, trip, p, None, None) for f, t, d, c, trip, p, _ in GOLDEN])
    got = [r["tfs"] for r in requests.with_flight_token(frame).orderBy(F.col("request_id").cast("int")).collect()]
    assert got == [g[-1] for g in GOLDEN]


def vi(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def ld(field, body):
    return vi(field << 3 | 2) + vi(len(body)) + body


def leg(day, stops, airlines, a, b):
    return ld(2, day.encode()) + (b"" if stops is None else b"\x28" + vi(stops)) + b"".join(ld(6, x.encode()) for x in airlines or []) + ld(13, ld(2, a.encode())) + ld(14, ld(2, b.encode()))


def test_two_legs_airlines_and_long_fields(spark):
    long = "A" * 200  # lengths of two bytes
    rows = [
        ("SFO", "JFK", "2025-7-5", "2025-07-25", "first", "round_trip", [("adult", 130)], 0, ["UA", long]),
        ("SFO", "JFK", "2025-07-05", "2025-07-25", "premium_economy", "one_way", [("adult", 1)], -1, None),
    ]
    got = [r["tfs"] for r in requests.with_flight_token(flights(spark, rows)).orderBy("request_id").collect()]
    tail = lambda people, seat, trip: ld(8, people) + b"\x48" + vi(seat) + b"\x98\x01" + vi(trip)
    want = [
        ld(3, leg("2025-07-05", 0, ["UA", long], "SFO", "JFK")) + ld(3, leg("2025-07-25", 0, ["UA", long], "JFK", "SFO")) + tail(b"\x01" * 130, 4, 1),
        ld(3, leg("2025-07-05", -1, None, "SFO", "JFK")) + tail(b"\x01", 2, 2),
    ]
    assert got == [base64.b64encode(w).decode() for w in want]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 16383, 16384, 2**31 - 1, 2**32 - 1, 2**40, 2**62, -1, -(2**31)])
def test_varint(spark, n):
    assert bytes(spark.range(1).select(wire.varint(F.lit(n)).alias("x")).first()["x"]) == vi(n)


def test_hotel_literal_decodes(spark):
    d = tokens.decode_hotel(HOTEL_TOKEN)
    assert (d["version"], d["adults"], d["children_ages"], d["checkin_date"], d["checkout_date"], d["nights"], d["currency"]) == (1, 2, [], "2026-01-25", "2026-01-31", 6, "EUR")


@pytest.mark.parametrize("token", ["!", "abc", "GhoSCjIw", "CAE=", "AAAA"])
def test_bad_tokens_are_errors_not_failures(spark, token):
    got = spark.createDataFrame([(token,)], "t string").select(tokens.tfs_decode(F.col("t")).alias("d")).first()["d"]
    assert got["params"] is None and got["error"]


def test_null_token(spark):
    got = spark.createDataFrame([(None,)], "t string").select(tokens.tfs_decode(F.col("t")).alias("d")).first()["d"]
    assert got["params"] is None and got["error"] is None


airport = st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=3, max_size=3)
flight = st.tuples(
    airport, airport, st.dates(min_value=__import__("datetime").date(2020, 1, 1), max_value=__import__("datetime").date(2030, 1, 1)), st.none() | st.integers(0, 40),
    st.sampled_from(["economy", "premium_economy", "business", "first"]), st.sampled_from(["round_trip", "one_way", "multi_city"]),
    st.tuples(st.integers(1, 5), st.integers(0, 3), st.integers(0, 1), st.integers(0, 2)), st.none() | st.integers(0, 3), st.none() | st.lists(st.sampled_from(["UA", "LH"]), min_size=1, max_size=2),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(flight, min_size=20, max_size=40))
def test_flight_round_trip(spark, rows):
    import datetime

    made = []
    for f, t, d, gap, c, trip, (a, ch, lap, seat), stops, air in rows:
        back = None if gap is None else (d + datetime.timedelta(gap)).isoformat()
        people = [(k, n) for k, n in (("adult", a), ("child", ch), ("infant_on_lap", lap), ("infant_in_seat", seat)) if n]
        made.append((f, t, d.isoformat(), back, c, trip, people, stops, air))
    coded = requests.with_flight_token(flights(spark, made)).select("request_id", tokens.tfs_decode(F.col("tfs")).alias("d")).orderBy(F.col("request_id").cast("int")).collect()
    for (f, t, d, back, c, trip, people, stops, air), got in zip(made, coded):
        p = got["d"]["params"]
        assert got["d"]["error"] is None
        assert (p["from_airport"], p["to_airport"], p["depart_date"], p["cabin_class"], p["trip_type"], p["max_stops"], p["preferred_airlines"]) == (f, t, d, c, trip, stops, air)
        assert p["return_date"] == (back if trip == "round_trip" else None)
        assert [(x["type"], x["count"]) for x in p["passengers"]] == people


def test_hotel_encoding_against_plain_bytes(spark):
    row = ("1", 1, 3, [5, 17], "x", "", "", "", "2026-01-25", "2026-01-31", 0, 0, "EUR", "highest_rating", 4.2, [4, 5], ["spa", "ev_charger"], 300, None)
    got = requests.with_hotel_token(spark.createDataFrame([row], schemas.HOTEL_REQUEST)).first()
    num = lambda f, n: vi(f << 3) + vi(n)
    day = lambda y, m, d: num(1, y) + num(2, m) + num(3, d)
    guests = ld(1, num(1, 3)) * 3 + ld(1, num(1, 2) + num(2, 5)) + ld(1, num(1, 2) + num(2, 17)) + num(2, 1)
    stay = ld(1, day(2026, 1, 25)) + ld(2, day(2026, 1, 31)) + num(3, 6)
    search = ld(1, ld(3, b"")) + ld(2, ld(2, stay) + ld(6, num(1, 1)))
    config = ld(1, ld(1, bytes([10, 61])) + ld(2, bytes([4, 5])) + ld(3, b"") + num(5, 8) + ld(7, b"EUR")) + ld(3, b"") + ld(4, ld(1, num(2, 300))) + num(5, 8)
    want = num(1, 1) + ld(2, guests) + ld(3, search) + ld(5, config)
    assert got["ts"] == base64.urlsafe_b64encode(want).decode().rstrip("=")
    back = tokens.decode_hotel(got["ts"])
    assert (back["adults"], back["children_ages"], back["nights"], back["used_guests_dropdown"], back["sort_order"], back["min_guest_rating"]) == (3, [5, 17], 6, 1, "highest_rating", 4.0)
    assert (back["hotel_stars"], back["amenities"], back["min_price"], back["max_price"]) == ([4, 5], ["spa", "ev_charger"], 300, None)


def test_domains_cover_their_codes():
    for d in domains.DOMAINS.values():
        assert len(set(d.codes.values())) == len(d.codes) and set(d.names.values()) <= set(d.codes)
