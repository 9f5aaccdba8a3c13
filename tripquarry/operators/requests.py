"""Requests: constructors, builders and ordered validation.

Validation is one column, ``validation_error``: the message of the first rule that fails, in the
order the rules are listed, or null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domains, schemas
from ..functions import text, tokens


def _first(*rules: tuple[Column, str | Column]) -> Column:
    """The message of the first rule that doesn't hold; a null condition doesn't hold."""
    out = None
    for holds, message in rules:
        bad, message = ~F.coalesce(holds, F.lit(False)), message if isinstance(message, Column) else F.lit(message)
        out = F.when(bad, message) if out is None else out.when(bad, message)
    return out


def passenger_sum(passengers: Column, kind: str) -> Column:
    """Travellers of one kind; an entry may come more than once."""
    own = F.filter(F.coalesce(passengers, F.array().cast(schemas.PASSENGERS)), lambda p: domains.PASSENGER.canonical(p["type"]) == kind)
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, p: a + p["count"])


def flight_error(r: dict[str, Column] | None = None) -> Column:
    r = r or tokens.columns(schemas.FLIGHT_REQUEST)
    adults, lap = passenger_sum(r["passengers"], "adult"), passenger_sum(r["passengers"], "infant_on_lap")
    depart, back = text.parse_iso_date(r["depart_date"]), text.parse_iso_date(r["return_date"])
    return _first(
        (r["from_airport"] != "", "Origin airport is required"),
        (r["to_airport"] != "", "Destination airport is required"),
        (adults > 0, "At least one adult is required"),
        (lap <= adults, F.format_string("Cannot have more infants on lap (%d) than adults (%d)", lap, adults)),
        (depart.isNotNull(), "Invalid depart date format"),
        (r["return_date"].isNull() | back.isNotNull(), "Invalid return date format"),
        (~F.coalesce(domains.TRIP.canonical(r["trip_type"]) == "round_trip", F.lit(False)) | r["return_date"].isNull() | (back >= depart), "Return date must be on or after departure date"),
    )


def hotel_error(r: dict[str, Column] | None = None) -> Column:
    r = r or tokens.columns(schemas.HOTEL_REQUEST)
    none = F.array().cast("array<int>")
    children, stars = F.coalesce(r["children_ages"], none), F.coalesce(r["hotel_stars"], none)
    come, go = text.parse_iso_date(r["checkin_date"]), text.parse_iso_date(r["checkout_date"])
    low, high = r["min_price"], r["max_price"]
    return _first(
        (r["adults"] >= 1, "At least one adult is required"),
        (guests(r) <= 6, "Maximum 6 guests allowed"),
        (F.forall(children, lambda a: a.between(1, 17)), "Children ages must be between 1 and 17 (ages 0-1 are encoded as 1)"),
        (come.isNotNull(), "Invalid checkin date"),
        (go.isNotNull(), "Invalid checkout date"),
        (go > come, "Checkout must be after check-in"),
        (text.nights(come, go) <= 30, "Stay must be 30 nights or fewer"),
        (high.isNull() | (high > 0), "Price must be positive"),
        (low.isNull() | (low > 0), "Price must be positive"),
        (low.isNull() | high.isNull() | (low <= high), "Minimum price cannot be greater than maximum price"),
        (F.forall(stars, lambda s: s.between(2, 5)), "Star rating must be between 2 and 5"),
    )


def guests(r: dict[str, Column]) -> Column:
    return r["adults"] + F.size(F.coalesce(r["children_ages"], F.array().cast("array<int>")))


def flight_date_error(today: Column, r: dict[str, Column] | None = None) -> Column:
    """Dates of a search that is about to run."""
    r = r or tokens.columns(schemas.FLIGHT_REQUEST)
    back = text.parse_iso_date(r["return_date"])
    return _first((text.parse_iso_date(r["depart_date"]) >= today, "Departure date cannot be in the past"), (r["return_date"].isNull() | (back >= today), "Return date cannot be in the past"))


def hotel_date_error(today: Column, r: dict[str, Column] | None = None) -> Column:
    r = r or tokens.columns(schemas.HOTEL_REQUEST)
    return _first((text.parse_iso_date(r["checkin_date"]) >= today, "Check-in cannot be in the past"))


def one_way_warning(r: dict[str, Column] | None = None) -> Column:
    r = r or tokens.columns(schemas.FLIGHT_REQUEST)
    return F.when((domains.TRIP.canonical(r["trip_type"]) == "round_trip") & r["return_date"].isNull(), "Round trip without a return date: searching one way")


def with_flight_token(requests: DataFrame) -> DataFrame:
    """Add ``validation_error, tfs, search_url``; an invalid request has neither token nor URL."""
    checked = requests.withColumn("validation_error", flight_error())
    coded = checked.withColumn("tfs", tokens.tfs_encode(wanted=F.col("validation_error").isNull()))
    return coded.withColumn("search_url", tokens.flight_url(F.col("tfs")))


def with_hotel_token(requests: DataFrame) -> DataFrame:
    checked = requests.withColumn("validation_error", hotel_error())
    coded = checked.withColumn("ts", tokens.ts_encode(wanted=F.col("validation_error").isNull()))
    return coded.withColumn("search_url", tokens.hotel_url(F.col("loc_q_search"), F.col("ts")))


# --- tool inputs --------------------------------------------------------------------------------


def flight_requests_from_tool(inputs: DataFrame, input_col: str = "input", id_col: str = "request_id") -> DataFrame:
    """Parsed tool inputs to requests: children count, their ages don't; no airlines."""
    x = F.col(input_col)
    ages = F.coalesce(x["children_ages"], F.array().cast("array<int>"))
    adult = F.struct(F.lit("adult").alias("type"), x["adults"].alias("count"))
    child = F.struct(F.lit("child").alias("type"), F.size(ages).cast("bigint").alias("count"))
    return inputs.select(
        F.col(id_col).alias("request_id"),
        x["from"].alias("from_airport"),
        x["to"].alias("to_airport"),
        x["date"].alias("depart_date"),
        x["return_date"].alias("return_date"),
        F.when(x["seat"].isNull(), domains.SEAT.default).otherwise(domains.SEAT.canonical(x["seat"], domains.SEAT_JSON)).alias("cabin_class"),
        F.when(F.size(ages) > 0, F.array(adult, child)).otherwise(F.array(adult)).alias("passengers"),
        F.when(x["trip_type"].isNull(), domains.TRIP.default).otherwise(domains.TRIP.canonical(x["trip_type"], domains.TRIP_JSON)).alias("trip_type"),
        x["max_stops"].alias("max_stops"),
        F.lit(None).cast("array<string>").alias("preferred_airlines"),
    )


def split_amenities(names: Column) -> Column:
    """struct<valid, invalid>: canonical names of the known ones, the others as they came."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    known = lambda a: domains.AMENITY.canonical(a).isNotNull()
    return F.struct(F.transform(F.filter(names, known), lambda a: domains.AMENITY.canonical(a)).alias("valid"), F.filter(names, lambda a: ~known(a)).alias("invalid"))


def amenity_warning(invalid: Column) -> Column:
    """One text that names the unknown ones, or null."""
    return F.when(F.size(invalid) > 0, F.concat(F.lit("Unknown amenity(s): "), F.array_join(invalid, ", "), F.lit(f". Valid amenities: {', '.join(domains.AMENITY_NAMES)}.")))


def hotel_requests_from_tool(inputs: DataFrame, input_col: str = "input", id_col: str = "request_id") -> DataFrame:
    """Parsed tool inputs to requests, with the amenity ``warnings`` beside them."""
    x = F.col(input_col)
    split = inputs.withColumn("_split", split_amenities(x["amenities"]))
    none = F.lit(None)
    return split.select(
        F.col(id_col).alias("request_id"),
        F.lit(1).alias("version"),
        x["adults"].alias("adults"),
        F.coalesce(x["children_ages"], F.array().cast("array<int>")).alias("children_ages"),
        x["location"].alias("loc_q_search"),
        *[F.lit("").alias(n) for n in ("loc_ts_name", "loc_ts_id", "loc_ts_coords")],
        x["checkin_date"].alias("checkin_date"),
        x["checkout_date"].alias("checkout_date"),
        F.lit(0).alias("nights"),
        F.lit(0).alias("used_guests_dropdown"),
        F.lit("USD").alias("currency"),
        none.cast("string").alias("sort_order"),
        x["min_guest_rating"].alias("min_guest_rating"),
        F.coalesce(x["stars"], F.array().cast("array<int>")).alias("hotel_stars"),
        F.col("_split.valid").alias("amenities"),
        x["min_price"].alias("min_price"),
        x["max_price"].alias("max_price"),
        F.array_compact(F.array(amenity_warning(F.col("_split.invalid")))).alias("warnings"),
    )


# --- builders -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class FlightBuilder:
    """Column-level builder: dates are date columns, and ``build`` formats, drops a stop limit of
    0 and validates."""

    origin: Column
    destination: Column
    depart: Column
    back: Column | None = None
    seat: Column | None = None
    travellers: Column | None = None
    trip: Column | None = None
    stops: Column | None = None
    airlines: Column | None = None

    def return_date(self, day: Column) -> FlightBuilder:
        return replace(self, back=day)

    def cabin_class(self, seat: Column) -> FlightBuilder:
        return replace(self, seat=seat)

    def passengers(self, passengers: Column) -> FlightBuilder:
        return replace(self, travellers=passengers)

    def trip_type(self, trip: Column) -> FlightBuilder:
        return replace(self, trip=trip)

    def max_stops(self, stops: Column) -> FlightBuilder:
        return replace(self, stops=stops)

    def preferred_airlines(self, airlines: Column) -> FlightBuilder:
        return replace(self, airlines=airlines)

    def build(self, frame: DataFrame, request_id: Column) -> DataFrame:
        default = lambda c, x: F.lit(x) if c is None else c
        one_adult = F.array(F.struct(F.lit("adult").alias("type"), F.lit(1).cast("bigint").alias("count")))
        built = frame.select(
            request_id.cast("string").alias("request_id"),
            self.origin.alias("from_airport"),
            self.destination.alias("to_airport"),
            text.iso_date(self.depart).alias("depart_date"),
            (F.lit(None).cast("string") if self.back is None else text.iso_date(self.back)).alias("return_date"),
            default(self.seat, domains.SEAT.default).alias("cabin_class"),
            (one_adult if self.travellers is None else self.travellers).alias("passengers"),
            default(self.trip, domains.TRIP.default).alias("trip_type"),
            (F.lit(None) if self.stops is None else F.nullif(self.stops, F.lit(0))).cast("int").alias("max_stops"),
            (F.lit(None) if self.airlines is None else self.airlines).cast("array<string>").alias("preferred_airlines"),
        )
        return built.withColumn("validation_error", flight_error())


@dataclass(frozen=True)
class HotelBuilder:
    """As ``FlightBuilder``; nights are counted from the dates."""

    location: Column
    checkin: Column
    checkout: Column
    grown: Column | None = None
    ages: Column | None = None
    money: Column | None = None
    order: Column | None = None
    rating: Column | None = None
    star: Column | None = None
    wishes: Column | None = None
    low: Column | None = None
    high: Column | None = None

    def adults(self, n: Column) -> HotelBuilder:
        return replace(self, grown=n)

    def children_ages(self, ages: Column) -> HotelBuilder:
        return replace(self, ages=ages)

    def currency(self, code: Column) -> HotelBuilder:
        return replace(self, money=code)

    def sort_order(self, order: Column) -> HotelBuilder:
        return replace(self, order=order)

    def min_guest_rating(self, rating: Column) -> HotelBuilder:
        return replace(self, rating=rating)

    def hotel_stars(self, stars: Column) -> HotelBuilder:
        return replace(self, star=stars)

    def amenities(self, names: Column) -> HotelBuilder:
        return replace(self, wishes=names)

    def price_range(self, low: Column | None, high: Column | None) -> HotelBuilder:
        return replace(self, low=low, high=high)

    def build(self, frame: DataFrame, request_id: Column) -> DataFrame:
        given = lambda c, kind, x=None: (F.lit(x) if c is None else c).cast(kind)
        listed = lambda c, kind: F.array().cast(kind) if c is None else c
        values = {
            "version": F.lit(1), "adults": given(self.grown, "bigint", 2), "children_ages": listed(self.ages, "array<int>"), "loc_q_search": self.location,
            "loc_ts_name": F.lit(""), "loc_ts_id": F.lit(""), "loc_ts_coords": F.lit(""), "checkin_date": text.iso_date(self.checkin), "checkout_date": text.iso_date(self.checkout),
            "nights": text.nights(self.checkin, self.checkout), "used_guests_dropdown": F.lit(0), "currency": given(self.money, "string", "USD"), "sort_order": given(self.order, "string"),
            "min_guest_rating": given(self.rating, "double"), "hotel_stars": listed(self.star, "array<int>"), "amenities": listed(self.wishes, "array<string>"),
            "min_price": given(self.low, "int"), "max_price": given(self.high, "int"),
        }
        built = frame.select(request_id.cast("string").alias("request_id"), *[c.alias(n) for n, c in values.items()])
        return built.withColumn("validation_error", hotel_error())
