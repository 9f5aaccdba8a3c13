"""Results to the published response shape, one row for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domains, schemas
from ..functions import text

_NONE = "array<string>"


def _optional(array: Column) -> Column:
    """An empty array becomes null, which JSON leaves out."""
    return F.when(F.size(array) > 0, array)


def flight_result() -> Column:
    stops = F.transform(F.filter("layovers", lambda s: s["airport_city"].isNotNull()), lambda s: F.struct(s["airport_city"].alias("city"), F.coalesce(s["duration_minutes"], F.lit(0)).alias("dur_min")))
    return F.struct(
        F.coalesce("price", F.lit(0)).alias("price"),
        F.filter(F.transform("flights", lambda f: f["airline"]), lambda a: a.isNotNull()).alias("airlines"),
        F.coalesce("duration_minutes", F.lit(0)).alias("dur_min"),
        F.when(F.size("layovers") > 0, stops).alias("layover"),
    )


def hotel_result() -> Column:
    return F.struct(
        F.col("name"),
        text.hotel_price(F.col("price")).alias("price"),
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        text.parse_stars(F.col("star_class")).alias("stars"),
        _optional(F.col("amenities")).alias("amenities"),
    )


def in_order(value: Column, pos: Column | str = "pos") -> Column:
    """Aggregate: the values of a group as an array in the order of ``pos``."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])


def flight_responses(itineraries: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, response) for every request that has itineraries.

    ``requests`` has ``request_id, from_airport, to_airport, depart_date, cabin_class, search_url``.
    A request's results are one row, so a group is as large as one page's cards.
    """
    per = itineraries.groupBy("request_id").agg(F.count("*").alias("_total"), F.min_by("currency", "pos").alias("_curr"), _results(flight_result()).alias("_results"))
    own = requests.select("request_id", "from_airport", "to_airport", "depart_date", "cabin_class", "search_url")
    query = F.struct(
        F.col("from_airport").alias("from"),
        F.col("to_airport").alias("to"),
        F.col("depart_date").alias("date"),
        F.coalesce("_curr", F.lit("USD")).alias("curr"),
        domains.SEAT.canonical(F.col("cabin_class")).alias("seat"),
        F.col("search_url").alias("search_url"),
    )
    body = F.struct(F.col("_total").alias("total"), query.alias("query"), F.col("_results").alias("results"), F.lit(None).cast(_NONE).alias("warnings"))
    return own.join(per, "request_id").select("request_id", F.struct(body.alias("search_flights")).cast(schemas.FLIGHT_RESPONSE).alias("response"))


def _results(result: Column) -> Column:
    """Results in page order.  The array is sorted by position, which is unique in a request."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), result.alias("v")))), lambda x: x["v"])


def hotel_responses(hotels: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, response) for every request that has hotels; the request's ``warnings`` go in."""
    per = hotels.groupBy("request_id").agg(F.count("*").alias("_total"), _results(hotel_result()).alias("_results"))
    warnings = F.col("warnings") if "warnings" in requests.columns else F.lit(None).cast(_NONE)
    own = requests.select("request_id", "loc_q_search", "checkin_date", "checkout_date", "currency", "search_url", warnings.alias("_warnings"))
    query = F.struct(F.col("loc_q_search").alias("loc"), F.col("checkin_date").alias("in"), F.col("checkout_date").alias("out"), F.col("currency").alias("curr"), F.col("search_url").alias("search_url"))
    body = F.struct(F.col("_total").alias("total"), query.alias("query"), F.col("_results").alias("results"), _optional(F.col("_warnings")).alias("warnings"))
    return own.join(per, "request_id").select("request_id", F.struct(body.alias("search_hotels")).cast(schemas.HOTEL_RESPONSE).alias("response"))


def to_json(response: Column) -> Column:
    """JSON text; absent optional fields are left out, empty results stay."""
    return F.to_json(response)


def flight_conformance(response: Column) -> Column:
    """The first breach of the published schema, or null: required fields and minimum 0."""
    r = response["search_flights"]
    q = r["query"]
    bad_number = lambda x: F.coalesce(x < 0, F.lit(True))
    return (
        F.when(bad_number(r["total"]), "total")
        .when(F.exists(F.array(*[q[n] for n in ("from", "to", "date", "curr", "seat", "search_url")]), lambda x: x.isNull()), "query")
        .when(r["results"].isNull() | F.exists(r["results"], lambda x: bad_number(x["price"]) | bad_number(x["dur_min"]) | x["airlines"].isNull()), "results")
        .when(F.exists(F.flatten(F.transform(F.filter(r["results"], lambda x: x["layover"].isNotNull()), lambda x: x["layover"])), lambda s: s["city"].isNull() | bad_number(s["dur_min"])), "layover")
    )


def hotel_conformance(response: Column) -> Column:
    r = response["search_hotels"]
    q = r["query"]
    bad_number = lambda x: F.coalesce(x < 0, F.lit(True))
    return (
        F.when(bad_number(r["total"]), "total")
        .when(F.exists(F.array(*[q[n] for n in ("loc", "in", "out", "curr", "search_url")]), lambda x: x.isNull()), "query")
        .when(r["results"].isNull() | F.exists(r["results"], lambda x: bad_number(x["price"]) | bad_number(x["rating"]) | x["name"].isNull()), "results")
    )


# --- aggregates over results --------------------------------------------------------------------


def best_price(price: str = "price", pos: str = "pos") -> Column:
    """The first row's price (0 if it has none), which pages list first; not the least."""
    return F.coalesce(F.min_by(price, pos), F.lit(0))


def summary(itineraries: DataFrame) -> DataFrame:
    """Per request: rows, first and least price, rows with several stops, rows over 900 minutes,
    any price at all."""
    return itineraries.groupBy("request_id").agg(
        F.count("*").alias("total"),
        best_price().alias("best_price"),
        F.min("price").alias("min_price"),
        F.count_if(F.size("layovers") >= 2).alias("multi_stop"),
        F.count_if(F.col("duration_minutes") > 900).alias("long_haul"),
        F.bool_or(F.col("price").isNotNull()).alias("any_price"),
        F.bool_and(F.get("flights", F.lit(0))["airline"] != "").alias("all_airlines"),
    )


def valid_hotel_pages(hotels: DataFrame) -> DataFrame:
    """Requests with a hotel whose price isn't empty."""
    return hotels.groupBy("request_id").agg(F.bool_or(F.col("price") != "").alias("valid"))
