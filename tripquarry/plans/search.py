"""End-to-end searches over captured pages, as one lazy plan.

requests -> validation -> token and URL; pages -> page checks -> cards; a join of the two -> rows ->
response.  Every page is parsed once, where it is read, and only its cards are shuffled.  A bad row
doesn't fail the job: every request comes back with a response or an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract, pages, requests, responses


def _outcome(coded: DataFrame, captured: DataFrame, answers: DataFrame, prefix: str, date_error: Column, failure: Column, empty: str) -> DataFrame:
    page = captured.select("request_id", F.lit(True).alias("_captured"), F.coalesce(pages.http_error(F.col("status"), F.col("html")), pages.consent_error(F.col("html"))).alias("_page_error"), failure.alias("_failure"))
    joined = coded.join(page, "request_id", "left").join(answers, "request_id", "left")
    problem = (
        F.when(F.col("validation_error").isNotNull(), F.col("validation_error"))
        .when(date_error.isNotNull(), date_error)
        .when(F.col("_captured").isNull(), "no page was captured")
        .when(F.col("_page_error").isNotNull(), F.col("_page_error"))
        .when(F.col("response").isNull(), F.concat(F.lit(f"{empty}: "), "_failure"))
    )
    error = F.when(problem.isNotNull(), F.concat(F.lit(prefix), problem))
    return joined.select("request_id", "search_url", F.when(error.isNull(), F.col("response")).alias("response"), error.alias("error"))


def _usable(captured: DataFrame) -> DataFrame:
    return captured.where(pages.http_error(F.col("status"), F.col("html")).isNull() & ~pages.has_any(F.col("html"), pages.CONSENT))


def search_flights(wanted: DataFrame, captured: DataFrame, *, today: Column | None = None) -> DataFrame:
    """(request_id, search_url, response, error) for every flight request.

    ``today`` is a parameter so that results can be repeated; without it dates aren't compared
    with the present.
    """
    coded = requests.with_flight_token(wanted)
    late = F.lit(None).cast("string") if today is None else requests.flight_date_error(today)
    run = coded.where(F.col("validation_error").isNull() & late.isNull()).select("request_id", "from_airport", "to_airport", "depart_date", "cabin_class", "search_url")
    cards = extract.flight_card_arrays(_usable(captured)).where(F.size("cards") > 0)
    found = extract.flights_of_cards(cards.join(run.select("request_id", "from_airport", "to_airport"), "request_id"))
    answers = responses.flight_responses(found, run)
    return _outcome(coded, captured, answers, "Flight search failed: ", late, pages.flight_failure(F.col("html")), "No flights parsed from response")


def search_hotels(wanted: DataFrame, captured: DataFrame, *, today: Column | None = None) -> DataFrame:
    """(request_id, search_url, response, error) for every hotel request."""
    coded = requests.with_hotel_token(wanted)
    late = F.lit(None).cast("string") if today is None else requests.hotel_date_error(today)
    extra = ["warnings"] if "warnings" in coded.columns else []
    run = coded.where(F.col("validation_error").isNull() & late.isNull()).select("request_id", "loc_q_search", "checkin_date", "checkout_date", "currency", "search_url", *extra)
    cards = extract.hotel_card_arrays(_usable(captured)).where("valid")
    found = extract.hotels_of_cards(cards.join(run.select("request_id"), "request_id", "left_semi"))
    answers = responses.hotel_responses(found, run)
    return _outcome(coded, captured, answers, "Hotel search failed: ", late, pages.hotel_failure(F.col("html")), "No valid hotel results found")
