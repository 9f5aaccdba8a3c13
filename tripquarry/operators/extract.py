"""Extractors: captured result pages to typed rows.

The page is walked once, in an Arrow-batched function that returns only the raw text of each
card; numbers, times and stops are parsed afterwards by native column functions.  Rows keep
document order in ``pos``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schemas
from ..functions import text
from .dom import Element, matching, parse_html

# The selectors of result pages.
FLIGHT_LIST, FLIGHT_CARD = 'div[jsname="YdtKid"]', "ul.Rk10dc li"
FLIGHT_FIELDS = {
    "airline": "div.sSHqwe.tPgKwe.ogfYpf span",
    "times": "span.mv1WYe div",
    "duration": "li div.Ak5kof div",
    "plus_days": "span.bOzv6",
    "layovers": ".BbR8Ec .sSHqwe",
    "price": ".YMlIz.FpEdX",
}
HOTEL_CARD = "div.uaTTDe"
HOTEL_FIELDS = {
    "name": "h2.BgYkof",
    "price": "span.qQOQpe",
    "rating": "span.KFi5wf.lA0BZ",
    "rating_label": 'span[aria-label*="out of 5 stars"]',
    "reviews": "span.jdzyld",
    "amenities": "span.LtjZ2d",
    "location_rating": "span.uTUoTb",
    "star_class": "span.UqrZme",
    "link": "a[href]",
}


def _text(e: Element | None) -> str | None:
    return None if e is None else e.text()


def flight_cards(html: str) -> list[dict]:
    """Raw fields of every card that has an airline, two times, a duration and a price."""
    out, f = [], FLIGHT_FIELDS
    for block in parse_html(html).select(FLIGHT_LIST):
        for card in block.select(FLIGHT_CARD):
            below = list(card.descendants())
            first = lambda field: _text(next(matching(below, f[field]), None))  # noqa: B023, E731
            airline, times = first("airline"), [e.text() for e in matching(below, f["times"])]
            duration, price = first("duration"), first("price")
            if airline is None or len(times) < 2 or duration is None or price is None:
                continue
            labels = [e.attrs["aria-label"] for e in matching(below, f["layovers"]) if "aria-label" in e.attrs]
            out.append({"airline": airline, "departure": times[0], "arrival": times[1], "plus_days": first("plus_days"), "duration": duration, "price": price, "layover_labels": labels})
    return out


def hotel_cards(html: str) -> list[dict]:
    """Raw fields of every card with a name and a price element."""
    out, f = [], HOTEL_FIELDS
    for card in parse_html(html).select(HOTEL_CARD):
        name, price = _text(card.first(f["name"])), _text(card.first(f["price"]))
        if not name or price is None:
            continue
        rating = card.first(f["rating"])
        link = card.first(f["link"])
        out.append(
            {
                "name": name,
                "price": price,
                "rating": _text(rating if rating is not None else card.first(f["rating_label"])),
                "reviews": _text(card.first(f["reviews"])),
                "amenities": [e.text() for e in card.select(f["amenities"])],
                "location_rating": _text(card.first(f["location_rating"])),
                "star_class": _text(card.first(f["star_class"])),
                "href": None if link is None else link.attrs["href"],
            }
        )
    return out


def _array_udf(schema: T.StructType, cards):
    kind = T.ArrayType(schema)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else cards(h) for h in html.to_pylist()], arrow)

    return run.asNondeterministic()  # as for token decoding: arguments may hold nested lambdas


def flight_cards_udf():
    return _array_udf(schemas.FLIGHT_CARD, flight_cards)


def hotel_cards_udf():
    return _array_udf(schemas.HOTEL_CARD, hotel_cards)


def itinerary(card: Column, pos: Column, origin: Column, destination: Column) -> dict[str, Column]:
    """The itinerary's columns of one raw card: a single segment, with the stops beside it."""
    minutes, days = text.parse_duration(card["duration"]), text.parse_plus_days(card["plus_days"])
    none = F.lit(None).cast("string")
    segment = F.struct(
        card["airline"].alias("airline"),
        none.alias("flight_number"),
        origin.alias("departure_airport"),
        destination.alias("arrival_airport"),
        text.normalize_time(card["departure"]).alias("departure_time"),
        text.arrival_text(text.normalize_time(card["arrival"]), days).alias("arrival_time"),
        days.alias("arrival_plus_days"),
        minutes.alias("duration_minutes"),
        none.alias("aircraft"),
    )
    return {
        "id": text.itinerary_id(origin, destination, pos),
        "flights": F.array(segment),
        "price": text.parse_price(card["price"]),
        "currency": F.lit("USD"),
        "duration_minutes": minutes,
        "class": none,
        "layovers": text.layovers(card["layover_labels"]),
    }


def flight_card_arrays(pages: DataFrame, *, key: list[str] | None = None, html: str = "html") -> DataFrame:
    """The key columns and ``cards``, the raw cards of each page; pages go no further."""
    return pages.select(*(key or ["request_id"]), flight_cards_udf()(F.col(html)).alias("cards"))


def flights_of_cards(cards: DataFrame, *, key: list[str] | None = None, origin: str = "from_airport", destination: str = "to_airport") -> DataFrame:
    """One row for each itinerary: the key columns, ``pos``, and the itinerary."""
    key = key or ["request_id"]
    each = cards.select(*key, F.col(origin).alias("_from"), F.col(destination).alias("_to"), F.posexplode("cards").alias("pos", "_card"))
    fields = itinerary(F.col("_card"), F.col("pos"), F.col("_from"), F.col("_to"))
    return each.select(*key, "pos", *[c.alias(n) for n, c in fields.items()])


def extract_flights(pages: DataFrame, *, key: list[str] | None = None, html: str = "html", origin: str = "from_airport", destination: str = "to_airport") -> DataFrame:
    """One row for each itinerary of each page: the key columns, ``pos``, and the itinerary."""
    key = key or ["request_id"]
    slim = flight_card_arrays(pages, key=[*key, F.col(origin).alias("_origin"), F.col(destination).alias("_destination")], html=html)
    return flights_of_cards(slim, key=key, origin="_origin", destination="_destination")


def hotel_fields(card: Column) -> dict[str, Column]:
    return {
        "name": card["name"],
        "price": card["price"],
        "rating": text.parse_rating(card["rating"]),
        "reviews": text.parse_reviews(card["reviews"]),
        "amenities": F.filter(card["amenities"], lambda a: F.octet_length(a) > 2),
        "location_rating": card["location_rating"],
        "star_class": card["star_class"],
        "url": text.absolute_url(card["href"]),
        "address": F.lit(None).cast("string"),
    }


def hotel_card_arrays(pages: DataFrame, *, key: list[str] | None = None, html: str = "html") -> DataFrame:
    """The key columns, ``cards``, the raw cards of each page, and ``valid``: is there a card whose
    price isn't empty."""
    cards = pages.select(*(key or ["request_id"]), hotel_cards_udf()(F.col(html)).alias("cards"))
    return cards.withColumn("valid", F.coalesce(F.exists("cards", lambda c: c["price"] != ""), F.lit(False)))


def hotels_of_cards(cards: DataFrame, *, key: list[str] | None = None) -> DataFrame:
    """One row for each hotel: the key columns, ``pos``, and the hotel."""
    key = key or ["request_id"]
    each = cards.select(*key, F.posexplode("cards").alias("pos", "_card"))
    return each.select(*key, "pos", *[c.alias(n) for n, c in hotel_fields(F.col("_card")).items()])


def extract_hotels(pages: DataFrame, *, key: list[str] | None = None, html: str = "html") -> DataFrame:
    """One row for each hotel of each page: the key columns, ``pos``, and the hotel."""
    return hotels_of_cards(hotel_card_arrays(pages, key=key, html=html), key=key)


def links(html: Column) -> Column:
    """Targets of plain anchors, made absolute, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit('<a href="([^"]+)"'), F.lit(1)), lambda x: text.absolute_url(x)))


def headings(html: Column, level: int = 2, stop_words: list[str] | None = None, *, trim: bool = True) -> Column:
    """Texts of headings without inner markup: trimmed, not empty, no stop words, no repeats."""
    found = F.regexp_extract_all(html, F.lit(f"(?s)<h{level}[^>]*>([^<]*)</h{level}>"), F.lit(1))
    if trim:
        found = F.transform(found, lambda x: text.trim_all(x))
    stop = stop_words or []
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.isin(stop) if stop else x != ""))


def data_names(html: Column) -> Column:
    """Values of data-name attributes, without repeats."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit('data-name="([^"]*)"'), F.lit(1)), lambda x: x != ""))


def hotel_names(html: Column, stop_words: list[str] | None = None) -> Column:
    """Headings and data-names together, first come first, without repeats."""
    return F.array_distinct(F.concat(headings(html, 2, stop_words), data_names(html)))


def in_both(names: Column, others: Column) -> Column:
    """Names that are in both, without repeats, in the order of the first."""
    return F.array_intersect(names, others)
