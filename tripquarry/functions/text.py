"""Scalar text functions as column expressions; everything stays in the JVM.

Patterns that must see Unicode spaces and digits carry ``(?U)``.  Text becomes a number by
``try_cast``, so what doesn't parse is null and never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label pattern, hours, optional minutes, and the city after "in".
LAYOVER = r"(?U)(\d+)\s*h(?:r\s*(?:(\d+)\s*m(?:in)?)?)?.*?in\s+([A-Za-zÀ-ÿ'\s-][A-Za-zÀ-ÿ'\s-]*)"
SITE = "https://www.google.com"
_TRIM = r"(?U)^\s+|\s+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _group_int(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(0))


def trim_all(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, _TRIM, "")


def parse_duration(text: Column) -> Column:
    """Minutes of '6h 30m', '11 hr 5 min', '45m'; what is missing or too large counts 0."""
    return F.when(text.isNotNull(), _group_int(text, r"(?U)(\d+)\s*h") * 60 + _group_int(text, r"(?U)(\d+)\s*m"))


def normalize_time(text: Column) -> Column:
    """The first word ('10:30 AM' gives '10:30'); the text itself if there is none."""
    first = F.regexp_extract(text, r"(?U)(\S+)", 1)
    return F.when(first != "", first).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def parse_price(text: Column) -> Column:
    """The digits as an int; null if there are none or too many."""
    return digits(text).try_cast("int")


def hotel_price(text: Column) -> Column:
    return F.coalesce(parse_price(text), F.lit(0))


def parse_reviews(text: Column) -> Column:
    """The digits as an unsigned 32-bit number."""
    n = digits(text).try_cast("bigint")
    return F.when(n <= 4294967295, n)


def parse_rating(text: Column) -> Column:
    """A decimal number with nothing but white space around it, else null."""
    bare = trim_all(text)
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def parse_stars(text: Column) -> Column:
    """A whole number above zero with nothing but white space around it, else null."""
    bare = trim_all(text)
    n = F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("int"))
    return F.when(n > 0, n)


def parse_plus_days(text: Column) -> Column:
    """'+1' gives 1; anything else that isn't a number gives 0."""
    first = F.regexp_extract(F.regexp_replace(text, r"^\++", ""), r"(?U)(\S+)", 1)
    return F.coalesce(F.when(first.rlike(r"^[+-]?[0-9]+$"), first.try_cast("int")), F.lit(0))


def arrival_text(time: Column, plus_days: Column) -> Column:
    return F.when(plus_days == 0, time).otherwise(F.concat(time, F.lit(" +"), plus_days.cast("string"), F.lit("d")))


def layovers(labels: Column) -> Column:
    """Every stop of every label: array<struct<_airport_code, airport_city, duration_minutes>>."""

    def of(label: Column) -> Column:
        parts = F.arrays_zip(
            F.regexp_extract_all(label, F.lit(LAYOVER), F.lit(1)).alias("h"), F.regexp_extract_all(label, F.lit(LAYOVER), F.lit(2)).alias("m"), F.regexp_extract_all(label, F.lit(LAYOVER), F.lit(3)).alias("c")
        )
        whole = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
        return F.transform(parts, lambda p: F.struct(F.lit(None).cast("string").alias("_airport_code"), trim_all(p["c"]).alias("airport_city"), (whole(p["h"]) * 60 + whole(p["m"])).alias("duration_minutes")))

    return F.flatten(F.transform(labels, of))


def find_layovers(labels: list[str | None]) -> list[dict]:
    """``layovers`` outside of columns."""
    whole = lambda x: int(x) if x and int(x) < 1 << 31 else 0
    found = (m for label in labels if label is not None for m in re.finditer(LAYOVER.removeprefix("(?U)"), label))
    return [{"_airport_code": None, "airport_city": m[3].strip(), "duration_minutes": whole(m[1]) * 60 + whole(m[2])} for m in found]


def base36(text: Column) -> Column:
    """An unsigned 32-bit base-36 number; 0 if it isn't one."""
    value = F.when(text.rlike(r"^\+?[0-9A-Za-z]+$"), F.conv(F.regexp_replace(text, r"^\+?0*(?=[0-9A-Za-z])", ""), 36, 10).try_cast("decimal(38,0)"))
    return F.coalesce(F.when((value <= 4294967295) & (F.length(F.regexp_replace(text, r"^\+?0*", "")) <= 7), value.cast("bigint")), F.lit(0).cast("bigint"))


def padded(number: Column, width: int) -> Column:
    """Zero-padded on the left; a longer number stays whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def itinerary_id(origin: Column, destination: Column, pos: Column) -> Column:
    base = F.shiftleft(base36(origin), 16).bitwiseAND(F.lit(4294967295)).bitwiseOR(base36(destination))
    return F.concat(padded(base, 6), padded(pos, 2))


def percent_encode(text: Column) -> Column:
    """UTF-8 percent encoding that keeps letters, digits, '-', '.', '_' and '~'."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parse_iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]{1,6}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def parse_cli_date(text: Column) -> Column:
    """Dashes or slashes."""
    return F.coalesce(parse_iso_date(text), F.try_to_date(text, "yyyy/M/d"))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def nights(checkin: Column, checkout: Column) -> Column:
    return F.datediff(checkout, checkin)


def day_before(date: Column) -> Column:
    return F.date_sub(date, 1)


def rating_code(rating: Column) -> Column:
    """9 from 4.5, 8 from 4.0, else 7; 0 for none."""
    return F.when(rating.isNull(), 0).when(rating >= 4.5, 9).when(rating >= 4.0, 8).otherwise(7)


def rating_from_code(code: Column) -> Column:
    return F.when(code > 0, code / F.lit(2.0))


def absolute_url(href: Column) -> Column:
    return F.when(href.startswith("/travel/"), F.concat(F.lit(SITE), href)).otherwise(href)


def format_duration(minutes: Column) -> Column:
    """'2h', '45m', '2h 05m'; 0 is '0h'."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(minutes.isNull(), None).when(m == 0, F.format_string("%dh", h)).when(h == 0, F.format_string("%dm", m)).otherwise(F.format_string("%dh %02dm", h, m))


def format_times(departure: Column, arrival: Column) -> Column:
    return F.concat(F.coalesce(departure, F.lit("??:??")), F.lit(" → "), F.coalesce(arrival, F.lit("??:??")))


def format_stops(stops: Column) -> Column:
    """'direct', '1 stop: 2h@Oslo', '2 stops: 2h@Oslo, 45m@Bergen'."""
    label = lambda s: F.concat(F.coalesce(format_duration(s["duration_minutes"]), F.lit("??")), F.lit("@"), F.coalesce(s["airport_city"], F.lit("Unknown")))
    n = F.size(stops)
    text = F.array_join(F.transform(stops, label), ", ")
    return F.when(n == 0, "direct").when(n == 1, F.concat(F.lit("1 stop: "), text)).otherwise(F.concat(n.cast("string"), F.lit(" stops: "), text))


def dash_bar(width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.repeat(F.lit("-"), F.least(width, F.lit(100)))


def whole_price(price: Column) -> Column:
    """A price as an int, towards zero, held within the range; not-a-number is 0."""
    return F.when(price.isNull(), None).when(F.isnan(price), 0).otherwise(F.greatest(F.least(price, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"))


def preview(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def kilobytes(text: Column) -> Column:
    return (F.octet_length(text) / 1024).cast("bigint")


def _split_list(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def children_list(text: Column) -> Column:
    """'0, 7' gives [1, 7]: age 0 counts as 1; null if any part isn't a number."""
    ages = F.transform(_split_list(text), lambda x: F.when(trim_all(x).rlike(r"^[+-]?[0-9]+$"), trim_all(x).try_cast("int")))
    return F.when(F.forall(ages, lambda a: a.isNotNull()), F.transform(ages, lambda a: F.when(a == 0, 1).otherwise(a)))


def amenity_list(text: Column) -> Column:
    """Trimmed, upper-case, '-' as '_'."""
    return F.transform(_split_list(text), lambda x: F.replace(F.upper(trim_all(x)), F.lit("-"), F.lit("_")))


def star_list(text: Column) -> Column:
    """Numbers from 1 to 5; null if any part isn't one."""
    stars = F.transform(_split_list(text), lambda x: F.when(trim_all(x).rlike(r"^[+-]?[0-9]+$"), trim_all(x).try_cast("int")))
    return F.when(F.forall(stars, lambda s: F.coalesce(s.between(1, 5), F.lit(False))), stars)
