"""What kind of page was captured, as column expressions over its html and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Strings that tell pages apart.
CONSENT = ("consent.google.com", "ppConfig")
FLIGHT_MARKS = ("pIav2d", "JMc5Xc")
FLIGHT_LOADING = ("Loading results", "jsshadow")
HOTEL_MARKS = ("uaTTDe", "BgYkof", "KFi5wf", "LtjZ2d")
HOTEL_FAILURE_MARKS = ("uaTTDe", "BgYkof", "KFi5wf")
HOTEL_LOADING = ("Loading", "jsshadow")
SHORT_PREVIEW, PREVIEW, LONG_PREVIEW = 300, 500, 2000


def has_any(html: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | html.contains(m)
    return F.coalesce(out, F.lit(False))


def http_error(status: Column, html: Column) -> Column:
    """A message with the start of the body unless the status is 2xx."""
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    return F.when(~ok, F.concat(F.lit("HTTP error "), F.coalesce(status.cast("string"), F.lit("?")), F.lit(": "), F.coalesce(text.preview(html, PREVIEW), F.lit(""))))


def consent_error(html: Column) -> Column:
    return F.when(has_any(html, CONSENT), F.concat(F.lit("Consent wall detected: "), text.preview(html, SHORT_PREVIEW)))


def hotel_marker_warning(html: Column) -> Column:
    return F.when(~has_any(html, HOTEL_MARKS) & (F.char_length(html) > 1000), "No hotel markers in the page")


def flight_failure(html: Column) -> Column:
    """Why a page without flights has none, in order of precedence."""
    cards = has_any(html, FLIGHT_MARKS)
    return F.when(has_any(html, CONSENT), "consent").when(~cards & has_any(html, FLIGHT_LOADING), "loading").when(~cards, "no_cards").otherwise("parser_drift")


def hotel_failure(html: Column) -> Column:
    marks = has_any(html, HOTEL_FAILURE_MARKS)
    return F.when(has_any(html, HOTEL_LOADING) & ~marks, "loading").when(~marks, "no_markers").otherwise("other")


def suspicious(stops_label: Column, minutes: Column) -> Column:
    """Said to be direct, yet longer than 18 hours."""
    return (stops_label == "direct") & (F.coalesce(minutes, F.lit(0)) > 1080)
