"""Text renderings: the flight table and the hotel list, as columns and as lines.

Only the first few rows of each request are shown, which is the feature; every figure in the
heading is of all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .pages import suspicious
from .responses import in_order

# Column floors, the shrunken floors, the rank column, what the frame takes.
FLOORS = {"airline": 7, "times": 15, "duration": 10, "stops": 25}
LEAST = {"airline": 4, "times": 10, "duration": 5, "stops": 10}
RANK_WIDTH, MARGIN, NARROW = 5, 25, 50
TOP_FLIGHTS, TOP_HOTELS, RULE = 5, 10, 96


def first_segment(flights: Column) -> Column:
    return F.try_element_at(flights, F.lit(1))


def flight_cells(itineraries: DataFrame) -> DataFrame:
    """Add the displayed texts ``airline, times, duration, stops`` and ``warn``."""
    seg = first_segment(F.col("flights"))
    minutes = F.coalesce("duration_minutes", F.lit(0))
    cells = itineraries.withColumns(
        {
            "airline": F.coalesce(seg["airline"], F.lit("??")),
            "times": text.format_times(seg["departure_time"], seg["arrival_time"]),
            "duration": text.format_duration(minutes),
            "stops": text.format_stops(F.col("layovers")),
        }
    )
    return cells.withColumn("warn", F.when(suspicious(F.col("stops"), F.col("duration_minutes")), " ⚠️").otherwise(""))


def _widest() -> list[Column]:
    """Aggregates: the widest cell of each column in bytes, with floors."""
    return [F.greatest(F.lit(w), F.max(F.octet_length(n))).alias(f"{n}_widest") for n, w in FLOORS.items()]


def _fitted(terminal: int) -> list[Column]:
    """Widths from the widest cells, shrunk in proportion where the terminal is too narrow."""
    room = max(0, terminal - MARGIN)
    widest = {n: F.col(f"{n}_widest") for n in FLOORS}
    total = sum(widest.values(), F.lit(0))
    shrink = (total > room) & F.lit(room > NARROW)
    fit = lambda n: F.greatest(F.floor(widest[n] * (F.lit(float(room)) / total)).cast("int"), F.lit(LEAST[n]))
    return [F.when(shrink, fit(n)).otherwise(widest[n]).cast("int").alias(f"{n}_width") for n in FLOORS]


def column_widths(cells: DataFrame, terminal: int = 100) -> DataFrame:
    """(request_id, a width for each column of ``flight_cells``)."""
    return cells.groupBy("request_id").agg(*_widest()).select("request_id", *_fitted(terminal))


def _left(value: Column, width: Column) -> Column:
    """Padded on the right; a longer value stays whole."""
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(width - F.char_length(value), F.lit(0))))


def _right(value: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(value), F.lit(0))), value)


def flight_table(itineraries: DataFrame, requests: DataFrame, *, terminal: int = 100, top: int = TOP_FLIGHTS, with_widths: bool = False) -> DataFrame:
    """(request_id, table): heading, figures, and a line for each of the first ``top`` rows;
    ``with_widths`` adds the widths of the columns."""
    shown = F.struct("pos", *FLOORS, "price", "warn")
    # One pass over the rows: figures and widths of all, cells of the first few.
    per = flight_cells(itineraries).groupBy("request_id").agg(
        F.count("*").alias("_total"), F.coalesce(F.min_by("price", "pos"), F.lit(0)).alias("_best"), F.sort_array(F.collect_list(F.when(F.col("pos") < top, shown))).alias("_top"), *_widest()
    )
    sized = per.select("request_id", "_total", "_best", "_top", *_fitted(terminal))

    def line(x: Column) -> Column:
        columns = [c for n in FLOORS for c in (F.lit("  "), _left(x[n], F.col(f"{n}_width")))]
        return F.concat(F.lit("  "), _right((x["pos"] + 1).cast("string"), RANK_WIDTH), *columns, F.lit("   $"), F.coalesce(x["price"], F.lit(0)).cast("string"), x["warn"])

    rows = sized.withColumn("_lines", F.array_join(F.transform("_top", line), "\n"))
    bar, dash = F.lit("=" * RULE), text.dash_bar(terminal)
    titles = {"airline": "AIRLINE", "times": "DEP → ARR", "duration": "DURATION", "stops": "LAYOVERS"}
    header = F.concat(F.lit("  " + "#".rjust(RANK_WIDTH)), *[x for n, t in titles.items() for x in (F.lit("  "), _left(F.lit(t), F.col(f"{n}_width")))], F.lit("   PRICE"))
    url = F.when(F.col("search_url").isNotNull(), F.concat(F.lit("\n🔗 Search URL: "), "search_url", F.lit("\n"))).otherwise("")
    table = F.concat(
        bar, F.lit("\n  🛫  "), "from_airport", F.lit(" → "), "to_airport", F.lit(" on "), "depart_date", F.lit("\n"), bar, F.lit("\n\n💰 Best Price:  $"), F.col("_best").cast("string"), F.lit("\n📊 Total Flights: "), F.col("_total").cast("string"),
        F.lit("\n"), url, F.lit("\n🏆 Top "), F.least(F.lit(top), F.col("_total")).cast("string"), F.lit(" Results:\n"), dash, F.lit("\n\n"), header, F.lit("\n"), dash, F.lit("\n\n"), "_lines",
    )
    # Both sides have a row for each request; sizes guessed from files would have one of them
    # broadcast, however many requests there are.
    own = requests.select("request_id", "from_airport", "to_airport", "depart_date", "search_url")
    return own.join(rows.hint("merge"), "request_id").select("request_id", table.alias("table"), *([f"{n}_width" for n in FLOORS] if with_widths else []))


def hotel_list(hotels: DataFrame, *, limit: int = TOP_HOTELS) -> DataFrame:
    """(request_id, listing): the count of all hotels and an entry for each of the first."""
    part = lambda value, made: F.when(value.isNotNull(), made)
    stars = F.when(F.col("star_class") != "", text.trim_all(F.col("star_class")))
    entry = F.array_join(
        F.array_compact(
            F.array(
                F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "name"),
                part(stars, F.concat(F.lit("   "), stars)),
                F.concat(F.lit("   Price: "), "price"),
                part(F.col("rating"), F.concat(F.lit("   Rating: "), F.format_string("%.1f", "rating"), F.lit(" ("), F.coalesce("reviews", F.lit(0)).cast("string"), F.lit(" reviews)"))),
                F.when(F.size("amenities") > 0, F.concat(F.lit("   Amenities: "), F.array_join("amenities", ", "))),
                part(F.col("location_rating"), F.concat(F.lit("   Location: "), "location_rating")),
            )
        ),
        "\n",
    )
    figures = hotels.groupBy("request_id").agg(F.count("*").alias("_total"))
    shown = hotels.where(F.col("pos") < limit).groupBy("request_id").agg(F.array_join(in_order(entry), "\n\n").alias("_entries"))
    return figures.join(shown, "request_id", "left").select("request_id", F.concat(F.lit("Found "), F.col("_total").cast("string"), F.lit(" hotel(s)\n"), F.coalesce("_entries", F.lit(""))).alias("listing"))


def ordered(results: DataFrame, order: str = "relevance") -> DataFrame:
    """An extra: order hotels locally by the meaning of a sort order (pages keep the service's)."""
    keys = {
        "relevance": [F.col("pos")],
        "lowest_price": [F.asc_nulls_last(text.parse_price(F.col("price"))), F.col("pos")],
        "highest_rating": [F.desc_nulls_last("rating"), F.col("pos")],
        "most_reviewed": [F.desc_nulls_last("reviews"), F.col("pos")],
    }
    return results.orderBy("request_id", *keys[order])
