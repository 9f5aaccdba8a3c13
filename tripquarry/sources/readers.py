"""Sources: captured pages, requests, tool inputs, token vectors and command lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domains, schemas
from ..functions import text, tokens


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages with the explicit schema; only the columns in use are read from Parquet."""
    return spark.read.schema(schemas.PAGE).format(fmt).load(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files, plain or Zstandard (``*.html.zst``), as pages named by their file."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("url"))
    return files.select(F.regexp_replace("_file", r"\.html(\.zst)?$", "").alias("request_id"), "url", F.lit(200).alias("status"), "html")


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Token test vectors: a request for each case, with the token that is expected."""
    cases = spark.read.schema(schemas.TOKEN_VECTORS).json(path, multiLine=True).select(F.explode("cases").alias("c"))
    order = {"adult": "adults", "child": "children", "infant_in_seat": "infants_in_seat", "infant_on_lap": "infants_on_lap"}
    counts = F.array(*[F.struct(F.lit(t).alias("type"), F.coalesce(F.col(f"c.input.passengers.{n}"), F.lit(0)).cast("bigint").alias("count")) for t, n in order.items()])
    plain = lambda n: F.replace(F.col(f"c.input.{n}"), F.lit("-"), F.lit("_"))
    return cases.select(
        F.col("c.name").alias("request_id"),
        F.upper("c.input.from_airport").alias("from_airport"),
        F.upper("c.input.to_airport").alias("to_airport"),
        F.col("c.input.depart_date").alias("depart_date"),
        F.lit(None).cast("string").alias("return_date"),
        plain("cabin_class").alias("cabin_class"),
        F.filter(counts, lambda p: p["count"] > 0).alias("passengers"),
        plain("trip_type").alias("trip_type"),
        F.nullif(F.col("c.input.max_stops"), F.lit(0)).alias("max_stops"),
        F.lit(None).cast("array<string>").alias("preferred_airlines"),
        F.col("c.expected_tfs").alias("expected_tfs"),
    )


def parse_flight_inputs(frame: DataFrame, json_col: str = "input") -> DataFrame:
    """JSON tool inputs to a struct column; text that isn't such JSON gives nulls."""
    return frame.withColumn(json_col, F.from_json(json_col, schemas.FLIGHT_TOOL_INPUT))


def parse_hotel_inputs(frame: DataFrame, json_col: str = "input") -> DataFrame:
    return frame.withColumn(json_col, F.from_json(json_col, schemas.HOTEL_TOOL_INPUT))


def flight_arguments(frame: DataFrame) -> DataFrame:
    """Command-line values (strings) to flight requests: names folded, airports in capitals."""
    none = F.lit(None)
    kinds = {"adult": "adults", "child": "children", "infant_in_seat": "infants_in_seat", "infant_on_lap": "infants_on_lap"}
    counts = F.array(*[F.struct(F.lit(t).alias("type"), F.col(n).cast("bigint").alias("count")) for t, n in kinds.items()])
    trip = F.try_element_at(domains.TRIP._map(domains.TRIP_CLI), F.lower("trip"))
    return frame.select(
        "request_id",
        F.upper("from").alias("from_airport"),
        F.upper("to").alias("to_airport"),
        text.iso_date(text.parse_cli_date(F.col("date"))).alias("depart_date"),
        text.iso_date(text.parse_cli_date(F.col("return_date"))).alias("return_date"),
        domains.SEAT_CLI.canonical(F.col("cabin")).alias("cabin_class"),
        F.filter(counts, lambda p: p["count"] > 0).alias("passengers"),
        trip.alias("trip_type"),
        F.nullif(F.col("max_stops").cast("int"), F.lit(0)).alias("max_stops"),
        F.when(F.col("airlines") != "", F.transform(F.split("airlines", ","), lambda x: text.trim_all(x))).otherwise(none).alias("preferred_airlines"),
    )


def hotel_arguments(frame: DataFrame) -> DataFrame:
    """Command-line values (strings) to hotel requests, with ``unknown_amenities`` beside them."""
    wishes = text.amenity_list(F.col("amenities"))
    known = lambda a: domains.AMENITY.canonical(a).isNotNull()
    come, go = text.parse_iso_date(F.col("checkin")), text.parse_iso_date(F.col("checkout"))
    return frame.select(
        "request_id",
        F.lit(1).alias("version"),
        F.col("adults").cast("bigint").alias("adults"),
        text.children_list(F.col("children")).alias("children_ages"),
        F.col("location").alias("loc_q_search"),
        *[F.lit("").alias(n) for n in ("loc_ts_name", "loc_ts_id", "loc_ts_coords")],
        text.iso_date(come).alias("checkin_date"),
        text.iso_date(go).alias("checkout_date"),
        text.nights(come, go).alias("nights"),
        F.lit(0).alias("used_guests_dropdown"),
        F.upper("currency").alias("currency"),
        domains.sort_order(F.col("sort")).alias("sort_order"),
        F.col("rating").try_cast("double").alias("min_guest_rating"),
        text.star_list(F.col("stars")).alias("hotel_stars"),
        F.transform(F.filter(wishes, known), lambda a: domains.AMENITY.canonical(a)).alias("amenities"),
        text.whole_price(F.col("min_price").try_cast("double")).alias("min_price"),
        text.whole_price(F.col("max_price").try_cast("double")).alias("max_price"),
        F.filter(wishes, lambda a: ~known(a)).alias("unknown_amenities"),
    )


def flight_requests_from_tokens(frame: DataFrame, token_col: str = "tfs", id_col: str = "request_id") -> DataFrame:
    """Requests read from tokens, with ``decode_error`` for those that aren't one."""
    decoded = frame.select(F.col(id_col).alias("request_id"), tokens.tfs_decode(F.col(token_col)).alias("_d"))
    return decoded.select("request_id", "_d.params.*", F.col("_d.error").alias("decode_error"))


def hotel_requests_from_tokens(frame: DataFrame, token_col: str = "ts", id_col: str = "request_id") -> DataFrame:
    decoded = frame.select(F.col(id_col).alias("request_id"), tokens.ts_decode(F.col(token_col)).alias("_d"))
    return decoded.select("request_id", "_d.params.*", F.col("_d.error").alias("decode_error"))
