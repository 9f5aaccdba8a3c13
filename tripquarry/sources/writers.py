"""Sinks: page archives, HTML files by request, JSON responses, dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pages.write.mode(mode).parquet(path, compression="zstd")


def write_html(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw pages as text, a folder for each ``debug_{from}_{to}``."""
    named = pages.select(F.concat(F.lit("debug_"), "from_airport", F.lit("_"), "to_airport").alias("name"), F.col("html").alias("value"))
    named.write.mode(mode).option("lineSep", "\n").partitionBy("name").text(path)


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON line for each response; null fields are left out."""
    responses.select("response.*").write.mode(mode).json(path)


def dry_run(requests: DataFrame) -> DataFrame:
    """The URLs alone; pages aren't read."""
    return requests.select("request_id", "validation_error", "search_url")
