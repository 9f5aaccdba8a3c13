"""Page streams.  Codecs and extractors are row-local, so the batch functions run on a stream as
they are; joins with requests are stream-static.  No event-time operators are claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import extract


def page_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Pages as Parquet files arrive; the limit on files is the stream's admission control."""
    reader = spark.readStream.schema(schemas.PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hotel_stream(pages: DataFrame) -> DataFrame:
    return extract.extract_hotels(pages)


def flight_stream(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Itineraries of a page stream; the requests are a static table."""
    own = requests.select("request_id", "from_airport", "to_airport")
    return extract.extract_flights(pages.join(own, "request_id"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
