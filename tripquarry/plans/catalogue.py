"""Registered queries of the library's own operators, with the SQL that states the same result.

The tables at hand hold no travel data, so inputs are synthesised from their columns by the same
arithmetic on both sides; the operators run over every row.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domains, schemas
from ..functions import text, tokens, wire
from ..operators import admission, extract, pages, render, requests, responses
from ..sources import readers
from . import search

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file that cost much each, dealt over all cores: a file of few row groups would
    be read, and its pages parsed, in few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- scalar functions ---------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber * 60 + CAST(l_quantity AS INT) AS minutes,
  CASE WHEN CAST(l_quantity AS INT) = 0 THEN l_linenumber || 'h' ELSE l_linenumber || 'h ' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0') || 'm' END AS shown,
  CAST(l_quantity AS INT) AS only_minutes
FROM lineitem""")
def duration_parse(spark: SparkSession, folder: str) -> DataFrame:
    """F1, F26."""
    q = F.col("l_quantity").cast("int")
    label = F.concat(s("l_linenumber"), F.lit(" hr "), s(q), F.lit(" min"))
    minutes = text.parse_duration(label)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", minutes.alias("minutes"), text.format_duration(minutes).alias("shown"), text.parse_duration(F.concat(s(q), F.lit("m"))).alias("only_minutes"))


@query("""
SELECT o_orderkey, lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS time_text,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey * 1000 + o_orderkey % 1000 END AS INT) AS price, CAST(o_orderkey % 4 AS INT) AS plus_days,
  CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'x +' || (o_orderkey % 4) || 'd' END AS arrival,
  CAST(o_custkey * 1000 + o_orderkey % 1000 AS BIGINT) AS reviews,
  (o_orderkey % 50) / 10.0::DOUBLE AS rating, CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 END AS INT) AS stars
FROM orders""")
def time_and_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """F2-F4, F6, F7, F22-F24."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    thin = F.lit(" ")
    time = F.concat(F.lpad(s(k % 12 + 1), 2, "0"), F.lit(":"), F.lpad(s(c % 60), 2, "0"), thin, F.lit("AM"))
    price = F.when(k % 7 == 0, "Price unavailable").otherwise(F.concat(F.lit("$"), s(c), F.lit(","), F.lpad(s(k % 1000), 3, "0")))
    days = text.parse_plus_days(F.when(k % 4 == 0, "soon").otherwise(F.concat(F.lit("+"), s(k % 4), F.lit(" day"))))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        text.normalize_time(time).alias("time_text"),
        text.parse_price(price).alias("price"),
        days.alias("plus_days"),
        text.arrival_text(F.lit("x"), days).alias("arrival"),
        text.parse_reviews(F.concat(F.lit("("), s(c), F.lit(","), F.lpad(s(k % 1000), 3, "0"), F.lit(")"))).alias("reviews"),
        text.parse_rating(F.concat(F.lit(" "), s(F.floor(k % 50 / 10)), F.lit("."), s(k % 10), F.lit(" "))).alias("rating"),
        text.parse_stars(F.concat(s(k % 6), F.lit(" "))).alias("stars"),
    )


CITIES = ["Oslo", "New York", "Montréal", "Tel-Aviv"]


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 23 + 1 AS h, o_custkey % 60 AS m, (['{"','".join(CITIES)}'])[1 + CAST(o_custkey % 4 AS INT)] AS c1, (['{"','".join(CITIES)}'])[1 + CAST(o_orderkey % 4 AS INT)] AS c2 FROM orders)
SELECT o_orderkey, 0 AS pos, c1 AS city, CAST(h * 60 + m AS INT) AS minutes FROM o
UNION ALL SELECT o_orderkey, 1, c2, CAST(h * 60 AS INT) FROM o""")
def layover_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Two stops in one label, the second without minutes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*map(F.lit, CITIES))
    label = F.concat(
        F.lit("Layover (1 of 2) is a "), s(k % 23 + 1), F.lit(" hr "), s(c % 60), F.lit(" min layover at North Hub in "), F.get(names, (c % 4).cast("int")),
        F.lit(". Layover (2 of 2) is a "), s(k % 23 + 1), F.lit(" hr layover at North Hub in "), F.get(names, (k % 4).cast("int")), F.lit("."),
    )
    stops = table(spark, folder, "orders").select("o_orderkey", F.posexplode(text.layovers(F.array(label))).alias("pos", "stop"))
    return stops.select("o_orderkey", "pos", F.col("stop.airport_city").alias("city"), F.col("stop.duration_minutes").alias("minutes"))


@query("""
WITH t AS (SELECT n_nationkey, n_name, (ascii(substr(n_name, 1, 1)) - 55) * 1296 + (ascii(substr(n_name, 2, 1)) - 55) * 36 + (ascii(substr(n_name, 3, 1)) - 55) AS a, n_nationkey * 1296 + 35 AS b FROM nation)
SELECT n_nationkey, lpad(CAST(((a << 16) & 4294967295) | b AS VARCHAR), CAST(greatest(6, length(CAST(((a << 16) & 4294967295) | b AS VARCHAR))) AS INT), '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id,
  '0000000' || CAST(n_nationkey % 2 AS VARCHAR) AS no_id
FROM t""")
def itinerary_ids(spark: SparkSession, folder: str) -> DataFrame:
    """F8."""
    k = F.col("n_nationkey")
    other = F.concat(F.when(k < 10, s(k)).otherwise(F.chr(k + 55)), F.lit("0Z"))
    return table(spark, folder, "nation").select(
        "n_nationkey", text.itinerary_id(F.substring("n_name", 1, 3), other, k).alias("id"), text.itinerary_id(F.lit("S-O"), F.lit("ZZZZZZZZ"), k % 2).alias("no_id")
    )


@query("""
SELECT c_custkey, 'https://www.google.com/travel/search?q=' || url_encode(c_name || ' ' || c_mktsegment || ' ~*é/') || '&ts=abc' AS url,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://www.google.com/travel/x' ELSE '/other/x' END AS absolute FROM customer""")
def url_build(spark: SparkSession, folder: str) -> DataFrame:
    """F9, F25, C6."""
    name = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" ~*é/"))
    href = F.when(F.col("c_custkey") % 2 == 0, "/travel/x").otherwise("/other/x")
    return table(spark, folder, "customer").select("c_custkey", tokens.hotel_url(name, F.lit("abc")).alias("url"), text.absolute_url(href).alias("absolute"))


@query("""
SELECT p_partkey, (['economy','premium_economy','business','first',NULL])[1 + p_size % 5] AS seat, CAST((['1','2','3','4',NULL])[1 + p_size % 5] AS INT) AS seat_code,
  (['indoor_pool','kid_friendly','air_conditioned',NULL])[1 + p_size % 4] AS amenity, CAST((['4','12','40',NULL])[1 + p_size % 4] AS INT) AS amenity_code,
  (['lowest_price','most_reviewed',NULL])[1 + p_size % 3] AS sort_order, (['ECONOMY','PREMIUM_ECONOMY','BUSINESS','FIRST',NULL])[1 + p_size % 5] AS wire_name
FROM part""")
def enum_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """F15, F35, C11."""
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), F.col("p_size") % len(names))
    seat, amenity = domains.SEAT.canonical(pick("economy", "premium", "business", "first", "Economy")), domains.AMENITY.canonical(pick("INDOOR", "Kid_Friendly", "ac", "sauna"))
    return table(spark, folder, "part").select(
        "p_partkey", seat.alias("seat"), domains.SEAT.code(seat).alias("seat_code"), amenity.alias("amenity"), domains.AMENITY.code(amenity).alias("amenity_code"),
        domains.sort_order(pick("price", "reviews", "relevance")).alias("sort_order"), domains.SEAT.wire_name(seat).alias("wire_name"),
    )


@query("""
SELECT p_partkey, 'pool,spa' AS valid, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS invalid,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Unknown amenity(s): ' || p_type || '. Valid amenities: indoor_pool, outdoor_pool, pool, spa, kid_friendly, air_conditioned, ev_charger.' END AS warning
FROM part""")
def amenity_partition(spark: SparkSession, folder: str) -> DataFrame:
    """V34, F34."""
    names = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Pool"), F.lit("SPA"))).otherwise(F.array(F.lit("Pool"), F.col("p_type"), F.lit("SPA")))
    split = table(spark, folder, "part").select("p_partkey", requests.split_amenities(names).alias("x"))
    return split.select("p_partkey", F.array_join("x.valid", ",").alias("valid"), F.array_join("x.invalid", ",").alias("invalid"), requests.amenity_warning(F.col("x.invalid")).alias("warning"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1,7' WHEN 1 THEN '' ELSE NULL END AS ages, CASE WHEN o_orderkey % 2 = 0 THEN '2,5' ELSE NULL END AS stars,
  'EV_CHARGER,NO_SUCH' AS amenities, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before
FROM orders""")
def argument_lists(spark: SparkSession, folder: str) -> DataFrame:
    """F11, F12, F14, F18-F20."""
    k = F.col("o_orderkey")
    day = text.parse_cli_date(F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")))
    ages = text.children_list(F.when(k % 3 == 0, "0, 7").when(k % 3 == 1, "").otherwise("3,x"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(ages.isNotNull(), F.array_join(ages.cast("array<string>"), ",")).alias("ages"),
        F.when(text.star_list(F.when(k % 2 == 0, "2, 5").otherwise("2,6")).isNotNull(), F.lit("2,5")).alias("stars"),
        F.array_join(text.amenity_list(F.lit("ev-charger, no-such")), ",").alias("amenities"),
        text.iso_date(day).alias("day"),
        text.iso_date(text.day_before(day)).alias("day_before"),
    )


@query("""
SELECT page_id, substr(html, 1, 300) AS preview, CAST(strlen(html) // 1024 AS BIGINT) AS kilobytes, repeat('-', CAST(least(page_id, 100) AS INT)) AS bar FROM pages""")
def page_preview(spark: SparkSession, folder: str) -> DataFrame:
    """F30, F32, F33."""
    return table(spark, folder, "pages").select("page_id", text.preview(F.col("html"), pages.SHORT_PREVIEW).alias("preview"), text.kilobytes(F.col("html")).alias("kilobytes"), text.dash_bar(F.col("page_id").cast("int")).alias("bar"))


# --- requests and tokens ------------------------------------------------------------------------


def _flights(spark: SparkSession, folder: str) -> DataFrame:
    """A flight request for each order, some of them invalid."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    person = lambda kind, n: F.struct(F.lit(kind).alias("type"), n.cast("bigint").alias("count"))
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        s(k).alias("request_id"),
        F.when(k % 41 == 0, "").otherwise("SFO").alias("from_airport"),
        F.when(k % 43 == 0, "").otherwise(F.get(F.array(*map(F.lit, ("JFK", "LHR", "NRT"))), (c % 3).cast("int"))).alias("to_airport"),
        F.when(k % 47 == 0, "2025-02-30").otherwise(text.iso_date(day)).alias("depart_date"),
        F.when(k % 2 == 0, text.iso_date(F.date_add(day, (c % 9 - 1).cast("int")))).alias("return_date"),
        F.get(F.array(*map(F.lit, ("economy", "business"))), (c % 2).cast("int")).alias("cabin_class"),
        F.array(person("adult", k % 4), person("child", c % 3), person("infant_on_lap", c % 2)).alias("passengers"),
        F.get(F.array(*map(F.lit, ("round_trip", "one_way", "multi_city"))), (k % 3).cast("int")).alias("trip_type"),
        F.when(c % 4 > 0, c % 4).cast("int").alias("max_stops"),
        F.when(c % 5 == 0, F.array(F.lit("UA"), F.lit("LH"))).alias("preferred_airlines"),
    )


FLIGHTS_SQL = """
r AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'SFO' END AS f, CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE (['JFK','LHR','NRT'])[1 + CAST(o_custkey % 3 AS INT)] END AS t,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 - 1 AS INT) END AS b,
  o_orderkey % 4 AS adults, o_custkey % 3 AS children, o_custkey % 2 AS lap, o_orderkey % 3 AS trip FROM orders),
v AS (SELECT *, CASE WHEN f = '' THEN 'Origin airport is required' WHEN t = '' THEN 'Destination airport is required' WHEN adults = 0 THEN 'At least one adult is required'
  WHEN lap > adults THEN 'Cannot have more infants on lap (' || lap || ') than adults (' || adults || ')' WHEN d IS NULL THEN 'Invalid depart date format'
  WHEN trip = 0 AND b IS NOT NULL AND b < d THEN 'Return date must be on or after departure date' END AS error FROM r)"""


@query(f"WITH {FLIGHTS_SQL} SELECT request_id, error AS validation_error, CASE WHEN trip = 0 AND b IS NULL THEN 'Round trip without a return date: searching one way' END AS warning FROM v")
def flight_validate(spark: SparkSession, folder: str) -> DataFrame:
    """V1-V7, V29."""
    return _flights(spark, folder).select("request_id", requests.flight_error().alias("validation_error"), requests.one_way_warning().alias("warning"))


_LEG = "'12' || '0A' || hex({d}::VARCHAR) || CASE WHEN c % 4 > 0 THEN '280' || (c % 4) ELSE '' END || CASE WHEN c % 5 = 0 THEN '32025541' || '32024C48' ELSE '' END || '6A051203' || hex({f}) || '72051203' || hex({t})"


@query(f"""
WITH {FLIGHTS_SQL},
l AS (SELECT *, {_LEG.format(d="d", f="f", t="t")} AS there, {_LEG.format(d="b", f="t", t="f")} AS back, repeat('01', CAST(adults AS INT)) || repeat('02', CAST(children AS INT)) || repeat('04', CAST(lap AS INT)) AS p FROM v WHERE error IS NULL),
m AS (SELECT request_id, '1A' || printf('%02X', length(there) // 2) || there || CASE WHEN trip = 0 AND b IS NOT NULL THEN '1A' || printf('%02X', length(back) // 2) || back ELSE '' END
  || '42' || printf('%02X', length(p) // 2) || p || '48' || CASE WHEN c % 2 = 0 THEN '01' ELSE '03' END || '9801' || (['01','02','03'])[1 + CAST(trip AS INT)] AS h FROM l)
SELECT v.request_id, base64(unhex(h)) AS tfs, 'https://www.google.com/travel/flights/search?tfs=' || base64(unhex(h)) || '&hl=en&curr=USD&tfu=EgQIABABIgA' AS search_url FROM v LEFT JOIN m USING (request_id)""")
def tfs_encode(spark: SparkSession, folder: str) -> DataFrame:
    """C1, C5, C7, C8, A3."""
    return requests.with_flight_token(_flights(spark, folder)).select("request_id", "tfs", "search_url")


@query(f"""
WITH {FLIGHTS_SQL}
SELECT request_id, f AS from_airport, t AS to_airport, strftime(d, '%Y-%m-%d') AS depart_date, CASE WHEN trip = 0 THEN strftime(b, '%Y-%m-%d') END AS return_date, (['economy','business'])[1 + CAST(c % 2 AS INT)] AS cabin_class,
  'adult:' || adults || CASE WHEN children > 0 THEN ',child:' || children ELSE '' END || CASE WHEN lap > 0 THEN ',infant_on_lap:' || lap ELSE '' END AS passengers,
  (['round_trip','one_way','multi_city'])[1 + CAST(trip AS INT)] AS trip_type, CAST(CASE WHEN c % 4 > 0 THEN c % 4 END AS INT) AS max_stops, CASE WHEN c % 5 = 0 THEN 'UA,LH' END AS airlines, CAST(NULL AS VARCHAR) AS decode_error
FROM v WHERE error IS NULL""")
def tfs_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """C1 then C2, A2."""
    coded = requests.with_flight_token(_flights(spark, folder)).where("validation_error IS NULL").select("request_id", "tfs")
    d = coded.select("request_id", tokens.tfs_decode(F.col("tfs")).alias("d")).select("request_id", "d.params.*", F.col("d.error").alias("decode_error"))
    people = F.array_join(F.transform("passengers", lambda p: F.concat(p["type"], F.lit(":"), p["count"].cast("string"))), ",")
    return d.select("request_id", "from_airport", "to_airport", "depart_date", "return_date", "cabin_class", people.alias("passengers"), "trip_type", "max_stops", F.array_join("preferred_airlines", ",").alias("airlines"), "decode_error")


def _stays(spark: SparkSession, folder: str) -> DataFrame:
    """A hotel request for each order, some of them invalid."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        s(k).alias("request_id"), F.lit(1).alias("version"), (k % 5).alias("adults"),
        F.when(c % 3 == 0, F.array(F.lit(5), (k % 19).cast("int"))).otherwise(F.array().cast("array<int>")).alias("children_ages"),
        F.concat(F.lit("City "), s(c % 50)).alias("loc_q_search"), *[F.lit("").alias(n) for n in ("loc_ts_name", "loc_ts_id", "loc_ts_coords")],
        F.when(k % 47 == 0, "soon").otherwise(text.iso_date(day)).alias("checkin_date"), text.iso_date(F.date_add(day, (c % 33).cast("int"))).alias("checkout_date"),
        F.lit(0).alias("nights"), F.lit(0).alias("used_guests_dropdown"), F.lit("USD").alias("currency"), F.when(k % 4 == 0, "lowest_price").alias("sort_order"),
        F.when(k % 3 > 0, F.when(k % 3 == 1, 4.5).otherwise(3.5)).alias("min_guest_rating"), F.when(k % 7 == 0, F.array(F.lit(4), F.lit(5))).otherwise(F.array().cast("array<int>")).alias("hotel_stars"),
        F.when(c % 2 == 0, F.array(F.lit("spa"), F.lit("pool"))).otherwise(F.array().cast("array<string>")).alias("amenities"),
        F.when(k % 6 == 0, c % 100).cast("int").alias("min_price"), F.when(k % 10 == 0, F.lit(60)).alias("max_price"),
    )


STAYS_SQL = """
r AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey % 5 AS adults, o_custkey % 3 = 0 AS kids, o_orderkey % 19 AS age, CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
  CAST(o_orderdate AS DATE) + CAST(o_custkey % 33 AS INT) AS b, o_custkey % 33 AS stay, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 100 END AS low, CASE WHEN o_orderkey % 10 = 0 THEN 60 END AS high FROM orders),
v AS (SELECT *, CASE WHEN adults < 1 THEN 'At least one adult is required' WHEN adults + CASE WHEN kids THEN 2 ELSE 0 END > 6 THEN 'Maximum 6 guests allowed'
  WHEN kids AND (age < 1 OR age > 17) THEN 'Children ages must be between 1 and 17 (ages 0-1 are encoded as 1)' WHEN d IS NULL THEN 'Invalid checkin date' WHEN stay = 0 THEN 'Checkout must be after check-in'
  WHEN stay > 30 THEN 'Stay must be 30 nights or fewer' WHEN low = 0 THEN 'Price must be positive' WHEN low > high THEN 'Minimum price cannot be greater than maximum price' END AS error FROM r)"""


@query(f"WITH {STAYS_SQL} SELECT request_id, error AS validation_error, CASE WHEN d < DATE '1996-06-01' THEN 'Check-in cannot be in the past' WHEN d IS NULL THEN 'Check-in cannot be in the past' END AS date_error FROM v")
def hotel_validate(spark: SparkSession, folder: str) -> DataFrame:
    """V8-V18, V20."""
    return _stays(spark, folder).select("request_id", requests.hotel_error().alias("validation_error"), requests.hotel_date_error(F.to_date(F.lit("1996-06-01"))).alias("date_error"))


def _vi(x: str) -> str:
    """A varint of up to two bytes, as hex, in SQL."""
    return f"CASE WHEN {x} < 128 THEN printf('%02X', {x}) ELSE printf('%02X%02X', {x} % 128 + 128, {x} // 128) END"


def _ld(tag: str, x: str) -> str:
    return f"'{tag}' || {_vi(f'(length({x}) // 2)')} || {x}"


def _day_sql(d: str) -> str:
    return f"('08' || {_vi(f'year({d})')} || '10' || printf('%02X', month({d})) || '18' || printf('%02X', day({d})))"


@query(f"""
WITH {STAYS_SQL},
a AS (SELECT *, repeat('0A020803', CAST(adults AS INT)) || CASE WHEN kids THEN '0A0408021005' || '0A04080210' || printf('%02X', age) ELSE '' END || CASE WHEN adults > 2 OR kids THEN '1001' ELSE '' END AS guests,
  {_day_sql("d")} AS come, {_day_sql("b")} AS go FROM v WHERE error IS NULL),
e AS (SELECT *, {_ld("0A", "come")} || {_ld("12", "go")} || '18' || printf('%02X', stay) AS stays,
  CASE WHEN c % 2 = 0 THEN '0A020A06' ELSE '' END || CASE WHEN k % 7 = 0 THEN '12020405' ELSE '' END || '1A00' || CASE WHEN k % 4 = 0 THEN '2803' ELSE '' END || '3A03555344' AS filters,
  CASE WHEN low IS NOT NULL THEN '0A0210' || printf('%02X', low) ELSE '' END || CASE WHEN high IS NOT NULL THEN '120210' || printf('%02X', high) ELSE '' END AS prices FROM a),
g AS (SELECT *, {_ld("12", "stays")} || '32020801' AS dates, {_ld("0A", "filters")} || '1A00' || CASE WHEN low IS NULL AND high IS NULL THEN '' ELSE {_ld("22", "prices")} END || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '2809' ELSE '2807' END AS config FROM e),
h AS (SELECT *, '0A021A00' || {_ld("12", "dates")} AS search FROM g),
m AS (SELECT request_id, rtrim(translate(base64(unhex('0801' || {_ld("12", "guests")} || {_ld("1A", "search")} || {_ld("2A", "config")})), '+/', '-_'), '=') AS ts FROM h)
SELECT v.request_id, ts, 'https://www.google.com/travel/search?q=City%20' || (c % 50) || '&ts=' || ts AS search_url FROM v LEFT JOIN m USING (request_id)""")
def ts_encode(spark: SparkSession, folder: str) -> DataFrame:
    """C3, C6, F13, F21."""
    return requests.with_hotel_token(_stays(spark, folder)).select("request_id", "ts", "search_url")


@query(f"""
WITH {STAYS_SQL}
SELECT request_id, adults, CASE WHEN kids THEN '5,' || age ELSE '' END AS ages, strftime(d, '%Y-%m-%d') AS checkin_date, strftime(b, '%Y-%m-%d') AS checkout_date, CAST(stay AS INT) AS nights,
  CAST(CASE WHEN adults > 2 OR kids THEN 1 ELSE 0 END AS INT) AS used_guests_dropdown, CASE WHEN k % 4 = 0 THEN 'lowest_price' END AS sort_order,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 4.5::DOUBLE ELSE 3.5::DOUBLE END AS min_guest_rating, CASE WHEN k % 7 = 0 THEN '4,5' ELSE '' END AS stars, CASE WHEN c % 2 = 0 THEN 'spa,pool' ELSE '' END AS amenities,
  CAST(low AS INT) AS min_price, CAST(high AS INT) AS max_price FROM v WHERE error IS NULL""")
def ts_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """C3 then C4."""
    coded = requests.with_hotel_token(_stays(spark, folder)).where("validation_error IS NULL").select("request_id", "ts")
    d = coded.select("request_id", tokens.ts_decode(F.col("ts")).alias("d")).select("request_id", "d.params.*")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return d.select("request_id", "adults", join("children_ages").alias("ages"), "checkin_date", "checkout_date", "nights", "used_guests_dropdown", "sort_order", "min_guest_rating", join("hotel_stars").alias("stars"), join("amenities").alias("amenities"), "min_price", "max_price")


@query("""
WITH r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'economy' WHEN 1 THEN 'business' WHEN 2 THEN 'premium_economy' ELSE 'economy' END AS cabin, CASE o_orderkey % 3 WHEN 1 THEN 'one_way' ELSE 'round_trip' END AS trip, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS back FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, cabin AS cabin_class, trip AS trip_type, 'adult:' || (o_orderkey % 3) || CASE WHEN o_custkey % 2 = 0 THEN ',child:2' ELSE '' END AS passengers, CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS INT) AS max_stops,
  CASE WHEN o_orderkey % 3 = 0 THEN 'At least one adult is required' WHEN back = 'soon' THEN 'Invalid return date format' END AS validation_error FROM r""")
def flight_tool_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """JSON tool inputs to requests."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), (k % n).cast("int"))
    asked = F.struct(
        F.lit("SFO").alias("from"), F.lit("JFK").alias("to"), text.iso_date(day).alias("date"), F.when(k % 5 == 0, "soon").when(k % 5 == 1, text.iso_date(F.date_add(day, 3))).alias("return_date"), pick(4, "economy", "Business", "PremiumEconomy", None).alias("seat"),
        (k % 3).alias("adults"), F.when(c % 2 == 0, F.array(F.lit(4), F.lit(9))).alias("children_ages"), pick(3, "round-trip", "one-way", None).alias("trip_type"), F.when(c % 3 > 0, c % 3).cast("int").alias("max_stops"),
    )
    inputs = table(spark, folder, "orders").select(s(k).alias("request_id"), F.to_json(asked).alias("input"))
    built = requests.flight_requests_from_tool(readers.parse_flight_inputs(inputs))
    people = F.array_join(F.transform("passengers", lambda p: F.concat(p["type"], F.lit(":"), p["count"].cast("string"))), ",")
    return built.select("request_id", "cabin_class", "trip_type", people.alias("passengers"), "max_stops", requests.flight_error().alias("validation_error"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderkey % 7 + 1 > 6 THEN 'Maximum 6 guests allowed' WHEN o_orderkey % 11 = 0 THEN 'Invalid checkout date' WHEN o_orderkey % 13 = 0 THEN 'Price must be positive'
  WHEN o_custkey % 7 IN (0, 5, 6) THEN 'Star rating must be between 2 and 5' END AS validation_error,
  CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'Departure date cannot be in the past' WHEN o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) - 400 < DATE '1995-01-01' THEN 'Return date cannot be in the past' END AS flight_date_error FROM orders""")
def more_rules(spark: SparkSession, folder: str) -> DataFrame:
    """V9, V12, V15, V18, V19."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    none = F.array().cast("array<int>")
    stay = {
        "adults": k % 7 + 1, "children_ages": none, "hotel_stars": F.array(F.lit(3), (c % 7 + 1).cast("int")), "checkin_date": F.lit("2026-01-05"), "checkout_date": F.when(k % 11 == 0, "never").otherwise("2026-01-09"),
        "min_price": F.lit(None).cast("int"), "max_price": F.when(k % 13 == 0, 0).otherwise(90),
    }
    trip = {"depart_date": text.iso_date(day), "return_date": F.when(k % 2 == 0, text.iso_date(F.date_sub(day, 400)))}
    return table(spark, folder, "orders").select(s(k).alias("request_id"), requests.hotel_error(stay).alias("validation_error"), requests.flight_date_error(F.to_date(F.lit("1995-01-01")), trip).alias("flight_date_error"))


def _token(*legs: bytes, people: tuple[int, ...] = (1,)) -> str:
    return base64.b64encode(b"".join(wire.bytes_field(3, x) for x in legs) + wire.packed_field(8, people)).decode()


def _bad_tokens() -> list[str]:
    """Tokens that break one rule each, and last one that breaks none."""
    leg = lambda day, a, b: wire.text_field(2, day) + wire.bytes_field(13, wire.text_field(2, a)) + wire.bytes_field(14, wire.text_field(2, b))
    day, early = "2025-07-15", "2025-07-10"
    return ["n*t base64", _token(leg(day, "", "JFK")), _token(leg(day, "SFO", "")), _token(leg("soon", "SFO", "JFK")), _token(leg(day, "SFO", "JFK"), leg(early, "JFK", "SFO")), _token(leg(day, "SFO", "JFK"), people=(1, 4, 4)), base64.b64encode(b"\x1a\x7f").decode(), _token(leg(day, "SFO", "JFK"))]


@query("""
SELECT o_orderkey, (['Failed to decode base64', 'from_airport is required', 'to_airport is required', 'Invalid depart date format', 'return_date (2025-07-10) must be on or after depart_date (2025-07-15)',
  'Cannot have more infants on lap (2) than adults (1)', 'buffer underflow', NULL])[1 + CAST(o_orderkey % 8 AS INT)] AS decode_error, CASE WHEN o_orderkey % 8 = 7 THEN 'SFO' END AS from_airport FROM orders""")
def token_errors(spark: SparkSession, folder: str) -> DataFrame:
    """A token that breaks a rule gives that rule's error and no request."""
    token = F.get(F.array(*map(F.lit, _bad_tokens())), (F.col("o_orderkey") % 8).cast("int"))
    read = readers.flight_requests_from_tokens(table(spark, folder, "orders").select("o_orderkey", token.alias("tfs")), id_col="o_orderkey")
    return read.select(F.col("request_id").alias("o_orderkey"), "decode_error", "from_airport")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 'SFO' AS from_airport, (['economy','premium_economy','business','first',NULL])[1 + CAST(o_orderkey % 5 AS INT)] AS cabin_class, (['round_trip','one_way',NULL])[1 + CAST(o_orderkey % 3 AS INT)] AS trip_type,
  strftime(o_orderdate, '%Y-%m-%d') AS depart_date, 'adult:' || (o_custkey % 3 + 1) || CASE WHEN o_custkey % 2 > 0 THEN ',child:1' ELSE '' END AS passengers, CAST(CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END AS INT) AS max_stops, CASE WHEN o_orderkey % 2 = 0 THEN 'UA,LH' END AS airlines FROM orders""")
def flight_command_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Command-line values to flight requests."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *x: F.get(F.array(*map(F.lit, x)), (k % n).cast("int"))
    values = table(spark, folder, "orders").select(
        s(k).alias("request_id"), F.lit("sfo").alias("from"), F.lit("Jfk").alias("to"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("date"), F.lit(None).cast("string").alias("return_date"),
        pick(5, "E", "premium-economy", "Business", "f", "steerage").alias("cabin"), pick(3, "RT", "OneWay", "wander").alias("trip"), s(c % 3 + 1).alias("adults"), s(c % 2).alias("children"), F.lit("0").alias("infants_in_seat"), F.lit("0").alias("infants_on_lap"),
        s(c % 4).alias("max_stops"), F.when(k % 2 == 0, "UA, LH").otherwise("").alias("airlines"),
    )
    r = readers.flight_arguments(values)
    people = F.array_join(F.transform("passengers", lambda p: F.concat(p["type"], F.lit(":"), p["count"].cast("string"))), ",")
    return r.select("request_id", "from_airport", "cabin_class", "trip_type", "depart_date", people.alias("passengers"), "max_stops", F.array_join("preferred_airlines", ",").alias("airlines"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_custkey % 4 AS adults, 'EUR' AS currency, CASE o_orderkey % 3 WHEN 0 THEN 'lowest_price' WHEN 1 THEN 'highest_rating' END AS sort_order, CASE WHEN o_orderkey % 2 = 0 THEN '3,5' END AS stars, 'spa,ev_charger' AS amenities, 'SAUNA' AS unknown_amenities,
  CAST(o_custkey % 300 AS INT) AS min_price, CAST(CASE o_orderkey % 3 WHEN 0 THEN 2147483647 WHEN 1 THEN 99 END AS INT) AS max_price, CAST(4 AS INT) AS nights FROM orders""")
def hotel_command_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Command-line values to hotel requests."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = table(spark, folder, "orders").select(
        s(k).alias("request_id"), F.lit("Oslo").alias("location"), F.lit("2026-01-05").alias("checkin"), F.lit("2026-01-09").alias("checkout"), s(c % 4).alias("adults"), F.lit("").alias("children"), F.lit("eur").alias("currency"),
        F.when(k % 3 == 0, "price").when(k % 3 == 1, "rating").otherwise("relevance").alias("sort"), F.lit("4.5").alias("rating"), F.when(k % 2 == 0, "3, 5").otherwise("3,9").alias("stars"), F.lit("spa, ev-charger,sauna").alias("amenities"),
        F.concat(s(c % 300), F.lit(".75")).alias("min_price"), F.when(k % 3 == 0, "1e12").when(k % 3 == 1, "99.99").otherwise("cheap").alias("max_price"),
    )
    r = readers.hotel_arguments(values)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    stars = F.when(F.col("hotel_stars").isNotNull(), join("hotel_stars"))
    return r.select("request_id", "adults", "currency", "sort_order", stars.alias("stars"), join("amenities").alias("amenities"), join("unknown_amenities").alias("unknown_amenities"), "min_price", "max_price", "nights")


@query("""
SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS adults, CAST(sum(CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS children,
  CAST(sum(CASE WHEN l_linenumber % 4 >= 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS infants FROM lineitem GROUP BY l_orderkey""")
def passenger_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A1: sums by kind over the passenger entries of an order."""
    kind = F.get(F.array(*map(F.lit, ("adult", "child", "infant", "infant_in_seat"))), (F.col("l_linenumber") % 4).cast("int"))
    entries = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("type"), F.col("l_quantity").cast("bigint").alias("count"))).alias("p"))
    total = lambda k: requests.passenger_sum(F.col("p"), k)
    return entries.select("l_orderkey", total("adult").alias("adults"), total("child").alias("children"), (total("infant_on_lap") + total("infant_in_seat")).alias("infants"))


# --- pages --------------------------------------------------------------------------------------


def _flight_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A result page for each part: two cards, one without a price between them."""
    k, z = F.col("p_partkey"), F.col("p_size")
    label = F.concat(F.lit('<div class="BbR8Ec"><span class="sSHqwe" aria-label="Layover (1 of 1) is a '), s(z % 5 + 1), F.lit(' hr 30 min layover at Hub in Oslo."></span></div>'))

    def card(airline: Column, price: Column | None, stop: bool) -> Column:
        parts = [F.lit('<li><div class="sSHqwe tPgKwe ogfYpf"><span>'), airline, F.lit('</span></div><span class="mv1WYe"><div>10:30 AM</div><div>6:15 PM</div></span><span class="bOzv6">+1</span><div class="Ak5kof"><div>'), s(z), F.lit(" hr 5 min</div></div>")]
        parts += [label] if stop else []
        parts += [] if price is None else [F.lit('<div class="YMlIz FpEdX"><span>$'), price, F.lit("</span></div>")]
        return F.concat(*parts, F.lit("</li>"))

    html = F.concat(F.lit('<html><body><div jsname="YdtKid"><ul class="Rk10dc">'), card(F.col("p_brand"), F.concat(s(k % 9 + 1), F.lit(","), F.lpad(s(z), 3, "0")), True), card(F.lit("No price"), None, False), card(F.lit("A &amp; B"), F.lit("99"), False), F.lit("</ul></div></body></html>"))
    return table(spark, folder, "part").select(s(k).alias("request_id"), F.lit("SFO").alias("from_airport"), F.lit("JFK").alias("to_airport"), F.lit(200).alias("status"), html.alias("html"))


@query("""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, p_brand, p_size, (p_partkey % 9 + 1) * 1000 + p_size AS price FROM part)
SELECT request_id, 0 AS pos, '241515785600' AS id, p_brand AS airline, '10:30' AS departs, '6:15 +1d' AS arrives, CAST(p_size * 60 + 5 AS INT) AS minutes, CAST(price AS INT) AS price, 'USD' AS currency, 'Oslo:' || ((p_size % 5 + 1) * 60 + 30) AS stops FROM p
UNION ALL SELECT request_id, 1, '241515785601', 'A & B', '10:30', '6:15 +1d', CAST(p_size * 60 + 5 AS INT), 99, 'USD', '' FROM p""")
def flights_from_cards(spark: SparkSession, folder: str) -> DataFrame:
    """X1-X3, X5, P5, V31, W1."""
    rows = extract.extract_flights(_flight_pages(spark, folder))
    seg = render.first_segment(F.col("flights"))
    stops = F.array_join(F.transform("layovers", lambda x: F.concat(x["airport_city"], F.lit(":"), x["duration_minutes"].cast("string"))), ",")
    return rows.select("request_id", "pos", "id", seg["airline"].alias("airline"), seg["departure_time"].alias("departs"), seg["arrival_time"].alias("arrives"), F.col("duration_minutes").alias("minutes"), "price", "currency", stops.alias("stops"))


def _hotel_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A result page for each supplier: a full card, one without a name, a bare one."""
    k = F.col("s_suppkey")
    full = F.concat(
        F.lit('<div class="uaTTDe"><h2 class="BgYkof">'), F.col("s_name"), F.lit('</h2><span class="KFi5wf lA0BZ"> 4.'), s(k % 10), F.lit(' </span><span class="jdzyld">(1,'), F.lpad(s(k % 1000), 3, "0"), F.lit(')</span><span class="qQOQpe">$'), s(k % 300 + 50),
        F.lit('</span><span class="LtjZ2d">Spa</span><span class="LtjZ2d">ok</span><span class="LtjZ2d">Free parking</span><span class="uTUoTb">4.1</span><span class="UqrZme"> '), s(k % 6), F.lit('</span><a href="/travel/hotel/'), s(k), F.lit('">x</a></div>'),
    )
    bare = F.lit('<div class="uaTTDe"><h2 class="BgYkof">Bare</h2><span aria-label="4 out of 5 stars">n/a</span><span class="qQOQpe"></span></div>')
    html = F.concat(F.lit("<html><body>"), full, F.lit('<div class="uaTTDe"><h2 class="BgYkof"></h2><span class="qQOQpe">$1</span></div>'), bare, F.lit("</body></html>"))
    return table(spark, folder, "supplier").select(s(k).alias("request_id"), F.lit(200).alias("status"), html.alias("html"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 0 AS pos, s_name AS name, '$' || (s_suppkey % 300 + 50) AS price, (40 + s_suppkey % 10) / 10.0::DOUBLE AS rating, CAST(1000 + s_suppkey % 1000 AS BIGINT) AS reviews, 'Spa,Free parking' AS amenities, '4.1' AS location_rating, ' ' || (s_suppkey % 6) AS star_class, 'https://www.google.com/travel/hotel/' || s_suppkey AS url FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, 'Bare', '', NULL, NULL, '', NULL, NULL, NULL FROM supplier""")
def hotels_from_cards(spark: SparkSession, folder: str) -> DataFrame:
    """X4, V30, V32, F22-F25."""
    return extract.extract_hotels(_hotel_pages(spark, folder)).withColumn("amenities", F.array_join("amenities", ",")).drop("address")


@query("""SELECT page_id, array_to_string(list_transform(list_filter(u, lambda x, i: list_position(u, x) = i), lambda x: x), ' ') AS links, len(list_filter(u, lambda x, i: list_position(u, x) = i)) AS n
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS u FROM pages)""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """X6, F25, U3."""
    found = extract.links(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.array_join(found, " ").alias("links"), F.size(found).cast("bigint").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages""")
def page_heading(spark: SparkSession, folder: str) -> DataFrame:
    """X6, L3.  Headings are taken as they stand, entities and all."""
    found = extract.headings(F.col("html"), level=1, trim=False)
    return table(spark, folder, "pages").select("page_id", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("heading"))


@query("""
WITH p AS (SELECT page_id, ['Inn ' || (page_id % 5), 'Lodge', 'Inn ' || (page_id % 5), 'More results'] AS h, [CASE WHEN page_id % 3 = 0 THEN 'Lodge' ELSE 'Hut ' || page_id END, '', 'Inn 4'] AS d FROM pages)
SELECT page_id, 'Inn ' || (page_id % 5) || '|Lodge' AS headings, d[1] || '|Inn 4' AS data_names,
  'Inn ' || (page_id % 5) || '|Lodge' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '|' || d[1] END || CASE WHEN page_id % 5 = 4 THEN '' ELSE '|Inn 4' END AS names,
  CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 5 = 4 THEN 1 ELSE 0 END AS BIGINT) AS n_both FROM p""")
def page_names(spark: SparkSession, folder: str) -> DataFrame:
    """Headings and data-names, in order, and how many are in both."""
    k = F.col("page_id")
    inn = F.concat(F.lit("Inn "), s(k % 5))
    names = F.when(k % 3 == 0, "Lodge").otherwise(F.concat(F.lit("Hut "), s(k)))
    html = F.concat(
        F.lit("<h2>"), inn, F.lit("</h2><h2 class='x'> Lodge\n</h2><h2>"), inn, F.lit("</h2><h2>More results</h2><h2><b>inner</b></h2><h2> </h2>"),
        F.lit('<i data-name="'), names, F.lit('"></i><i data-name=""></i><i data-name="Inn 4"></i><i data-name="Inn 4"></i>'),
    )
    stop = ["More results"]
    both = extract.in_both(extract.headings(F.col("h"), 2, stop), extract.data_names(F.col("h")))
    return table(spark, folder, "pages").select("page_id", html.alias("h")).select(
        "page_id", F.array_join(extract.headings(F.col("h"), 2, stop), "|").alias("headings"), F.array_join(extract.data_names(F.col("h")), "|").alias("data_names"), F.array_join(extract.hotel_names(F.col("h"), stop), "|").alias("names"), F.size(both).cast("bigint").alias("n_both")
    )


@query("""
WITH h AS (SELECT page_id, html || CASE page_id % 6 WHEN 0 THEN 'ppConfig' WHEN 1 THEN 'Loading results' WHEN 2 THEN 'pIav2d uaTTDe' WHEN 3 THEN 'jsshadow JMc5Xc' ELSE '' END AS x, page_id % 6 AS k, CASE WHEN page_id % 7 = 0 THEN 503 ELSE 200 END AS status FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'consent' WHEN 1 THEN 'loading' WHEN 2 THEN 'parser_drift' WHEN 3 THEN 'parser_drift' ELSE 'no_cards' END AS flights,
  CASE k WHEN 1 THEN 'loading' WHEN 2 THEN 'other' WHEN 3 THEN 'loading' ELSE 'no_markers' END AS hotels, CASE WHEN k <> 2 AND length(x) > 1000 THEN 'No hotel markers in the page' END AS warning,
  CASE WHEN status = 503 THEN 'HTTP error 503: ' || substr(x, 1, 500) END AS http_error, k = 0 AS consent FROM h""")
def page_class(spark: SparkSession, folder: str) -> DataFrame:
    """V24-V28."""
    k = F.col("page_id") % 6
    x = F.concat("html", F.when(k == 0, "ppConfig").when(k == 1, "Loading results").when(k == 2, "pIav2d uaTTDe").when(k == 3, "jsshadow JMc5Xc").otherwise(""))
    own = table(spark, folder, "pages").select("page_id", x.alias("x"), F.when(F.col("page_id") % 7 == 0, 503).otherwise(200).alias("status"))
    h = F.col("x")
    return own.select("page_id", pages.flight_failure(h).alias("flights"), pages.hotel_failure(h).alias("hotels"), pages.hotel_marker_warning(h).alias("warning"), pages.http_error(F.col("status"), h).alias("http_error"), pages.consent_error(h).isNotNull().alias("consent"))


# --- responses, renderings, searches ------------------------------------------------------------


def _part_requests(parts: DataFrame) -> DataFrame:
    return parts.select(
        s("p_partkey").alias("request_id"), F.lit("SFO").alias("from_airport"), F.lit("JFK").alias("to_airport"), F.lit("2025-07-15").alias("depart_date"), F.lit(None).cast("string").alias("return_date"), F.lit("economy").alias("cabin_class"),
        F.array(F.struct(F.lit("adult").alias("type"), F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(1).cast("bigint").alias("count"))).alias("passengers"), F.lit("one_way").alias("trip_type"), F.lit(None).cast("int").alias("max_stops"), F.lit(None).cast("array<string>").alias("preferred_airlines"),
    )


_URL = "https://www.google.com/travel/flights/search?tfs=GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC&hl=en&curr=USD&tfu=EgQIABABIgA"


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN p_partkey % 5 <> 0 THEN 2::BIGINT END AS total, CASE WHEN p_partkey % 5 <> 0 THEN '{_URL}' END AS url,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand || ':' || ((p_partkey % 9 + 1) * 1000 + p_size) || ':' || (p_size * 60 + 5) || ':Oslo ' || ((p_size % 5 + 1) * 60 + 30) || '|A & B:99:' || (p_size * 60 + 5) || ':' END AS results,
  CASE WHEN p_partkey % 5 = 0 THEN 'Flight search failed: At least one adult is required' END AS error, CAST(NULL AS VARCHAR) AS breach FROM part""")
def search_flights(spark: SparkSession, folder: str) -> DataFrame:
    """E1, Y2, P6, P8, P9, A5, A6, A10, V22, and the schema check."""
    got = search.search_flights(_part_requests(table(spark, folder, "part")), _flight_pages(spark, folder))
    r = F.col("response.search_flights")
    row = lambda x: F.concat(F.array_join(x["airlines"], "+"), F.lit(":"), x["price"].cast("string"), F.lit(":"), x["dur_min"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(x["layover"], lambda y: F.concat(y["city"], F.lit(" "), y["dur_min"].cast("string"))), ","), F.lit("")))
    return got.select("request_id", r["total"].alias("total"), r["query"]["search_url"].alias("url"), F.array_join(F.transform(r["results"], row), "|").alias("results"), "error", F.when(F.col("response").isNotNull(), responses.flight_conformance(F.col("response"))).alias("breach"))


def _supplier_requests(spark: SparkSession, folder: str) -> DataFrame:
    inputs = table(spark, folder, "supplier").select(
        s("s_suppkey").alias("request_id"),
        F.to_json(F.struct(F.lit("Tokyo").alias("location"), F.lit("2026-01-25").alias("checkin_date"), F.lit("2026-01-31").alias("checkout_date"), F.lit(2).alias("adults"), F.array(F.lit("pool"), F.concat(F.lit("x"), s("s_suppkey"))).alias("amenities"))).alias("input"),
    )
    return requests.hotel_requests_from_tool(inputs.withColumn("input", F.from_json("input", schemas.HOTEL_TOOL_INPUT)))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 2::BIGINT AS total, 'Tokyo 2026-01-25 2026-01-31 USD' AS asked, 'Unknown amenity(s): x' || s_suppkey || '. Valid amenities: indoor_pool, outdoor_pool, pool, spa, kid_friendly, air_conditioned, ev_charger.' AS warnings,
  s_name || ':' || (s_suppkey % 300 + 50) || ':' || CASE WHEN s_suppkey % 6 = 0 THEN '-' ELSE CAST(s_suppkey % 6 AS VARCHAR) END || ':Spa+Free parking|Bare:0:-:-' AS results, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS breach FROM supplier""")
def search_hotels(spark: SparkSession, folder: str) -> DataFrame:
    """Y3, S7, P2, P7-P9, V23."""
    got = search.search_hotels(_supplier_requests(spark, folder), _hotel_pages(spark, folder))
    r = F.col("response.search_hotels")
    q = r["query"]
    row = lambda x: F.concat_ws(":", x["name"], x["price"].cast("string"), F.coalesce(x["stars"].cast("string"), F.lit("-")), F.coalesce(F.array_join(x["amenities"], "+"), F.lit("-")))
    return got.select("request_id", r["total"].alias("total"), F.concat_ws(" ", q["loc"], q["in"], q["out"], q["curr"]).alias("asked"), F.array_join(r["warnings"], "|").alias("warnings"), F.array_join(F.transform(r["results"], row), "|").alias("results"), "error", responses.hotel_conformance(F.col("response")).alias("breach"))


@query("""
WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 900 END AS price, o_orderkey % 1000 AS minutes FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS request_id, count(*) AS total, CAST(coalesce(arg_min_null(price, pos), 0) AS INT) AS best_price, CAST(min(price) AS INT) AS min_price, 0::BIGINT AS multi_stop, CAST(count(*) FILTER (minutes > 900) AS BIGINT) AS long_haul, bool_or(price IS NOT NULL) AS any_price FROM p GROUP BY o_custkey""")
def result_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A5, A7, A8, A11, A12, W1."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    pos = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos")
    rows = table(spark, folder, "orders").select(
        s("o_custkey").alias("request_id"), pos, F.when(k % 3 > 0, k % 900).cast("int").alias("price"), (k % 1000).cast("int").alias("duration_minutes"), F.array().cast("array<string>").alias("layovers"),
        F.array(F.struct(F.lit("x").alias("airline"))).alias("flights"),
    )
    return responses.summary(rows).drop("all_airlines")


@query("""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, p_brand, p_size, (p_partkey % 9 + 1) * 1000 + p_size AS price, p_size || 'h 05m' AS dur, '1 stop: ' || (p_size % 5 + 1) || 'h 30m@Oslo' AS stops FROM part),
w AS (SELECT *, greatest(7, strlen(p_brand)) AS aw FROM p)
SELECT request_id, '      1  ' || rpad(p_brand, CAST(aw AS INT), ' ') || '  10:30 → 6:15 +1d  ' || '  ' || rpad(dur, 10, ' ') || '  ' || rpad(stops, 25, ' ') || '   $' || price AS first_line,
  CAST(aw AS INT) AS airline_width, 18 AS times_width, 10 AS duration_width, 25 AS stops_width FROM w""")
def flight_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """S13, A9, L1, F26-F28, V33, P12."""
    rows = extract.extract_flights(_flight_pages(spark, folder))
    shown = render.flight_table(rows, requests.with_flight_token(_part_requests(table(spark, folder, "part"))), with_widths=True)
    line = F.split_part("table", F.lit("\n\n"), F.lit(-1))
    return shown.select("request_id", F.split_part(line, F.lit("\n"), F.lit(1)).alias("first_line"), *[f"{n}_width" for n in render.FLOORS])


def _list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A result page for each part: two containers of three and four cards, with airlines of many
    widths, the last card long and without stops."""
    z = F.col("p_size")
    name = F.rpad(F.col("p_brand"), (z % 40 + 10).cast("int"), F.lit("x"))

    def card(i: int) -> Column:
        hours = F.lit("19 hr") if i == 6 else F.concat(s(z), F.lit(" min"))
        return F.concat(F.lit('<li><div class="sSHqwe tPgKwe ogfYpf"><span>'), name, F.lit(f'</span></div><span class="mv1WYe"><div>{i + 1}:00 AM</div><div>9:15 PM</div></span><div class="Ak5kof"><div>'), hours, F.lit(f'</div></div><div class="YMlIz FpEdX"><span>{"€" if i == 0 else "$"}{900 - i}</span></div></li>'))

    box = lambda *cards: F.concat(F.lit('<div jsname="YdtKid"><ul class="Rk10dc">'), *cards, F.lit("</ul></div>"))
    html = F.concat(F.lit("<html><body>"), box(*map(card, range(3))), F.lit("<p>between</p>"), box(*map(card, range(3, 7))), F.lit("</body></html>"))
    return dealt(table(spark, folder, "part").select("p_partkey", "p_size", "p_brand")).select(s("p_partkey").alias("request_id"), F.lit("SFO").alias("from_airport"), F.lit("JFK").alias("to_airport"), F.lit(200).alias("status"), html.alias("html"))


@query("""
WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, greatest(7, CAST(p_size % 40 + 10 AS INT)) AS aw FROM part),
x AS (SELECT *, aw + 15 + 10 + 25 AS total FROM w)
SELECT request_id, 5::BIGINT AS n_lines, '💰 Best Price:  $900' AS best, '📊 Total Flights: 7' AS total, '🏆 Top 5 Results:' AS top, '5' AS last_rank, false AS warned,
  CAST(CASE WHEN total > 75 THEN greatest(floor(aw * (75.0::DOUBLE / total)), 4) ELSE aw END AS INT) AS airline_width, CAST(CASE WHEN total > 75 THEN greatest(floor(15 * (75.0::DOUBLE / total)), 10) ELSE 15 END AS INT) AS times_width,
  CAST(CASE WHEN total > 75 THEN greatest(floor(10 * (75.0::DOUBLE / total)), 5) ELSE 10 END AS INT) AS duration_width, CAST(CASE WHEN total > 75 THEN greatest(floor(25 * (75.0::DOUBLE / total)), 10) ELSE 25 END AS INT) AS stops_width FROM x""")
def flight_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Seven rows of two containers, five shown, widths shrunk to fit."""
    rows = extract.extract_flights(_list_pages(spark, folder))
    shown = render.flight_table(rows, requests.with_flight_token(_part_requests(dealt(table(spark, folder, "part").select("p_partkey")))), with_widths=True)
    lines = F.split(F.split_part("table", F.lit("\n\n"), F.lit(-1)), "\n")
    find = lambda mark: F.regexp_extract("table", f"({mark}[^\n]*)", 1)
    return shown.select(
        "request_id", F.size(lines).cast("bigint").alias("n_lines"), find("💰").alias("best"), find("📊").alias("total"), find("🏆").alias("top"), F.split_part(F.trim(F.element_at(lines, -1)), F.lit(" "), F.lit(1)).alias("last_rank"),
        F.col("table").contains("⚠️").alias("warned"), *[f"{n}_width" for n in render.FLOORS],
    )


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS request_id, i AS pos, CASE WHEN i = 6 THEN ' ⚠️' ELSE '' END AS warn, 'direct' AS stops, CASE WHEN i = 6 THEN '19h' ELSE p_size || 'm' END AS duration
FROM part, unnest(range(0, 7)) AS t(i)""")
def suspicious_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A direct flight of more than 18 hours is marked."""
    return render.flight_cells(extract.extract_flights(_list_pages(spark, folder))).select("request_id", F.col("pos").cast("bigint").alias("pos"), "warn", "stops", "duration")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 'Found 2 hotel(s)' || chr(10) || '1. ' || s_name || chr(10) || '   ' || (s_suppkey % 6) || chr(10) || '   Price: $' || (s_suppkey % 300 + 50) || chr(10) || '   Rating: 4.' || (s_suppkey % 10) || ' (' || (1000 + s_suppkey % 1000) || ' reviews)'
  || chr(10) || '   Amenities: Spa, Free parking' || chr(10) || '   Location: 4.1' || chr(10) || chr(10) || '2. Bare' || chr(10) || '   Price: ' AS listing FROM supplier""")
def hotel_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """S14, L2."""
    return render.hotel_list(extract.extract_hotels(_hotel_pages(spark, folder)))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 'Found 12 hotel(s)' AS heading, 10::BIGINT AS n_entries, '10. Hotel 9' AS last_entry FROM supplier""")
def hotel_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve hotels, ten shown."""
    card = lambda i: f'<div class="uaTTDe"><h2 class="BgYkof">Hotel {i}</h2><span class="qQOQpe">${i + 50}</span></div>'
    pages_ = table(spark, folder, "supplier").select(s("s_suppkey").alias("request_id"), F.lit("".join(map(card, range(12)))).alias("html"))
    entries = F.split(F.regexp_replace("listing", r"^[^\n]*\n", ""), "\n\n")
    return render.hotel_list(extract.extract_hotels(pages_)).select("request_id", F.split_part("listing", F.lit("\n"), F.lit(1)).alias("heading"), F.size(entries).cast("bigint").alias("n_entries"), F.split_part(F.element_at(entries, -1), F.lit("\n"), F.lit(1)).alias("last_entry"))


def _outcomes(spark: SparkSession, folder: str, good: DataFrame, name: str, bad: str) -> DataFrame:
    """Pages of five kinds by request: cards, ``bad`` ones, a consent wall, an error, none."""
    k = F.col("request_id").cast("long") % 5
    kept = good.where(k < 4)
    return kept.withColumns({"html": F.when(k == 0, F.col("html")).when(k == 1, bad).when(k == 2, "<p>ppConfig</p>").otherwise("<p>busy</p>"), "status": F.when(k == 3, 503).otherwise(200)})


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN p_partkey % 5 = 0 THEN 'Flight search failed: At least one adult is required'
  ELSE (['Flight search failed: No flights parsed from response: loading', 'Flight search failed: Consent wall detected: <p>ppConfig</p>', 'Flight search failed: HTTP error 503: <p>busy</p>', 'Flight search failed: no page was captured'])[CAST(p_partkey % 5 AS INT)] END AS error, CAST(NULL AS VARCHAR) AS response FROM part""")
def flight_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every request comes back, with the reason why it has no flights."""
    pages_ = _outcomes(spark, folder, _flight_pages(spark, folder), "Flight", "<p>Loading results</p>")
    got = search.search_flights(_part_requests(table(spark, folder, "part")), pages_)
    return got.select("request_id", "error", responses.to_json(F.col("response")).alias("response"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS request_id, CASE WHEN s_suppkey % 5 > 0 THEN (['Hotel search failed: No valid hotel results found: other', 'Hotel search failed: Consent wall detected: <p>ppConfig</p>', 'Hotel search failed: HTTP error 503: <p>busy</p>', 'Hotel search failed: no page was captured'])[CAST(s_suppkey % 5 AS INT)] END AS error, CASE WHEN s_suppkey % 5 = 0 THEN 2::BIGINT END AS total FROM supplier""")
def hotel_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A page whose cards all lack a price isn't valid."""
    pages_ = _outcomes(spark, folder, _hotel_pages(spark, folder), "Hotel", '<div class="uaTTDe"><h2 class="BgYkof">Bare</h2><span class="qQOQpe"></span></div>')
    got = search.search_hotels(_supplier_requests(spark, folder), pages_)
    return got.select("request_id", "error", F.col("response.search_hotels.total").alias("total"))


@query("""SELECT o_orderkey, CAST(least(100 * power(2, o_orderkey % 12), 30000) AS BIGINT) AS delay_ms, true AS jitter_in_bounds FROM orders""")
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """R4, R5."""
    delay = admission.retry_delay(F.col("o_orderkey") % 12)
    jitter = admission.retry_jitter(delay, seed=3)
    return table(spark, folder, "orders").select("o_orderkey", delay.alias("delay_ms"), jitter.alias("_j")).select("o_orderkey", "delay_ms", ((F.col("_j") >= 0) & (F.col("_j") <= F.floor(F.col("delay_ms") * 0.5))).alias("jitter_in_bounds"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
b AS (SELECT event_id, user_id, n, t AS last, 1::BIGINT AS tokens, true AS admitted FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, CASE WHEN passed >= 1000000 THEN t ELSE last END, greatest(had - 1, 0), had > 0
  FROM (SELECT e.*, b.last, e.t - b.last AS passed, CASE WHEN e.t - b.last >= 1000000 THEN least(2, b.tokens + (e.t - b.last) * 2 // 1000000) ELSE b.tokens END AS had FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.n = b.n + 1))
SELECT event_id, user_id, admitted, CAST(tokens AS BIGINT) AS tokens FROM b""")
def token_bucket_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A sequential fold for each user."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return admission.replay_bucket(events, 2, key="user_id", at="ts", order=["event_id"]).select("event_id", "user_id", "admitted", "tokens")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: pages to itineraries to the published response, as JSON."""
    got = search.search_flights(_part_requests(table(spark, folder, "part")), _flight_pages(spark, folder))
    return got.select("request_id", responses.to_json(F.col("response")).alias("response"), "error")
