"""Extraction, page checks, responses, renderings, searches, streams and the tool server."""

import http.client
import json
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripquarry import schemas, serve
from tripquarry.functions import text
from tripquarry.operators import dom, extract, pages, render, responses
from tripquarry.operators.dom import parse_html
from tripquarry.plans import catalogue, registry, search
from tripquarry.sources import readers, writers
from tripquarry.streaming import pages as stream

CARD = (
    '<li><div class="sSHqwe tPgKwe ogfYpf"><span>Air A</span></div><span class="mv1WYe"><div>10:30 AM</div><div>6:15 PM</div></span>'
    '<span class="bOzv6">+1</span><div class="Ak5kof"><div>14 hr 5 min</div></div>'
    '<div class="BbR8Ec"><span class="sSHqwe" aria-label="1 hr 30 min layover in Oslo. 2 hr layover in Tel-Aviv."></span></div><div class="YMlIz FpEdX">$1,234</div></li>'
)
PAGE = f'<div jsname="YdtKid"><ul class="Rk10dc">{CARD}<li>nothing</li>{CARD.replace("$1,234", "n/a").replace("+1", "")}</ul></div>'
HOTELS = (
    '<div class="uaTTDe"><h2 class="BgYkof">Inn &amp; Out</h2><span class="KFi5wf lA0BZ"> 4.3 </span><span class="jdzyld">(1,234)</span><span class="qQOQpe">$99</span>'
    '<span class="LtjZ2d">Spa</span><span class="LtjZ2d">ab</span><span class="UqrZme"> 4 </span><a href="/travel/x">x</a></div>'
    '<div class="uaTTDe"><h2 class="BgYkof">No price</h2></div><div class="uaTTDe"><h2 class="BgYkof"></h2><span class="qQOQpe">$1</span></div>'
)


def test_dom_optional_ends_and_selectors():
    root = parse_html("<ul><li class='a b'>1<li>2<p>x<p>y</ul><div><span data-x='q'>z<br>w</span></div>")
    assert [e.text() for e in root.select("ul li")] == ["1", "2xy"]
    assert [e.text() for e in root.select("li p")] == ["x", "y"]
    assert root.first(".a.b").text() == "1" and root.first('[data-x*="q"]').text() == "zw"
    assert root.first("div li") is None
    with pytest.raises(ValueError):
        root.first("a > b")


_PIECES = st.sampled_from(
    ["<div>", "</div>", '<div class="a b" id="x">', '<p class="a" class="b">', "<p>", "</p>", "<ul>", "<li>", "</li>", "</ul>", "<br>", "<br/>", "<BR>", "<td>", "<tr>", "<table>", "</table>", "<option>", "</span >", "<span a=1>", "<a href='x'>", '<a href="x&amp;y">', '<a href="x>y">', "text", " a < b ", "&amp;", "&am", "x & y", "&#8364;", "&lt;p&gt;", "<!-- <p> -->", "<!DOCTYPE html>", "<script>", "</script>", "<style>", "</style>", "<title>", "</title>", "<", ">", '"', "€\n", "<?x?>", "</p a=\"1\">", "<x", "</"]
)


@given(st.lists(_PIECES, max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_plain_markup_gives_the_tree_of_the_standard_tokenizer(html):
    def told(e):
        return (e.tag, e.attrs, e.classes, [told(c) if isinstance(c, dom.Element) else c for c in e.children])

    whole = dom._Builder()
    whole.feed(html)
    whole.close()
    assert told(parse_html(html)) == told(whole.root)


def test_plain_pages_need_no_standard_tokenizer():
    for html in (PAGE, HOTELS):
        assert dom._Builder().read_plain(html) == len(html)
    assert dom._Builder().read_plain("<p>a</p><!-- x --><p>") == len("<p>a</p>")


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id p_partkey", "int(id) p_size", "'b' p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages_ = catalogue._list_pages(spark, str(tmp_path))
    assert pages_.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pages_.select("request_id").distinct().count() == 40
    assert catalogue.suspicious_rows(spark, str(tmp_path)).count() == 280


def test_ranking_broadcasts_no_requests(spark, tmp_path):
    spark.range(40).selectExpr("id p_partkey", "int(id) p_size", "'b' p_brand").write.parquet(str(tmp_path / "part.parquet"))
    ranked = catalogue.flight_ranking(spark, str(tmp_path))
    assert "Broadcast" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 40


def test_flight_extraction(spark):
    rows = [("1", PAGE, "SFO", "JFK"), ("2", "", "SFO", "JFK"), ("3", None, "SFO", "JFK"), ("4", PAGE.replace("</ul>", CARD.replace("$1,234", "") + "</ul>").replace('<div class="YMlIz FpEdX"></div>', ""), "A", "B")]
    got = extract.extract_flights(spark.createDataFrame(rows, "request_id string, html string, from_airport string, to_airport string")).orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["pos"], r["price"]) for r in got] == [("1", 0, 1234), ("1", 1, None), ("4", 0, 1234), ("4", 1, None)]
    seg = got[0]["flights"][0]
    assert (seg["departure_time"], seg["arrival_time"], seg["arrival_plus_days"], got[0]["duration_minutes"]) == ("10:30", "6:15 +1d", 1, 845)
    assert [(s["airport_city"], s["duration_minutes"]) for s in got[0]["layovers"]] == [("Oslo", 90), ("Tel-Aviv", 120)]
    assert got[1]["flights"][0]["arrival_time"] == "6:15"


def test_nested_containers_repeat_rows():
    assert len(extract.flight_cards(f'<div jsname="YdtKid">{PAGE}</div>')) == 4


def test_hotel_extraction(spark):
    r = extract.extract_hotels(spark.createDataFrame([("1", HOTELS)], "request_id string, html string")).collect()
    assert len(r) == 1
    assert (r[0]["name"], r[0]["rating"], r[0]["reviews"], r[0]["amenities"], r[0]["url"]) == ("Inn & Out", 4.3, 1234, ["Spa"], "https://www.google.com/travel/x")


@pytest.mark.parametrize(
    ("html", "flights", "hotels"),
    [("ppConfig", "consent", "no_markers"), ("Loading results", "loading", "loading"), ("jsshadow pIav2d", "parser_drift", "loading"), ("", "no_cards", "no_markers"), ("BgYkof", "no_cards", "other"), (None, "no_cards", "no_markers")],
)
def test_failure_classes(spark, html, flights, hotels):
    r = spark.createDataFrame([(html,)], "h string").select(pages.flight_failure(F.col("h")).alias("f"), pages.hotel_failure(F.col("h")).alias("t")).first()
    assert (r["f"], r["t"]) == (flights, hotels)


def wanted(spark):
    people = [{"type": "adult", "count": 1}]
    rows = [(i, "SFO", "JFK", "2025-07-15", None, "economy", people if i != "bad" else [], "one_way", None, None) for i in ("ok", "bad", "none", "wall", "gone", "empty")]
    return spark.createDataFrame(rows, schemas.FLIGHT_REQUEST)


def captured(spark):
    rows = [("ok", "u", 200, PAGE), ("bad", "u", 200, PAGE), ("wall", "u", 200, "ppConfig"), ("gone", "u", 404, "x"), ("empty", "u", 200, "<html>")]
    return spark.createDataFrame(rows, schemas.PAGE)


def test_search_flights_keeps_every_request(spark):
    got = {r["request_id"]: r for r in search.search_flights(wanted(spark), captured(spark)).collect()}
    assert got["bad"]["error"].endswith("At least one adult is required") and got["none"]["error"].endswith("no page was captured")
    assert "Consent wall" in got["wall"]["error"] and "HTTP error 404" in got["gone"]["error"] and got["empty"]["error"].endswith("No flights parsed from response: no_cards")
    frame = search.search_flights(wanted(spark), captured(spark)).where("request_id = 'ok'")
    body = json.loads(frame.select(responses.to_json(F.col("response")).alias("j")).first()["j"])["search_flights"]
    assert set(body) == {"total", "query", "results"} and body["total"] == 2
    assert body["results"][0] == {"price": 1234, "airlines": ["Air A"], "dur_min": 845, "layover": [{"city": "Oslo", "dur_min": 90}, {"city": "Tel-Aviv", "dur_min": 120}]}
    assert frame.select(responses.flight_conformance(F.col("response")).alias("b")).first()["b"] is None
    late = search.search_flights(wanted(spark), captured(spark), today=F.to_date(F.lit("2026-01-01"))).where("request_id = 'ok'").first()
    assert late["response"] is None and "in the past" in late["error"]


def test_render(spark):
    rows = extract.extract_flights(captured(spark).where("request_id = 'ok'").withColumns({"from_airport": F.lit("SFO"), "to_airport": F.lit("JFK")}))
    asked = wanted(spark).withColumn("search_url", F.lit("https://x"))
    table = render.flight_table(rows, asked).first()["table"]
    assert "💰 Best Price:  $1234" in table and "Top 2 Results" in table and "2 stops: 1h 30m@Oslo, 2h@Tel-Aviv" in table
    narrow = render.column_widths(render.flight_cells(rows), 80).first()
    assert narrow["stops_width"] < 36 and narrow["airline_width"] >= 4
    listing = render.hotel_list(extract.extract_hotels(spark.createDataFrame([("1", HOTELS)], "request_id string, html string"))).first()["listing"]
    assert listing == "Found 1 hotel(s)\n1. Inn & Out\n   4\n   Price: $99\n   Rating: 4.3 (1234 reviews)\n   Amenities: Spa"


def test_files_streams_and_sql_names(spark, tmp_path):
    pages_dir = str(tmp_path / "pages")
    hotel_pages = spark.createDataFrame([("h", "u", 200, HOTELS)], schemas.PAGE)
    writers.write_pages(hotel_pages, pages_dir)
    assert readers.read_pages(spark, pages_dir).count() == 1
    q = stream.write_stream(stream.hotel_stream(stream.page_stream(spark, pages_dir)), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["name"] == "Inn & Out"
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "one.html").write_text("<html>\nx</html>")
    assert readers.read_html_files(spark, str(tmp_path / "html")).first()["request_id"] == "one"
    names = registry.register(spark)
    assert "tfs_decode" in names
    hotel_pages.createOrReplaceTempView("p")
    assert spark.sql("SELECT t.name FROM p, LATERAL hotels_from_html(html) t").first()["name"] == "Inn & Out"
    assert spark.sql("SELECT tfs_decode('GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC').params.to_airport AS t").first()["t"] == "JFK"


def test_tool_server(spark):
    call = lambda m, p=None: serve.answer(spark, captured(spark), {"jsonrpc": "2.0", "id": 1, "method": m, "params": p})
    assert call("initialize")["result"]["protocolVersion"] == "2025-03-26"
    assert {t["name"] for t in call("tools/list")["result"]["tools"]} == {"search_flights", "search_hotels"}
    got = call("tools/call", {"name": "search_flights", "arguments": {"request_id": "ok", "from": "SFO", "to": "JFK", "date": "2025-07-15", "adults": 1, "trip_type": "one_way"}})["result"]
    assert not got["isError"] and json.loads(got["content"][0]["text"])["search_flights"]["total"] == 2
    assert call("tools/call", {"name": "x"})["error"]["code"] == -32602 and call("x")["error"]["code"] == -32601
    assert serve.answer(spark, None, {"method": "x"}) is None


def test_tool_server_inputs_and_errors(spark):
    tools = serve.answer(spark, None, {"id": 1, "method": "tools/list"})["result"]["tools"]
    flights = next(t for t in tools if t["name"] == "search_flights")["inputSchema"]
    assert flights["required"] == ["from", "to", "date", "adults"] and flights["properties"]["adults"]["type"] == "integer" and flights["properties"]["children_ages"]["items"]["type"] == "integer"
    assert all(p["description"] for t in tools for p in t["inputSchema"]["properties"].values())
    # A broken source of pages fails the call, not the server.
    call = {"id": 7, "method": "tools/call", "params": {"name": "search_flights", "arguments": {"from": "SFO"}}}
    assert serve.answer(spark, None, call)["error"]["code"] == -32603
    assert serve.answer(spark, None, {"id": 1, "method": "tools/call", "params": {"name": "search_flights", "arguments": [1]}})["error"]["code"] == -32602
    assert serve.answer(spark, None, [1])["error"]["code"] == serve.answer(spark, None, {"id": 1, "method": "x", "params": 3})["error"]["code"] == -32600
    assert serve.reply(spark, None, "{")["error"]["code"] == -32700


def test_tool_server_over_http(spark):
    server = serve.http_server(spark, captured(spark), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(body, path=serve.PATH):
        at = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=120)
        at.request("POST", path, body)
        got = at.getresponse()
        return got.status, got.read()

    try:
        status, body = post(json.dumps({"jsonrpc": "2.0", "id": 3, "method": "initialize"}))
        assert status == 200 and json.loads(body)["id"] == 3
        arguments = {"request_id": "ok", "from": "SFO", "to": "JFK", "date": "2025-07-15", "adults": 1, "trip_type": "one_way"}
        status, body = post(json.dumps({"id": 4, "method": "tools/call", "params": {"name": "search_flights", "arguments": arguments}}))
        assert json.loads(json.loads(body)["result"]["content"][0]["text"])["search_flights"]["total"] == 2
        assert post(json.dumps({"method": "notifications/initialized"})) == (202, b"") and post("{}", "/x")[0] == 404
        assert json.loads(post("{")[1])["error"]["code"] == -32700
    finally:
        server.shutdown()
        server.server_close()


def test_sql_functions_equal_the_columns(spark):
    registry.register(spark)
    label = "Layover (1 of 1) is a 2 hr 5 min layover at Hub in Oslo."
    got = spark.sql(f"SELECT parse_duration('11 hr 5 min') AS d, parse_duration(NULL) AS n, layovers(array('{label}', NULL)) AS l").first()
    want = spark.range(1).select(text.layovers(F.array(F.lit(label))).alias("l")).first()
    assert got["d"] == 665 and got["n"] is None and got["l"] == want["l"]
    flight = "named_struct('from_airport','SFO','to_airport','JFK','depart_date','2025-7-15','cabin_class','economy','passengers',array(named_struct('type','adult','count',1L)),'trip_type','one_way')"
    assert spark.sql(f"SELECT tfs_encode({flight}) AS t").first()["t"] == "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC"
    hotel = "named_struct('adults',0L,'checkin_date','2026-01-25','checkout_date','2026-01-31','currency','EUR')"
    assert spark.sql(f"SELECT ts_decode(ts_encode({hotel})).params.currency AS c").first()["c"] == "EUR"


def test_published_schema():
    flights = schemas.json_schema(schemas.FLIGHT_RESPONSE)
    body = flights["properties"]["search_flights"]
    assert flights["required"] == ["search_flights"] and body["required"] == ["total", "query", "results"] and body["additionalProperties"] is False
    row = body["properties"]["results"]["items"]
    assert row["required"] == ["price", "airlines", "dur_min"] and row["properties"]["price"] == {"type": "integer", "minimum": 0}
    hotel = schemas.json_schema(schemas.HOTEL_RESPONSE)["properties"]["search_hotels"]["properties"]["results"]["items"]
    assert hotel["required"] == ["name", "price", "rating"] and hotel["properties"]["stars"] == {"type": "integer"}


def test_token_sources_and_config(spark):
    from tripquarry import ClientConfig

    got = readers.flight_requests_from_tokens(spark.createDataFrame([("a", "GhoSCjIwMjUtMDctMTVqBRIDU0ZPcgUSA0pGS0IBAUgBmAEC"), ("b", "?")], "request_id string, tfs string")).orderBy("request_id").collect()
    assert (got[0]["to_airport"], got[0]["decode_error"], got[1]["to_airport"]) == ("JFK", None, None) and got[1]["decode_error"]
    hotel = readers.hotel_requests_from_tokens(spark.createDataFrame([("a", "CAEaIAoCGgASGhIUCgcI6g8QARgZEgcI6g8QARgfGAYyAggBKgkKBToDRVVSGgA")], "request_id string, ts string")).first()
    assert (hotel["currency"], hotel["nights"]) == ("EUR", 6)
    assert ClientConfig().queue(clock=lambda: 0.0).qps == 2
