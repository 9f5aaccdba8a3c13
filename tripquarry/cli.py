"""Command lines: ``python -m tripquarry.cli flights|hotels ...`` over captured pages."""

from __future__ import annotations

import argparse
import logging
import shutil
import sys

from pyspark.sql import functions as F

from .operators import extract, render, requests
from .plans.search import search_flights, search_hotels
from .session import build_session
from .sources import readers, writers

log = logging.getLogger("tripquarry")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tripquarry")
    kinds = top.add_subparsers(dest="kind", required=True)
    f = kinds.add_parser("flights")
    f.add_argument("-f", "--from", dest="origin", required=True)
    f.add_argument("-t", "--to", required=True)
    f.add_argument("-d", "--date", required=True)
    f.add_argument("-r", "--return-date")
    f.add_argument("-c", "--cabin", default="economy")
    f.add_argument("-p", "--adults", type=int, default=1)
    for n in ("children", "infants-in-seat", "infants-on-lap"):
        f.add_argument(f"--{n}", type=int, default=0)
    f.add_argument("--trip", default="roundtrip")
    f.add_argument("--max-stops", type=int)
    f.add_argument("--preferred-airlines", default="")
    f.add_argument("--save-html")
    h = kinds.add_parser("hotels")
    for n in ("location", "checkin", "checkout"):
        h.add_argument(f"--{n}", required=True)
    h.add_argument("--adults", type=int, default=2)
    for n in ("children", "amenities", "stars"):
        h.add_argument(f"--{n}", default="")
    for n in ("rating", "min-price", "max-price"):
        h.add_argument(f"--{n}", type=float)
    h.add_argument("--currency", default="USD")
    h.add_argument("--sort", default="relevance")
    h.add_argument("--limit", type=int, default=render.TOP_HOTELS)
    for p in (f, h):
        p.add_argument("--pages", help="captured pages: Parquet with request_id, url, status, html")
        p.add_argument("--request-id", default="request")
        p.add_argument("--today", help="reject dates before this one")
        p.add_argument("--dry-run", action="store_true")
        p.add_argument("--json", action="store_true")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    a = parser().parse_args(argv)
    spark = spark or build_session("tripquarry-cli")
    text = lambda x: None if x is None else str(x)
    if a.kind == "flights":
        row = {"request_id": a.request_id, "from": a.origin, "to": a.to, "date": a.date, "return_date": a.return_date, "cabin": a.cabin, "adults": text(a.adults), "children": text(a.children), "infants_in_seat": text(a.infants_in_seat), "infants_on_lap": text(a.infants_on_lap), "trip": a.trip, "max_stops": text(a.max_stops), "airlines": a.preferred_airlines}
        wanted, coder, search = readers.flight_arguments, requests.with_flight_token, search_flights
    else:
        row = {"request_id": a.request_id, "location": a.location, "checkin": a.checkin, "checkout": a.checkout, "adults": text(a.adults), "children": a.children, "rating": text(a.rating), "amenities": a.amenities, "stars": a.stars, "min_price": text(a.min_price), "max_price": text(a.max_price), "currency": a.currency, "sort": a.sort}
        wanted, coder, search = readers.hotel_arguments, requests.with_hotel_token, search_hotels
    frame = wanted(spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` string" for n in row)))
    coded = coder(frame)
    if a.dry_run or not a.pages:
        got = writers.dry_run(coded).first()
        print(got["validation_error"] or got["search_url"])
        return int(got["validation_error"] is not None)
    pages = readers.read_pages(spark, a.pages).where(F.col("request_id") == a.request_id)
    if a.kind == "flights" and a.save_html:
        writers.write_html(pages.join(coded, "request_id"), a.save_html, "overwrite")
    result = search(frame, pages, today=None if a.today is None else F.to_date(F.lit(a.today))).select(F.to_json("response").alias("json"), "error").first()
    if result["error"]:
        print(result["error"], file=sys.stderr)
        return 1
    if a.json:
        print(result["json"])
    elif a.kind == "flights":
        rows = extract.extract_flights(pages.join(coded.select("request_id", "from_airport", "to_airport"), "request_id"))
        print(render.flight_table(rows, coded, terminal=shutil.get_terminal_size((100, 24)).columns).first()["table"])
    else:
        print(render.hotel_list(extract.extract_hotels(pages), limit=a.limit).first()["listing"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
