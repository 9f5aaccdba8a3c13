"""A tool server: JSON-RPC messages, one a line over standard input and output, or one a POST over
HTTP.

``python -m tripquarry.serve PAGES [--http HOST:PORT]`` answers ``initialize``, ``tools/list`` and
``tools/call`` for searches over captured pages, whose request id is the argument ``request_id``.
Whatever goes wrong with a message becomes its answer's error; the server goes on.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import requests
from .plans.registry import TOOLS, input_schema
from .plans.search import search_flights, search_hotels
from .session import build_session
from .sources import readers

# Fixed value: the protocol revision that is spoken.
PROTOCOL = "2025-03-26"
PATH = "/mcp"
LOG = logging.getLogger("tripquarry.serve")
MOST_BYTES = 1 << 20  # of a message
OUTPUTS = {"search_flights": schemas.FLIGHT_RESPONSE, "search_hotels": schemas.HOTEL_RESPONSE}


def call_tool(spark: SparkSession, pages, name: str, arguments: dict) -> dict:
    known = {"search_flights": (readers.parse_flight_inputs, requests.flight_requests_from_tool, search_flights), "search_hotels": (readers.parse_hotel_inputs, requests.hotel_requests_from_tool, search_hotels)}
    if name not in known:
        raise KeyError(name)
    parse, build, search = known[name]
    one = parse(spark.createDataFrame([(str(arguments.get("request_id", "request")), json.dumps(arguments))], "request_id string, input string"))
    got = search(build(one), pages.where(F.col("request_id") == str(arguments.get("request_id", "request")))).select(F.to_json("response").alias("json"), "error").first()
    return {"content": [{"type": "text", "text": got["error"] or got["json"]}], "isError": got["error"] is not None}


def _error(message, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": code, "message": text}}


def answer(spark: SparkSession, pages, message: dict) -> dict | None:
    if not isinstance(message, dict) or not isinstance(message.get("params") or {}, dict):
        return _error(message, -32600, "not a request")
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None  # a notification
    try:
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tripquarry", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": input_schema(n), "outputSchema": schemas.json_schema(OUTPUTS[n])} for n, d in TOOLS.items()]}
        elif method == "tools/call":
            if params.get("name") not in TOOLS:
                return _error(message, -32602, f"unknown tool: {params.get('name')}")
            arguments = params.get("arguments") or {}
            if not isinstance(arguments, dict):
                return _error(message, -32602, "arguments must be an object")
            result = call_tool(spark, pages, params["name"], arguments)
        else:
            return _error(message, -32601, f"unknown method: {method}")
    except Exception as e:
        LOG.exception("%s failed", method)
        return _error(message, -32603, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def reply(spark: SparkSession, pages, text: str | bytes) -> dict | None:
    """The answer to one message as text."""
    try:
        message = json.loads(text)
    except ValueError:
        return _error(None, -32700, "not JSON")
    return answer(spark, pages, message)


def http_server(spark: SparkSession, pages, host: str, port: int) -> ThreadingHTTPServer:
    """A server whose ``serve_forever`` answers POSTs to ``PATH``; a notification gets 202."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            size = self.headers.get("Content-Length", "")
            if self.path != PATH:
                self._send(404, None)
            elif not size.isdigit() or int(size) > MOST_BYTES:
                self._send(413, None)
            else:
                out = reply(spark, pages, self.rfile.read(int(size)))
                self._send(202 if out is None else 200, out)

        def log_message(self, format: str, *args) -> None:
            LOG.info("%s " + format, self.address_string(), *args)

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tripquarry.serve")
    top.add_argument("pages", help="captured pages: Parquet with request_id, url, status, html")
    top.add_argument("--http", metavar="HOST:PORT", help="answer over HTTP instead of standard input and output")
    top.add_argument("--log-level", default="INFO")
    a = top.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=a.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = build_session("tripquarry-serve")
    pages = readers.read_pages(spark, a.pages)
    if a.http:
        host, _, port = a.http.rpartition(":")
        with http_server(spark, pages, host or "127.0.0.1", int(port)) as server:
            LOG.info("listening on %s", a.http)
            server.serve_forever()
    for line in sys.stdin:
        out = reply(spark, pages, line)
        if out is not None:
            print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
