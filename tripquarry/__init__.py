"""Travel-search requests, tokens and captured result pages as Spark DataFrames."""

from . import domains, schemas
from .config import ClientConfig
from .functions import text, tokens
from .operators import admission, extract, pages, render, requests, responses
from .plans.search import search_flights, search_hotels
from .session import build_session

__all__ = [
    "ClientConfig",
    "admission",
    "build_session",
    "domains",
    "extract",
    "pages",
    "render",
    "requests",
    "responses",
    "schemas",
    "search_flights",
    "search_hotels",
    "text",
    "tokens",
]
