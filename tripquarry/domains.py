"""The closed enum domains: names, wire codes and accepted spellings.

A domain turns into column expressions: lookups are literal maps, so no join is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """``codes``: canonical name to wire code; ``names``: accepted spelling to canonical name."""

    codes: dict[str, int]
    names: dict[str, str] = field(default_factory=dict)
    fold: bool = False  # are spellings compared without case
    default: str | None = None

    def known(self, extra: dict[str, str] | None = None) -> dict[str, str]:
        """Every accepted spelling with its canonical name."""
        return {n: n for n in self.codes if n not in ("unknown", "unspecified")} | self.names | (extra or {})

    def _map(self, pairs: dict) -> Column:
        return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])

    def canonical(self, name: Column, extra: dict[str, str] | None = None) -> Column:
        """The canonical name of a spelling, null if there is none."""
        return F.try_element_at(self._map(self.known(extra)), F.lower(name) if self.fold else name)

    def code(self, canonical: Column) -> Column:
        return F.try_element_at(self._map(self.codes), canonical)

    def name(self, code: Column) -> Column:
        return F.try_element_at(self._map({c: n for n, c in self.codes.items()}), code.cast("int"))

    def wire_name(self, canonical: Column) -> Column:
        """The upper-case name, as enums are spelled in message definitions."""
        return F.when(self.code(canonical).isNotNull(), F.upper(canonical))

    def from_wire_name(self, name: Column) -> Column:
        return F.try_element_at(self._map({n.upper(): n for n in self.codes}), name)


# Names, wire codes and accepted spellings of the service's enums.
SEAT = Domain(
    {"unknown": 0, "economy": 1, "premium_economy": 2, "business": 3, "first": 4},
    {"premium": "premium_economy"},
    default="economy",
)
SEAT_JSON = {"Economy": "economy", "PremiumEconomy": "premium_economy", "Business": "business", "First": "first"}
SEAT_CLI = Domain(SEAT.codes, {"premium": "premium_economy", "premium-economy": "premium_economy", "e": "economy", "pe": "premium_economy", "b": "business", "f": "first"}, fold=True)

TRIP = Domain(
    {"unknown": 0, "round_trip": 1, "one_way": 2, "multi_city": 3},
    {"roundtrip": "round_trip", "round": "round_trip", "oneway": "one_way", "multicity": "multi_city", "multi": "multi_city"},
    default="round_trip",
)
TRIP_JSON = {"round-trip": "round_trip", "one-way": "one_way"}
TRIP_CLI = {"roundtrip": "round_trip", "round": "round_trip", "rt": "round_trip", "oneway": "one_way", "one": "one_way", "ow": "one_way"}

PASSENGER = Domain({"unknown": 0, "adult": 1, "child": 2, "infant_in_seat": 3, "infant_on_lap": 4}, {"infant": "infant_on_lap"})
GUEST = Domain({"unspecified": 0, "child": 2, "adult": 3})
SORT = Domain(
    {"relevance": 0, "lowest_price": 3, "highest_rating": 8, "most_reviewed": 13},
    {"lowest": "lowest_price", "price": "lowest_price", "highest": "highest_rating", "rating": "highest_rating", "reviewed": "most_reviewed", "reviews": "most_reviewed"},
)
AMENITY = Domain(
    {"unspecified": 0, "indoor_pool": 4, "outdoor_pool": 5, "pool": 6, "spa": 10, "kid_friendly": 12, "air_conditioned": 40, "ev_charger": 61},
    {
        "indoor": "indoor_pool", "indoorpool": "indoor_pool", "outdoor": "outdoor_pool", "outdoorpool": "outdoor_pool", "kid": "kid_friendly",
        "kidfriendly": "kid_friendly", "ac": "air_conditioned", "airconditioned": "air_conditioned", "ev": "ev_charger", "evcharger": "ev_charger",
    },
    fold=True,
)
AMENITY_NAMES = ["indoor_pool", "outdoor_pool", "pool", "spa", "kid_friendly", "air_conditioned", "ev_charger"]

DOMAINS = {"seat": SEAT, "trip": TRIP, "passenger": PASSENGER, "guest": GUEST, "sort": SORT, "amenity": AMENITY}


def sort_order(name: Column) -> Column:
    """A sort spelling to its order; relevance is no order at all."""
    found = SORT.canonical(name)
    return F.when(found != "relevance", found)
