"""Every threshold, code list, date and time zone the operators use."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

# Names of the purchase labels.
CHALLENGER = "Challenger"
ALBUM_COLLECTOR = "Album Collector"
POCA_COLLECTOR = "Poca Collector"
COLLECTOR = "Collector"
SHOPPER = "Shopper"
BEGINNER = "Beginner"
NOT_CLASSIFIED = "N/A"

# Product event code -> offer type.
OFFER_TYPES = {0: "F_FUNDING", 1: "P_POB", 2: "S_SHOPPING"}
EVENT_OFFERS = ("F_FUNDING", "P_POB")
SHOP_OFFER = "S_SHOPPING"

# SKU kinds. A parent SKU carries the number of random versions.
PARENT_SKU = "P"
CHILD_SKU = "C"

NO_WINNER_ID = "-1"

# Groups of users that tables can leave out.
INTERNAL = "internal"
AGENTS = "agents"


@dataclass(frozen=True)
class Rules:
    """One run's settings. `as_of` and `run_ts` stand in for the current date and time."""

    as_of: date
    run_ts: datetime
    tz: str = "Asia/Seoul"

    # Which mart orders count.
    score_markets: tuple[str, ...] = ("B2C", "B2B")
    retail_markets: tuple[str, ...] = ("B2C",)
    order_source: str | None = None  # value of data_source; None takes every source

    # When a raw order line counts as paid.
    paid_payments: tuple[str, ...] = ("CONFIRMED", "PARTIAL_CANCELED")
    paid_statuses: tuple[int, ...] = (1, 10, 11)
    kept_statuses: tuple[int, ...] = (1, 2, 4, 5, 6, 10, 11)
    business_prefix: str = "B"
    # Type the line amount is read as. "double" takes any number; an integer or decimal type
    # makes sums independent of the order in which partitions arrive.
    price_type: str = "double"

    # Users who buy on behalf of others.
    agent_min_codes: int = 3
    agent_min_artists: int = 2
    agent_since: date = date(2025, 1, 1)

    # Which users are left out of the scores, of the purchase labels, and of the purchases in the
    # customer table: those on the internal list, those found to buy for others, both or none.
    score_exclusions: tuple[str, ...] = (INTERNAL, AGENTS)
    label_exclusions: tuple[str, ...] = (INTERNAL, AGENTS)
    customer_exclusions: tuple[str, ...] = (INTERNAL, AGENTS)

    # Whether a lookup table with several rows for a key is an error. Else the least row counts.
    fail_on_repeated_keys: bool = False

    # Scores.
    tiles: int = 5

    # Purchase labels.
    challenger_ratio: float = 1.5
    price_tiers: tuple[tuple[float, float], ...] = ((200_000, 0.2), (50_000, 0.3))
    lowest_tier_threshold: float = 0.5
    bulk_ticket_qty: int = 10
    album_min_artists: int = 3
    album_max_qty: int = 5

    # Older rule sets.
    v2_album_qty_below: int = 3
    v1_challenger_ratio: float = 1.0

    # Label of users without one, in the segment table and in the customer table.
    default_label: str | None = BEGINNER
    customer_default_label: str | None = BEGINNER
