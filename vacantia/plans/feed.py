"""The feed query: parameters checked and turned into one plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import relations as rel

# What the parameters may be.
TABS = ["main", "canada", "summer", "internship", "quant", "non-intern"]
STATUSES = ["open", "closed", "new", "updated", "all"]
SORTS = ["relevance", "posted", "season", "recent", "last-seen", "company"]
MODES = ["onsite", "hybrid", "remote"]


@dataclass(frozen=True)
class FeedQuery:
    """Checked parameters of a feed page."""

    tab: str = "canada"
    status: str = "open"
    sort: str = "posted"
    category: str | None = None
    mode: str | None = None
    seasons: tuple[str, ...] = field(default=())
    location: str = ""
    search: str = ""
    limit: int = 8
    offset: int = 0

    @classmethod
    def parse(cls, given: dict[str, str]) -> FeedQuery:
        """From raw parameters; blank ones take their defaults, bad ones raise ``ValueError`` with their name."""

        def one_of(name: str, default: str, allowed: list[str]) -> str:
            value = given.get(name, "").strip() or default
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
            return value

        def number(name: str, default: int, low: int, high: int) -> int:
            raw = given.get(name, "").strip()
            if raw and not re.fullmatch(r"\d+", raw):
                raise ValueError(f"{name} must be a non-negative integer")
            value = int(raw) if raw else default
            if not low <= value <= high:
                raise ValueError(f"{name} is out of range")
            return value

        def text(*names: str) -> str:
            value = next((given[n] for n in names if n in given), "").strip().lower()
            if len(value) > 200:
                raise ValueError(f"{names[-1]} is too long")
            return "" if value == "all" else value

        seasons = tuple(s for s in text("season").split(",") if s)
        if bad := [s for s in seasons if s not in [*dates.SEASONS, "unknown"]]:
            raise ValueError(f"season must not be {bad[0]}")
        category, mode = given.get("category", "").strip(), one_of("workMode", "all", ["all", *MODES])
        return cls(
            one_of("tab", cls.tab, TABS), one_of("status", cls.status, STATUSES), one_of("sort", cls.sort, SORTS), None if category in ("", "all") else category, None if mode == "all" else mode, seasons,
            text("location"), text("q", "search"), number("limit", cls.limit, 1, 100), number("offset", cls.offset, 0, 5_000_000),
        )


def _status(q: FeedQuery) -> Column:
    is_open, life = F.col("availability") == "open", F.col("lifecycle")
    return {"all": F.lit(True), "closed": F.col("availability") == "closed", "open": is_open, "new": is_open & (life == "NEW"), "updated": is_open & (life == "UPDATED")}[q.status]


def order(q: FeedQuery) -> list[Column]:
    """Sort keys, with the id last so that pages do not overlap."""
    tail = [F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")]
    season = dates.season_rank(dates.seasons(F.coalesce("term", F.lit(""))))
    return {
        "relevance": tail, "company": [F.col("company"), F.col("id")], "recent": [F.col("first_seen").desc_nulls_last(), *tail], "last-seen": [F.col("last_seen").desc_nulls_last(), *tail],
        "posted": [F.col("posted_at").cast("date").desc_nulls_last(), F.col("posted_at").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), *tail],
        "season": [season.isNull(), season, F.when(season.isNotNull(), F.col("year")).asc_nulls_last(), *tail],
    }[q.sort]


def rows(listings: DataFrame, q: FeedQuery) -> DataFrame:
    """Listings that pass the query's filters: one conjunction, so that all of it can move to the scan."""
    keep = _status(q)
    if q.category:
        keep = keep & (F.col("category") == q.category)
    if q.mode:
        keep = keep & (F.col("remote") == q.mode)
    if q.location:
        keep = keep & F.contains(F.lower("location"), F.lit(q.location))
    if q.search:
        keep = keep & F.contains(F.lower(F.concat_ws(" ", "title", "company", "location", "description")), F.lit(q.search))
    if q.seasons:
        found = dates.seasons(F.coalesce("term", F.lit("")))
        keep = keep & (F.arrays_overlap(found, F.array(*map(F.lit, q.seasons))) | (F.lit("unknown" in q.seasons) & (F.size(found) == 0)))
    return listings.filter(keep)


def page(listings: DataFrame, q: FeedQuery) -> DataFrame:
    return rel.page(rows(listings, q), order(q), q.offset, q.limit)
