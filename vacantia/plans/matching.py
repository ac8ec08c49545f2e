"""Matching of listings with one user's preferences: criteria, eligibility, score and rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relations import numbered


@dataclass(frozen=True)
class Preferences:
    """What a user looks for; one row, so it is compiled into the expressions."""

    terms: tuple[str, ...] = ("summer:2027", "fall:2027")
    countries: tuple[str, ...] = ("AMERICA",)
    cities: tuple[str, ...] = ("AMERICA:NATION_1",)
    remote: bool = True
    categories: tuple[str, ...] = ("machinery", "building")
    technologies: tuple[str, ...] = ("python", "sql", "pytorch")
    needs_sponsor: bool = True


def criterion(known: Column, fits: Column, conflict: Column | None = None) -> Column:
    """pass, fail, unknown or conflict."""
    out = F.when(conflict, "conflict") if conflict is not None else F.when(F.lit(False), "conflict")
    return out.when(~known, "unknown").when(fits, "pass").otherwise("fail")


def eligibility(states: Column, posting: Column) -> Column:
    """Any failure excludes; then a conflict is unclear; without unknowns it is eligible; else it is likely for postings of their
    own and unclear for others."""
    has = lambda v: F.array_contains(states, v)
    return F.when(has("fail"), "not_eligible").when(has("conflict"), "unclear").when(~has("unknown"), "eligible").when(posting, "likely_eligible").otherwise("unclear")


def term_points(p: Preferences, season: Column, year: Column) -> Column:
    """30 for a wished term, 14 for a season or year alone that fits, else 0."""
    seasons, years = [t.split(":")[0] for t in p.terms], [t.split(":")[1] for t in p.terms]
    both = season.isNotNull() & year.isNotNull()
    exact = F.concat_ws(":", season, year).isin(*p.terms)
    return F.when(both, F.when(exact, 30).otherwise(0)).when(season.isin(*seasons) | year.isin(*years), 14).otherwise(0)


def place_points(p: Preferences, country: Column, city: Column, remote: Column) -> Column:
    """30 for a preferred city, 24 for remote work if wished, 20 for the country."""
    best = F.greatest(F.when(F.concat_ws(":", country, city).isin(*p.cities), 30).otherwise(0), F.when(country.isin(*p.countries), 20).otherwise(0))
    return F.greatest(best, F.when(remote == "remote", 24).otherwise(0)) if p.remote else best


def soft_points(p: Preferences, category: Column, technologies: Column, relevance: Column, lifecycle: Column) -> Column:
    """Categories 12 each up to 36, technologies 5 each up to 25, a tenth of the relevance, 4 or 2 if new or updated."""
    tech = F.size(F.array_intersect(F.transform(technologies, F.lower), F.array(*map(F.lit, p.technologies))))
    fresh = F.when(lifecycle == "NEW", 4).when(lifecycle == "UPDATED", 2).otherwise(0)
    return F.when(category.isin(*p.categories), 12).otherwise(0) + F.least(F.lit(25), tech * 5) + F.floor(relevance / 10 + 0.5).cast("int") + fresh


def total(status: Column, points: Column) -> Column:
    return F.when(status == "not_eligible", 0).otherwise(F.least(F.lit(100), points))


def verdict(status: Column, overlap: Column, uncertain: Column) -> Column:
    return F.when(status == "not_eligible", "excluded").when(~overlap, "insufficient_fit").when(uncertain, "recommended_with_uncertainty").otherwise("recommended")


#: Words that tell nothing of a job.
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was"]


def keywords(text: Column) -> Column:
    """The distinct words of three or more signs of a short text, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9+#.]{3,})"), F.lit(1))), F.array(*map(F.lit, STOP_WORDS)))


def ranked(items: DataFrame, key: str, corpus: DataFrame, skills: dict[str, list[str]]) -> DataFrame:
    """``items`` (``key``, ``words``) with their score against a corpus (``word``, distinct) and their place: one point for a shared
    word, five for each skill of which any alias stands in the text; ties by key.

    Words meet the corpus in an equi-join, counted per item before they are ranked. Places are dealt by ranges of the order.
    """
    shared = items.select(key, F.explode("words").alias("word")).join(corpus, "word").groupBy(key).agg(F.count("*").alias("shared"))
    bonus = F.lit(0)
    for aliases in skills.values():
        bonus = bonus + F.when(F.arrays_overlap("words", F.array(*map(F.lit, aliases))), 5).otherwise(0)
    scored = items.join(shared, key, "left").select(key, (F.coalesce("shared", F.lit(0)) + bonus).cast("bigint").alias("score"))
    return numbered(scored, [F.desc("score"), F.col(key)], "place")
