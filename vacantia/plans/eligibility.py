"""Nine criteria of eligibility, each a state with the side that does not know (posting, profile or null)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITERIA = ["term", "location", "work_authorization", "sponsorship", "degree", "graduation", "year_of_study", "current_enrollment", "returning_to_school"]


@dataclass(frozen=True)
class Profile:
    """What is known of a user; None and ``unsure`` are unknown."""

    terms: tuple[str, ...] = ("summer:2027", "fall:2027")
    countries: tuple[str, ...] = ("Canada", "United States")
    remote: bool = True
    authorized: tuple[tuple[str, str], ...] = (("Canada", "authorized"), ("United States", "needs_assistance"))
    sponsor: tuple[tuple[str, str], ...] = (("Canada", "no"), ("United States", "now"))
    degree: str | None = "bachelors"
    graduation: int | None = 2028
    or_later: bool = False
    study_year: str = "third-year"
    enrolled: str = "enrolled"
    returning: str = "yes"


def _state(state: Column, source: Column | None = None) -> Column:
    return F.struct(state.alias("state"), (F.lit(None).cast("string") if source is None else source).alias("source"))


def _made(*rules: tuple[Column, str, str | None], otherwise: str) -> Column:
    """The first rule that holds gives (state, source); nulls do not hold."""
    state, source = F.lit(otherwise), F.lit(None).cast("string")
    for test, name, who in reversed(rules):
        ok = F.coalesce(test, F.lit(False))
        state, source = F.when(ok, F.lit(name)).otherwise(state), F.when(ok, F.lit(who).cast("string")).otherwise(source)
    return _state(state, source)


def term(p: Profile, term_season: Column, title_season: Column, years: Column) -> Column:
    """``years``: the distinct year signals. Disagreeing signals conflict; a part that fits is unknown."""
    if not p.terms:
        return _state(F.lit("unknown"), F.lit("profile"))
    seasons, wished = sorted({t.split(":")[0] for t in p.terms}), sorted({int(t.split(":")[1]) for t in p.terms})
    season, year = F.coalesce(term_season, title_season), F.try_element_at(years, F.lit(1))
    none = season.isNull() & year.isNull()
    off = ~F.coalesce(F.concat_ws(":", season, year.cast("string")).isin(*p.terms), F.lit(False)) & season.isNotNull() & year.isNotNull()
    part = (season.isNotNull() & ~season.isin(*seasons)) | (year.isNotNull() & ~year.isin(*wished))
    return _made(((term_season != title_season) | (F.size(years) > 1), "conflict", None), (none, "unknown", "posting"), (off | part, "fail", None), (season.isNull() | year.isNull(), "unknown", "posting"), otherwise="pass")


def location(p: Profile, places: Column, remote_status: Column) -> Column:
    """One matching place passes at once; remote work of unknown scope and unmapped places are unknown; known others fail."""
    country = lambda x: F.coalesce(x["country"], F.when(x["scope"] == "canada", "Canada").when(x["scope"] == "usa", "United States"))
    fits = F.exists(places, lambda x: F.coalesce(country(x).isin(*p.countries), F.lit(False)))
    broad = F.exists(places, lambda x: x["remote"] & country(x).isNull()) | ((remote_status == "remote") & (F.size(places) == 0))
    unmapped = F.exists(places, lambda x: country(x).isNull())
    return _made((fits, "pass", None), (broad | unmapped | (F.size(places) == 0), "unknown", "posting"), otherwise="fail")


def _by_country(answers: tuple[tuple[str, str], ...], countries: Column) -> Column:
    table = F.create_map(*[F.lit(x) for a in answers for x in a])
    return F.transform(countries, lambda c: F.try_element_at(table, c))


def authorization(p: Profile, need: Column, countries: Column) -> Column:
    """Authorized in any of the role's countries passes; needing assistance in all of them fails."""
    own = _by_country(p.authorized, countries)
    return _made(
        (need == "unknown", "unknown", "posting"), (need != "required", "not_applicable", None), (F.size(countries) == 0, "unknown", "posting"), (F.exists(own, lambda a: a == "authorized"), "pass", None),
        (F.forall(own, lambda a: F.coalesce(a == "needs_assistance", F.lit(False))), "fail", None), otherwise="unknown",
    )


def sponsorship(p: Profile, offer: Column, countries: Column) -> Column:
    """Where none is offered: not needing it in any of the countries passes, needing it in all of them fails."""
    own = _by_country(p.sponsor, countries)
    return _made(
        (offer == "conflict", "conflict", None), (offer == "unknown", "unknown", "posting"), (offer == "available", "pass", None), (F.size(countries) == 0, "unknown", "posting"), (F.exists(own, lambda a: a == "no"), "pass", None),
        (F.forall(own, lambda a: F.coalesce(a.isin("now", "future"), F.lit(False))), "fail", None), otherwise="unknown",
    )


def degree(p: Profile, levels: Column) -> Column:
    mine = F.lit(p.degree).cast("string")
    return _made((F.size(levels) == 0, "unknown", "posting"), (mine.isNull(), "unknown", "profile"), (F.array_contains(levels, mine), "pass", None), otherwise="fail")


def graduation(p: Profile, years: Column, low: Column, high: Column) -> Column:
    """A range decides before listed years; ``or later`` needs only that the window does not end before the year."""
    year = F.lit(p.graduation).cast("int")
    last = F.coalesce(high, F.array_max(years))
    fits = (last >= year) if p.or_later else F.when(low.isNotNull(), year.between(low, high)).otherwise(F.array_contains(years, year))
    return _made((low.isNull() & (F.size(years) == 0), "unknown", "posting"), (year.isNull(), "unknown", "profile"), (fits, "pass", None), otherwise="fail")


def study_year(p: Profile, years: Column, upper: Column, first_ok: Column) -> Column:
    """``upper`` and ``first_ok`` are yes, no or unknown."""
    hard = (upper == "yes") | (first_ok == "no")
    exact = (F.size(years) > 0) & (upper != "no") & (first_ok != "yes")
    first, known = p.study_year == "first-year", p.study_year not in ("unsure", "other")
    fits = F.array_contains(years, p.study_year) | (F.array_contains(years, "upper-year") & F.lit(not first))
    return _made(
        (~hard & ~exact & (first_ok == "yes"), "pass", None), (~hard & ~exact, "unknown", "posting"), (F.lit(not known), "unknown", "profile"), (hard & F.lit(first), "fail", None), (~hard & ~fits, "fail", None), otherwise="pass",
    )


def _required(need: Column, answer: str, yes: str) -> Column:
    return _made(
        (need == "conflict", "conflict", None), (need == "unknown", "unknown", "posting"), (need != "required", "not_applicable", None), (F.lit(answer == "unsure"), "unknown", "profile"), (F.lit(answer == yes), "pass", None), otherwise="fail",
    )


def enrollment(p: Profile, student: Column, enrolled: Column) -> Column:
    """The stronger of both requirements counts."""
    need = F.when((student == "conflict") | (enrolled == "conflict"), "conflict").when((student == "required") | (enrolled == "required"), "required").when((student == "unknown") & (enrolled == "unknown"), "unknown").otherwise("preferred")
    return _required(need, p.enrolled, "enrolled")


def returning(p: Profile, need: Column) -> Column:
    return _required(need, p.returning, "yes")


def status(criteria: Column) -> Column:
    """A failure excludes, a conflict is unclear; without unknowns eligible; likely if only the posting does not know."""
    has = lambda s: F.exists(criteria, lambda c: c["state"] == s)
    mine = F.exists(criteria, lambda c: (c["state"] == "unknown") & (F.coalesce(c["source"], F.lit("")) != "posting"))
    return F.when(has("fail"), "not_eligible").when(has("conflict"), "unclear").when(~has("unknown"), "eligible").when(mine, "unclear").otherwise("likely_eligible")
