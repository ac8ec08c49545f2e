"""Locations: city, province or state, country and remote scope, from free text, by lookups compiled into the expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provinces, states, cities and countries that are told apart.
PROVINCES = {"ab": "Alberta", "bc": "British Columbia", "mb": "Manitoba", "nb": "New Brunswick", "nl": "Newfoundland and Labrador", "ns": "Nova Scotia", "nt": "Northwest Territories", "nu": "Nunavut", "on": "Ontario", "pe": "Prince Edward Island", "qc": "Quebec", "sk": "Saskatchewan", "yt": "Yukon"}
STATES = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas", "ca": "California", "co": "Colorado", "ct": "Connecticut", "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii", "id": "Idaho", "il": "Illinois",
    "in": "Indiana", "ia": "Iowa", "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine", "md": "Maryland", "ma": "Massachusetts", "mi": "Michigan", "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri", "mt": "Montana",
    "ne": "Nebraska", "nv": "Nevada", "nh": "New Hampshire", "nj": "New Jersey", "nm": "New Mexico", "ny": "New York", "nc": "North Carolina", "nd": "North Dakota", "oh": "Ohio", "ok": "Oklahoma", "or": "Oregon", "pa": "Pennsylvania",
    "ri": "Rhode Island", "sc": "South Carolina", "sd": "South Dakota", "tn": "Tennessee", "tx": "Texas", "ut": "Utah", "vt": "Vermont", "va": "Virginia", "wa": "Washington", "wv": "West Virginia", "wi": "Wisconsin", "wy": "Wyoming", "dc": "District of Columbia",
}
CITIES_CA = "toronto|waterloo|ottawa|montreal|vancouver|calgary|edmonton|winnipeg|halifax|quebec city|markham|mississauga|surrey|burnaby|richmond|kanata|victoria|kelowna|saskatoon".split("|")
CITIES_US = "new york city|new york|san francisco|san jose|san diego|seattle|boston|austin|chicago|los angeles|washington dc|washington|palo alto|mountain view|santa clara|denver|dallas|houston|raleigh|durham|atlanta|pittsburgh|philadelphia|minneapolis|detroit|portland|salt lake city|baltimore|charlotte|st louis|irvine|redmond|menlo park|redwood city|cambridge|bellevue|arlington|reston|cary|mclean|lowell|tewksbury|falls church".split("|")
AMBIGUOUS = ["richmond", "victoria"]
COUNTRIES = {
    "canada": "Canada", "canadian": "Canada", "united states": "United States", "usa": "United States", "uk": "United Kingdom", "australian": "Australia", "new south wales": "Australia", "queensland": "Australia", "czech republic": "Czech Republic",
    **{c.lower(): c for c in "Australia|Austria|Belgium|Brazil|China|Colombia|Czechia|Denmark|Egypt|Finland|France|Germany|Hong Kong|India|Indonesia|Ireland|Israel|Italy|Japan|Malaysia|Mexico|Netherlands|New Zealand|Norway|Pakistan|Philippines|Poland|Portugal|Romania|Singapore|South Africa|South Korea|Spain|Sweden|Switzerland|Taiwan|Thailand|Turkey|United Kingdom|Vietnam|Argentina|Greece".split("|")},
}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _named(text: Column, names: list[str]) -> Column:
    """The first of the names that stands in the text as whole words, longest names first; null if none."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return F.nullif(F.regexp_extract(text, "(?<![a-z])(" + "|".join(ordered) + ")(?![a-z])", 1), F.lit(""))


def parsed(raw: Column) -> Column:
    """struct(city, region, country, remote, scope) of one location; text must have no accents beyond ASCII to match names.

    A named country decides; else a state, a province or a known city does. Cities that other countries have too need a
    country or province beside them. ``CA`` at the end of a Canadian place is the country, not California.
    """
    low = F.regexp_replace(F.lower(raw), r"\.", "")
    parts = F.filter(F.transform(F.split(low, ","), lambda p: F.trim(p)), lambda p: p != "")
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    remote = F.regexp_like(raw, F.lit(r"(?i)\bremote\b"))
    country = _lookup(_named(low, list(COUNTRIES)), COUNTRIES)
    regions_ca = PROVINCES | {v.lower(): v for v in PROVINCES.values()}
    regions_us = STATES | {v.lower(): v for v in STATES.values()}
    hit = lambda table: F.try_element_at(F.filter(F.transform(parts, lambda p: _lookup(p, table)), lambda v: v.isNotNull()), F.lit(1))
    province = hit(regions_ca)
    city_ca, city_us = _named(F.coalesce(first, low), CITIES_CA), _named(F.coalesce(first, low), CITIES_US)
    canadian = (last == "ca") & (province.isNotNull() | city_ca.isNotNull() | (F.size(parts) == 1))
    state = F.when(canadian, None).otherwise(hit(regions_us))
    code = _lookup(F.lower(F.regexp_extract(raw, r"\bUSA?-([A-Z]{2})-", 1)), STATES)
    by_name_ca, by_name_us = _lookup(_named(low, [v.lower() for v in PROVINCES.values()]), {v.lower(): v for v in PROVINCES.values()}), _lookup(_named(low, [v.lower() for v in STATES.values()]), {v.lower(): v for v in STATES.values()})
    sure = ~city_ca.isin(AMBIGUOUS) | province.isNotNull() | (last == "can") | canadian
    found = F.when(code.isNotNull(), "United States").otherwise(
        F.coalesce(country, F.when(state.isNotNull(), "United States"), F.when(province.isNotNull() | (city_ca.isNotNull() & sure) | canadian | (last == "can"), "Canada"), F.when(city_us.isNotNull() | last.isin("us", "usa"), "United States"), F.when(by_name_ca.isNotNull(), "Canada"), F.when(by_name_us.isNotNull(), "United States"))
    )
    region = F.coalesce(code, F.when(found == "Canada", F.coalesce(province, by_name_ca)).when(found == "United States", F.coalesce(state, by_name_us)))
    plain = F.when((F.size(parts) >= 2) & ~F.regexp_like(F.coalesce(first, F.lit("")), F.lit(r"remote|hybrid|canada|united states|^us-[a-z]{2}-|^usa?$")), F.trim(F.split_part(raw, F.lit(","), F.lit(1))))
    city = F.coalesce(F.initcap(F.coalesce(city_ca, city_us)), plain)
    scope = F.when(F.regexp_like(low, F.lit(r"\b(worldwide|global)\b")), "worldwide").when(F.contains(low, F.lit("north america")), "north-america").when(F.regexp_like(low, F.lit(r"\b(canada|canadian)\b")), "canada").when(F.regexp_like(low, F.lit(r"\b(united states|usa?|us only)\b")), "usa").otherwise("unspecified")
    return F.struct(city.alias("city"), region.alias("region"), found.alias("country"), remote.alias("remote"), F.when(remote, scope).alias("scope"))


def allowed(places: Column, remote_status: Column) -> Column:
    """Any place in Canada or the United States, or remote work."""
    return (remote_status == "remote") | F.exists(places, lambda p: p["remote"] | p["country"].isin("Canada", "United States"))


def remote_status(places: Column, context: Column) -> Column:
    """What the text says outright, else hybrid before remote before onsite among the places, else unknown."""
    said = F.lower(F.nullif(F.regexp_extract(F.coalesce(context, F.lit("")), r"(?i)\b(?:position|role|internship|co-op|and) is (?:a |an )?(remote|hybrid|onsite)\b", 1), F.lit("")))
    joined = F.lower(F.array_join(places, " "))
    return F.coalesce(said, F.when(F.contains(joined, F.lit("hybrid")), "hybrid").when(F.contains(joined, F.lit("remote")), "remote").when(F.size(places) > 0, "onsite").otherwise("unknown"))
