"""Readers of landed pages and feeds: structured data, tables in Markdown, page state, feeds in JSON, and the order they are tried in."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fragment_text
from ..operators.nested import nodes
from .selectors import scan

FIELDS = ["title", "company", "location", "url", "posted"]
_LD = re.compile(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>")
_NEXT = re.compile(r"(?is)<script\b[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script\s*>")


def _walk(value: object) -> Iterator[dict]:
    """All objects in a JSON value, outer ones first."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)


def _loaded(text: str) -> object:
    try:
        return json.loads(html.unescape(text) if text.lstrip()[:1] == "&" else text)
    except ValueError:
        return None


def _text(v: object) -> str | None:
    if isinstance(v, dict):
        v = v.get("name") or v.get("addressLocality") or v.get("address")
    if isinstance(v, list):
        v = v[0] if v else None
    return _text(v) if isinstance(v, (dict, list)) else None if v is None else str(v)


def structured(page: str) -> list[dict]:
    """Job postings in JSON-LD, however deep."""
    out = []
    for m in _LD.finditer(page):
        for o in _walk(_loaded(m[1])):
            kinds = o.get("@type")
            if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
                out.append({"title": _text(o.get("title")), "company": _text(o.get("hiringOrganization")), "location": _text(o.get("jobLocation")), "url": _text(o.get("url")), "posted": _text(o.get("datePosted"))})
    return out


def page_state(page: str) -> list[dict]:
    """Objects with a title and a company in a page's serialized state."""
    m = _NEXT.search(page)
    return [{k: _text(o.get(k)) for k in FIELDS} for o in (_walk(_loaded(m[1])) if m else ()) if "title" in o and "company" in o]


def semantic(page: str) -> list[dict]:
    """One posting from the first shown heading of a page whose text is long enough and speaks of a placement and a job."""
    marks = ["h1", ".banner__text__title", "main h2", "main", "article", "body"]
    s = scan(page, marks)
    shown = [e for m in marks[:3] for e in s.found[m] if not re.search(r"\b(?:visibility--hidden|visually-hidden|sr-only)", e.attributes.get("class", "")) and s.text(e)]
    text = s.first_content(marks[3:], 100) or fragment_text(page)
    signals = re.search(r"(?i)\bintern|co-?op|student", text) and re.search(r"(?i)\brole|position|responsibilit|qualification|apply", text)
    return [{"title": s.text(shown[0])}] if shown and len(text) >= 100 and signals else []


READERS: tuple[Callable[[str], list[dict]], ...] = (structured, page_state, semantic)


def postings(pages: DataFrame, readers: tuple[Callable[[str], list[dict]], ...] = READERS) -> DataFrame:
    """(page_id, place, reader, fields): what the first reader that finds anything finds in each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, found = next(((r.__name__, x) for r in readers if (x := r(page or ""))), ("", []))
                rows += [(page_id, i, reader, *[o.get(f) for f in FIELDS]) for i, o in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [[]] * (3 + len(FIELDS))
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * (1 + len(FIELDS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "place", "reader", *FIELDS])

    schema = T.StructType.fromDDL("page_id bigint, place int, reader string, " + ", ".join(f"{f} string" for f in FIELDS))
    # what no reader can read stays in the JVM
    may = F.regexp_like("html", F.lit("(?i)<h[12]|ld\\+json|__NEXT_DATA__"))
    return pages.filter(may).select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, schema)


def _scripts(pages: DataFrame, mark: str) -> DataFrame:
    """(page_id, script, json) of a page's scripts with that mark."""
    inner = F.regexp_extract_all("html", F.lit(rf"(?is)<script\b[^>]*{mark}[^>]*>(.*?)</script\s*>"), F.lit(1))
    rows = pages.filter(F.regexp_like("html", F.lit(f"(?i){mark}"))).select(F.col("page_id").cast("bigint").alias("page_id"), F.posexplode(inner).alias("script", "raw"))
    plain = F.trim(F.regexp_replace("raw", r"^\s*<!--|-->\s*$", ""))
    return rows.select("page_id", "script", F.when(F.startswith(plain, F.lit("&")), F.replace(F.replace(plain, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))).otherwise(plain).alias("json"))


def _named(v: Column, field: str) -> Column:
    """A field's text: its own, or the name or place inside it; of several the first."""
    inside = ["", ".name", ".addressLocality", ".address", ".address.addressLocality", ".address.name"]
    each = [F.try_variant_get(v, F.lit(f"$.{field}{first}{x}"), "string") for x in inside for first in ("", "[0]")]
    return F.coalesce(*[F.when(~F.regexp_like(c, F.lit(r"^[\[{]")), c) for c in each])


def structured_postings(pages: DataFrame) -> DataFrame:
    """(page_id, place, title, company, location, url, posted): job postings in JSON-LD, however deep, without Python; malformed scripts have none."""
    found = nodes(_scripts(pages, r"application/ld\+json"), ["page_id", "script"], "json").filter("kind = 'object'")
    types = F.coalesce(F.try_variant_get("value", "$['@type']", "array<string>"), F.array(F.try_variant_get("value", "$['@type']", "string")))
    v = F.col("value")
    return found.filter(F.array_contains(types, "JobPosting")).select("page_id", F.concat(F.array("script"), "place").alias("place"), _named(v, "title").alias("title"), _named(v, "hiringOrganization").alias("company"), _named(v, "jobLocation").alias("location"), _named(v, "url").alias("url"), _named(v, "datePosted").alias("posted"))


def state_postings(pages: DataFrame) -> DataFrame:
    """(page_id, place, title, company, location, url, posted): objects with a title and a company in a page's serialized state, without Python."""
    found = nodes(_scripts(pages, "id=[\"']__NEXT_DATA__[\"']"), ["page_id", "script"], "json").filter("kind = 'object'")
    v = F.col("value")
    has = lambda f: F.try_variant_get(v, F.lit(f"$.{f}"), "variant").isNotNull()
    return found.filter(has("title") & has("company")).select("page_id", F.concat(F.array("script"), "place").alias("place"), *[_named(v, f).alias(f) for f in FIELDS])


def table_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, company, title, location): rows of Markdown tables ``| company | title | location |`` by SQL functions.

    ``↳`` stands for the company above; header, rule and rows marked closed are left out.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("row", "line")).filter(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(key, "row", cells.alias("c")).filter((F.size("c") >= 3) & ~F.forall("c", lambda c: c.rlike(r"^:?-{3,}:?$")) & (F.lower(F.col("c")[0]) != "company"))
    company = F.last(F.when(F.col("c")[0] != "↳", F.col("c")[0]), ignorenulls=True).over(W.partitionBy(key).orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(key, "row", company.alias("company"), F.col("c")[1].alias("title"), F.col("c")[2].alias("location")).filter(~F.contains("title", F.lit("🔒")))


def filtered_feed(df: DataFrame, places: list[str], years: list[str]) -> DataFrame:
    """Feed rows in any of the places and years; an empty list does not filter."""
    keep = lambda c, values: F.arrays_overlap(F.col(c), F.array(*map(F.lit, values))) if values else F.lit(True)
    return df.filter(keep("places", places) & keep("years", years))
