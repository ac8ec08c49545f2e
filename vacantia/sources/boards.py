"""Readers of applicant systems and boards: their pages, JSON feeds, paged categories, sitemaps and repositories, by SQL functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.classify import says
from .selectors import scan

# Where the systems' pages have what, in the order in which it is tried.
MARKS = {
    "greenhouse": {"title": ["h1.app-title", ".job__title h1", "main h1", "h1"], "location": [".location", ".job__location"], "description": ["#content", ".job__description", ".job-post", "main"], "company": [".company-name", ".job__company"], "posted": [], "logo": ["img[alt*='Logo']", "img[alt*='logo']"]},
    "lever": {"title": [".posting-headline h2", "main h1", "h1"], "location": [".posting-categories .location", ".posting-categories .sort-by-location", ".location"], "description": [".posting-page", ".content", "main"], "company": [".company-name"], "posted": [], "logo": []},
    "workday": {"title": ["[data-automation-id='jobPostingHeader'] h2", "[data-automation-id='jobPostingHeader']", "main h1", "h1"], "location": ["[data-automation-id='locations']", "[data-automation-id='location']"], "description": ["[data-automation-id='jobPostingDescription']", "main", "[role='main']"], "company": ["[data-automation-id='company']", "[data-automation-id='jobPostingCompany']"], "posted": ["[data-automation-id='postedOn']"], "logo": ["header img[alt]", "[data-automation-id='navigation'] img[alt]"]},
    "ashby": {"title": ["[data-testid='job-title']", "main h1", "h1"], "location": ["[data-testid='job-location']", "[class*='location']"], "description": ["[data-testid='job-description']", "main", "article"], "company": ["[data-testid='company-name']", ".company-name"], "posted": [], "logo": ["img[alt*='Logo']", "img[alt*='logo']"]},
}
#: Links that lead to a form, by attribute; links whose text says so come first.
APPLY = ["a[data-automation-id*='apply']", "a[data-testid*='apply']", "a.apply-button", "a[href*='/apply']"]
APPLY_TEXTS = ("Apply Now", "Apply now", "Apply for this job", "Apply for this position")
PLACEMENT = r"\b(?:intern(?:ship)?|co[ -]?op|student)\b"
MIN_DESCRIPTION, MIN_CONTENT = 100, 80


def system_of(url: Column) -> Column:
    """The applicant system whose page a link leads to, null for others."""
    name = urls.host(url)
    return (
        F.when(urls.is_under(name, ["greenhouse.io", "greenhouse.com"]), "greenhouse").when(name.isin("jobs.lever.co", "api.lever.co"), "lever").when(urls.is_under(name, ["myworkdayjobs.com"]), "workday").when(urls.is_under(name, ["ashbyhq.com"]), "ashby")
        .when(urls.is_under(name, ["careers.tiktokusds.com", "jobs.bytedance.com", "joinbytedance.com"]), "bytedance").when(urls.is_under(name, ["oraclecloud.com"]), "oracle")
    )


READ = "page_id bigint, url string, provider string, title string, company string, locations array<string>, description string, posted string, apply string, heading string, lines string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> what the elements of their system hold; pages of systems without elements of their own -> their lines."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), *[pa.string()] * 5]
    common = ["title", "a[href]", "meta[property='og:site_name']", *APPLY]
    for b in batches:
        rows = []
        for page_id, url, page, system in zip(*(c.to_pylist() for c in b.columns), strict=True):
            marks = MARKS.get(system, {})
            s = scan(page or "", [*common, *[x for f in marks.values() for x in f]])
            heading = s.first_text(["title"])
            if not marks:
                rows.append((page_id, url, system, None, None, [], None, None, None, heading, s.lines()))
                continue
            logo = next((re.sub(r"(?i)\s+logo$", "", e.attributes["alt"]).strip() for x in marks["logo"] for e in s.found[x][:1]), "")
            site = next((e.attributes.get("content", "").strip() for e in s.found["meta[property='og:site_name']"]), "") if system == "workday" else ""
            named = s.first_text(marks["company"]) or ""
            at = re.search(r"\sat\s+(.+?)\s*$", heading or "") if system in ("greenhouse", "ashby") else None
            order = (logo, named) if system == "greenhouse" else (named, site, logo)
            company = next((x for x in (*order, at[1] if at else "") if x), None)
            labels = [(s.text(e), e.attributes["href"]) for e in s.found["a[href]"]]
            apply_ = next((h for t in APPLY_TEXTS for label, h in labels if t in label and h), None) or next((e.attributes["href"] for x in APPLY for e in s.found[x] if e.attributes.get("href")), None)
            apply_ = apply_ or next((h for label, h in labels if re.search(r"(?i)\bapply\b", label) and h), None)
            rows.append((page_id, url, system, s.first_text(marks["title"]), company, s.texts(marks["location"]), s.first_content(marks["description"], MIN_CONTENT), s.first_text(marks["posted"]), apply_, heading, None))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _between(lines: Column, start: str, end: str) -> Column:
    """What stands between the first line ``start`` and the next line ``end``, or the end of the page."""
    return F.trim(F.regexp_extract(lines, rf"(?is)\n{start}\n(.*?)(?:\n(?:{end})(?:\n|\z)|\z)", 1))


def _line_after(lines: Column, label: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(lines, rf"(?i)\n{label}\n([^\n]+)", 1)), F.lit(""))


def _some_lines(part: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(part, "\n"), F.trim), lambda x: x != ""))


def _or_none(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _bytedance(df: DataFrame) -> DataFrame:
    """Postings read by lines; between what and what they stand are fixed values."""
    df = df.withColumn("lines", F.concat(F.lit("\n"), "lines", F.lit("\n")))
    lines, none = F.col("lines"), F.lit(None).cast("string")
    second = F.contains("url", F.lit("careers.tiktokusds.com"))
    before = _or_none(F.regexp_extract(lines, r"(?i)\n([^\n]+)\nLocation:\n", 1))
    place = F.coalesce(_line_after(lines, "Location:"), _or_none(F.regexp_extract(lines, r"\n([A-Za-z][A-Za-z .'-]{1,80})(?:Intern|Regular)(?:R&D|Product|Operations|Corporate|Design)", 1)))
    about = _between(lines, "Responsibilities", "About Us|About USDS|Apply to this job|Company\nAbout")
    pay = _or_none(F.regexp_replace(F.regexp_extract(lines, r"(?i)(?:hourly rate range|base salary range)[^$]{0,100}(\$[\d,.]+\s*(?:-|–|to)\s*\$?[\d,.]+[^\n.]*)", 1), r"[.\s]+$", ""))
    return df.select(
        "page_id", "url", "provider", F.coalesce(before, _or_none(F.when(second, F.regexp_replace("heading", r"(?i)\s+-\s+TikTok$", "")).otherwise(F.col("heading")))).alias("title"),
        F.when(second, "TikTok USDS Joint Venture").otherwise("ByteDance").alias("company"), F.array_compact(F.array(place)).alias("locations"), about.alias("description"), none.alias("posted"), none.alias("apply"),
        F.coalesce(_line_after(lines, "Job Code:"), _or_none(F.regexp_extract(lines, r"(?i)Job ID:\s*([A-Z0-9]+)", 1))).alias("job_id"), none.alias("deadline"), pay.alias("salary"),
    )


def _oracle(df: DataFrame) -> DataFrame:
    """Postings read by lines; between what and what they stand are fixed values."""
    df = df.withColumn("lines", F.concat(F.lit("\n"), "lines", F.lit("\n")))
    lines, none = F.col("lines"), F.lit(None).cast("string")
    header = _some_lines(_between(lines, "View More Jobs", "APPLY NOW|JOB INFORMATION|JOB DESCRIPTION"))
    df = df.select("*", header.alias("header"), _between(lines, "Locations", "Apply Before|Job Schedule|Base Pay/Salary|JOB DESCRIPTION").alias("listed"))
    titled = F.filter("header", lambda x: ~F.regexp_like(x, F.lit(r"(?i)^(?:trending|[A-Z][a-z]+(?:, [A-Z]{2})?, .+)$")))
    title = F.coalesce(F.get(titled, 0), _or_none(F.regexp_replace("heading", r"(?i)\s+-\s+.+ Careers(?: loaded)?$", "")))
    df = df.withColumn("title", title)
    where = F.filter(_some_lines(F.col("listed")), lambda x: ~F.regexp_like(x, F.lit(r"(?i):$|\b(?:locations? you may join|job information)\b")))
    shown = F.filter("header", lambda x: (x != F.col("title")) & (F.lower(x) != "trending"))
    site = F.when(F.startswith("heading", F.concat("title", F.lit(" - "))), F.expr("substr(heading, length(title) + 4)"))
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(site, r"(?i)\s+Careers(?: loaded)?$", ""), r"(?i)\s+Candidate Experience page$", ""), r"(?i)^JPMC$", "JPMorganChase")
    about = _between(lines, "JOB DESCRIPTION", "ABOUT US|APPLY NOW|JOB INFO")
    pay = F.coalesce(_or_none(_between(lines, "Base Pay/Salary", "JOB DESCRIPTION")), _or_none(F.regexp_extract(about, r"(?i)(?:expected pay range|hourly range)[^$]{0,100}(\$[\d,.]+\s*(?:-|–|to)\s*\$?[\d,.]+\s*/\s*hour(?:ly)?)", 1)))
    return df.select(
        "page_id", "url", "provider", "title", _or_none(site).alias("company"), F.when(F.size(where) > 0, where).otherwise(F.slice(shown, 1, 1)).alias("locations"), about.alias("description"),
        _line_after(lines, "Posting Date").alias("posted"), none.alias("apply"), _line_after(lines, "Job Identification").alias("job_id"), _line_after(lines, "Apply Before").alias("deadline"), pay.alias("salary"),
    )


def ats_postings(pages: DataFrame) -> DataFrame:
    """(page_id, provider, title, company, locations, description, job_id, posted, deadline, salary, application_url) of pages (``page_id``, ``url``, ``html``) of applicant systems that
    hold a placement: a title and a description of ``MIN_DESCRIPTION`` characters that speak of one.

    Pages of no system are left aside before anything is read; the others are read in one pass each.
    """
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", system_of(F.col("url")).alias("provider")).filter("provider is not null")
    read = lambda of: known.filter(F.col("provider").isin(*of)).mapInArrow(_read, READ)
    none = F.lit(None).cast("string")
    columns = ["page_id", "url", "provider", "title", "company", "locations", "description", "posted", "apply"]
    df = read(MARKS).select(*columns, none.alias("job_id"), none.alias("deadline"), none.alias("salary"))
    df = df.unionByName(_bytedance(read(["bytedance"]))).unionByName(_oracle(read(["oracle"])))
    df = df.filter((F.length("title") > 0) & (F.length("description") >= MIN_DESCRIPTION) & says(F.concat_ws("\n", "title", "description"), PLACEMENT))
    link = F.when(F.regexp_like("apply", F.lit("(?i)^https?://")), F.col("apply")).when(F.startswith("apply", F.lit("/")), F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), "apply"))
    plain = F.regexp_replace("url", "/$", "")
    form = F.when(F.col("provider") == "lever", F.concat(plain, F.lit("/apply"))).when(F.col("provider") == "ashby", F.concat(plain, F.lit("/application"))).otherwise(F.col("url"))
    return df.select(
        "page_id", "provider", "title", F.coalesce("company", urls.company_of(F.col("url"))).alias("company"), "locations", "description", F.coalesce("job_id", urls.job_id(F.col("url"))).alias("job_id"), "posted", "deadline", "salary", F.coalesce(link, form).alias("application_url"),
    )


#: Shapes of the systems' feeds.
FEEDS = {
    "greenhouse": "struct<jobs:array<struct<id:bigint,title:string,content:string,absolute_url:string,location:struct<name:string>,updated_at:string>>>",
    "lever": "array<struct<id:string,text:string,descriptionPlain:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,allLocations:array<string>>,createdAt:bigint>>",
    "ashby": "struct<jobs:array<struct<id:string,title:string,descriptionPlain:string,jobUrl:string,applyUrl:string,location:string,secondaryLocations:array<struct<location:string>>,publishedAt:string>>>",
}


def feed_jobs(feeds: DataFrame) -> DataFrame:
    """(source, provider, job_id, title, locations, url, posted) of feeds (``source``, ``provider``, ``body``); a malformed body has none."""
    some = lambda *cs: F.array_distinct(F.filter(F.concat(*cs), lambda x: x.isNotNull() & (x != "")))
    full = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    make = {
        "greenhouse": lambda j: F.struct(j["id"].cast("string").alias("job_id"), j["title"].alias("title"), some(F.array(j["location"]["name"])).alias("locations"), j["absolute_url"].alias("url"), j["updated_at"].alias("posted")),
        "lever": lambda j: F.struct(j["id"].alias("job_id"), j["text"].alias("title"), some(F.array(j["categories"]["location"]), full(j["categories"]["allLocations"])).alias("locations"), F.coalesce(j["applyUrl"], j["hostedUrl"]).alias("url"), j["createdAt"].cast("string").alias("posted")),
        "ashby": lambda j: F.struct(j["id"].alias("job_id"), j["title"].alias("title"), some(F.array(j["location"]), full(F.transform(j["secondaryLocations"], lambda x: x["location"]))).alias("locations"), F.coalesce(j["applyUrl"], j["jobUrl"]).alias("url"), j["publishedAt"].alias("posted")),
    }
    jobs = None
    for system, shape in FEEDS.items():
        read = F.from_json("body", shape)
        made = F.transform(read if shape.startswith("array") else read["jobs"], make[system])
        jobs = F.when(F.col("provider") == system, made) if jobs is None else jobs.when(F.col("provider") == system, made)
    return feeds.select("source", "provider", F.explode(jobs).alias("j")).select("source", "provider", "j.job_id", "j.title", "j.locations", "j.url", "j.posted")


def paged_rows(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, row) of a category's pages (``key``, ``page`` from 1, ``rows``) up to the first that is missing or empty."""
    by = W.partitionBy(key).orderBy("page")
    numbered = pages.select(key, "page", "rows", F.when((F.col("page") != F.row_number().over(by)) | (F.coalesce(F.size("rows"), F.lit(0)) <= 0), 1).otherwise(0).alias("gap"))
    open_ = numbered.select(key, "page", "rows", F.max("gap").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("ended")).filter("ended = 0")
    return open_.select(key, "page", F.explode("rows").alias("row"))


def sitemap(xml: Column) -> Column:
    """(url, changed) of a sitemap's entries, as an array."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    return F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"), F.nullif(F.regexp_extract(e, r"<lastmod>\s*([^<\s]+)\s*</lastmod>", 1), F.lit("")).alias("changed")))


def board_links(pages: DataFrame, most_pages: int, most_links: int) -> DataFrame:
    """(site, url) of a board's list pages (``site``, ``page``, ``html``): the first ``most_pages`` of a site, the first ``most_links`` links of each that lead to a posting.

    The bounds are the reader's, so that a board without an end is left.
    """
    first = pages.filter(F.col("page") <= most_pages)
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref=[\"']?([^\"'\s>]+)"), F.lit(1)))
    posting = F.filter(links, lambda u: F.regexp_like(u, F.lit(r"(?i)/(?:jobs?|positions?)/[^/?#]+")))
    return first.select("site", F.explode(F.slice(posting, 1, most_links)).alias("url")).distinct()


def repository_files(files: DataFrame, most_folders: int = 8) -> DataFrame:
    """(repository, path, text) of the Markdown files (``repository``, ``path``, ``content``, ``raw``) of the root and of at most ``most_folders`` folders by name; the
    content of the listing, else the raw file."""
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    own = files.filter(F.lower("path").endswith(".md")).select("repository", "path", F.coalesce(F.nullif("content", F.lit("")), F.col("raw")).alias("text"), folder.alias("folder")).filter("text is not null")
    kept = own.filter("folder <> ''").select("repository", "folder").distinct().withColumn("n", F.row_number().over(W.partitionBy("repository").orderBy("folder"))).filter(F.col("n") <= most_folders).select("repository", "folder")
    inside = own.join(kept, ["repository", "folder"], "left_semi")
    return own.filter("folder = ''").unionByName(inside.select(own.columns)).select("repository", "path", "text")


def cached(has: Column, age_ms: Column, ttl_ms: int, etag_same: Column, status: Column, circuit_open: Column) -> Column:
    """What a request to a cached page gives: hit within the time to live; stale behind an open circuit or after a transient failure; revalidated by 304 or an equal
    validator; stored anew; failed where there is nothing to fall back on."""
    transient = status.isNull() | status.isin(408, 425, 429, 500, 502, 503, 504)
    return (
        F.when(has & (age_ms <= ttl_ms), "hit").when(circuit_open, F.when(has, "stale").otherwise("failed")).when(transient, F.when(has, "stale").otherwise("failed"))
        .when(has & ((status == 304) | (etag_same & (status == 200))), "revalidated").when((status >= 200) & (status < 300), "stored").otherwise("failed")
    )
