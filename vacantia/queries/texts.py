"""Text, link, date and classification functions over listings, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import classify as k
from ..functions import dates, sponsorship, text, urls
from ..functions import requirements as req
from ..operators import nested
from ..plans import matching as match
from ..sources.tables import listing, load, spread
from ..sources.tables import sql_views as V
from .registry import query

NOW_MS = 996667200000  # NOW in milliseconds


def docs(s, d):
    return load(s, d, "documents").select("doc_id", "text")


def pages(s, d):
    return load(s, d, "pages").select("page_id", "url")


def _sql_says(c: str, pattern: str) -> str:
    """The rule for an engine without look-ahead: a word boundary follows where Java's has it."""
    return f"regexp_matches({c}, '(?i){pattern.replace('(?!script)', '')}')"


# ---- text

_LINE = r"trim(regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '\n+', ' ', 'g'))"


@query("SELECT doc_id, md5(" + _LINE.format(c="text") + ") AS one_line FROM documents")
def c1_one_line(s, d):
    return docs(s, d).select("doc_id", F.md5(text.one_line(F.col("text"))).alias("one_line"))


@query(r"""SELECT p_partkey AS id, p_name || ' & "x" ' || chr(233) || ' &unknown;' AS decoded FROM part""")
def c2_decode_entities(s, d):
    raw = F.concat("p_name", F.lit(" &amp; &quot;x&QUOT; &#233; &unknown;"))
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), text.decode_entities(raw).alias("decoded"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def c3_strip_diacritics(s, d):
    return docs(s, d).select("doc_id", F.md5(text.without_diacritics(F.col("text"))).alias("plain"))


@query("SELECT p_partkey AS id, p_name AS item FROM part")
def c4_list_item(s, d):
    raw = F.concat(F.element_at(F.array(F.lit("• "), F.lit("- "), F.lit("12) "), F.lit("3.  "), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name", F.lit("  "))
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), text.list_item(raw).alias("item"))


@query(V("listing") + r"SELECT id, CASE WHEN description = '' THEN 0 ELSE CAST(len(string_split(regexp_replace(description, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS INT) END AS n FROM listing")
def c5_sentences(s, d):
    return listing(s, d).select("id", F.size(text.sentences(F.col("description"))).alias("n"))


@query(V("listing") + r"SELECT id, trim(regexp_replace(regexp_replace(lower(title), '\b(internship|intern|co-?op|student)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM listing")
def c6_identity_normalize(s, d):
    return listing(s, d).select("id", text.identity_ascii(F.col("title")).alias("key"))


@query(r"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'western digital' ELSE 'supplier ' || regexp_extract(s_name, '([0-9]+)', 1) || ' and sons' END AS key FROM supplier")
def c7_company_identity(s, d):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Western Digital, Inc.")).otherwise(F.concat("s_name", F.lit(" &amp; Sons Ltd. uk")))
    return load(s, d, "supplier").select(F.col("s_suppkey").alias("id"), text.company_identity(raw).alias("key"))


@query(V("listing") + r"SELECT id, regexp_replace(replace(trim(regexp_replace(regexp_replace(lower(title), '\b(internship|intern|co-?op|student)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')), 'engineering', 'engineer'), '\bdevelopment\b', 'developer', 'g') AS key FROM listing")
def c8_role_identity(s, d):
    return listing(s, d).select("id", text.role_identity(F.col("title")).alias("key"))


@query(V("listing") + "SELECT id, CASE WHEN length(description) <= 40 THEN description ELSE rtrim(substr(description, 1, 39)) || '…' END AS short FROM listing")
def c9_truncate(s, d):
    return listing(s, d).select("id", text.truncated(F.col("description"), 40).alias("short"))


@query("SELECT c_custkey AS id, substr(lower(c_name), 1, 1) || '***@example.com' AS masked FROM customer")
def c10_mask_email(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), text.masked_email(F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("masked"))


@query("SELECT page_id, url || ' token=[REDACTED] Bearer [REDACTED]' AS safe FROM pages")
def c11_redact(s, d):
    return pages(s, d).select("page_id", text.redacted(F.concat("url", F.lit(" token=abc123 Bearer x.y-z"))).alias("safe"))


@query("SELECT c_custkey AS id, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM customer")
def c12_ascii_fold(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), text.ascii_fold(F.col("c_name")).alias("folded"))


@query(V("listing") + r"SELECT id, regexp_matches(description, '(?i)\bunit\s+tests\b|\bc\+\+|\bpytorch\b') AS hit FROM listing")
def c13_keyword_pattern(s, d):
    return listing(s, d).select("id", F.regexp_like("description", F.lit(text.pattern_of(["unit tests", "C++", "PyTorch"]))).alias("hit"))


@query(V("listing") + "SELECT id, substr(sha256(concat_ws('|', company, title, location, CAST(id AS VARCHAR), '')), 1, 24) AS key FROM listing")
def c14_listing_id(s, d):
    return listing(s, d).select("id", text.listing_id(F.col("company"), F.col("title"), F.col("location"), F.col("id"), F.lit(None)).alias("key"))


#: Of the stable fields of a listing's content, those that the view has, in order.
#: The fields whose change makes a listing a changed one, each as an expression of both engines over a listing.
_STABLE = {
    "jobId": "CAST(id AS STRING)", "company": "company", "title": "title", "location": "[location, nation]", "remoteStatus": "remote", "applicationUrl": "url", "postingUrl": "concat('https://x.example/', CAST(id AS STRING))", "description": "description", "responsibilities": "[description, region]", "requiredQualifications": "[title, category]",
    "preferredQualifications": "[stage]", "technologies": "[category, lower(region)]", "educationRequirements": "[concat('degree in ', category)]", "graduationRequirements": "[year]", "experienceRequirements": "[lower(title)]", "workAuthorizationRequirements": "[nation]",
    "sponsorshipInformation": "CASE WHEN id % 5 = 0 THEN description END", "qualificationDetails": "{sponsorship: lifecycle, years: year}", "internshipTerm": "term", "internshipYear": "year", "duration": "CASE WHEN id % 3 = 0 THEN '4 months' END", "salary": "CASE WHEN id % 7 = 0 THEN '$30 per hour' END",
    "postingDate": "CAST(CAST(posted_at AS DATE) AS STRING)", "deadline": "CASE WHEN id % 4 = 0 THEN '2027-06-30' END", "categories": "[category]", "relevanceScore": "relevance",
}


def _stable(f: str, spark: bool) -> str:
    """A field's expression; arrays in brackets and structs in braces are written in each engine's way."""
    if f[0] == "[":
        return f"array({f[1:-1]})" if spark else f
    if f[0] == "{":
        parts = [p.split(": ") for p in f[1:-1].split(", ")]
        return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in parts) + ")" if spark else "struct_pack(" + ", ".join(f'"{n}" := {v}' for n, v in parts) + ")"
    return f


@query(V("listing") + "SELECT id, sha256(CAST(to_json(struct_pack(" + ", ".join(f'"{n}" := {_stable(v, False)}' for n, v in _STABLE.items()) + ")) AS VARCHAR)) AS hash FROM listing")
def c15_content_hash(s, d):
    """Every listing's hash over 26 fields; nulls stay in the JSON, as a field that goes missing is a change."""
    return listing(s, d).select("id", text.content_hash([F.expr(_stable(v, True)).alias(n) for n, v in _STABLE.items()]).alias("hash"))


@query("SELECT event_id, event_type || '_total_ms' AS metric FROM events")
def c16_metric_key(s, d):
    camel = F.concat("event_type", F.lit("TotalMs"))
    return load(s, d, "events").select("event_id", F.lower(F.regexp_replace(camel, "([a-z0-9])([A-Z])", "$1_$2")).alias("metric"))


@query("SELECT event_type AS metric, CASE WHEN event_type LIKE '%ck' THEN 'ms' WHEN event_type LIKE 'p%' THEN 'bytes' ELSE 'count' END AS unit, count(*) AS n FROM events GROUP BY 1, 2")
def c17_metric_unit(s, d):
    m = F.col("event_type")
    unit = F.when(F.endswith(m, F.lit("ck")), "ms").when(F.startswith(m, F.lit("p")), "bytes").otherwise("count")
    return load(s, d, "events").groupBy(m.alias("metric"), unit.alias("unit")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, CAST(count(DISTINCT lower(l_returnflag)) AS INT) AS n FROM lineitem GROUP BY l_orderkey")
def u6_unique_strings(s, d):
    raw = F.flatten(F.array(F.collect_list("l_returnflag"), F.collect_list(F.concat(F.lit("• "), F.lower("l_returnflag"), F.lit(";")))))
    return load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.size(text.unique_items(raw)).alias("n"))


# ---- links

_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_source|ref)=[^&]*', '\1', 'g'), '\?&+', '?'), '[?&]+$', '')"""


@query(f"""SELECT page_id, CASE WHEN contains(c, '?') THEN regexp_replace(split_part(c, '?', 1), '([^/])/+$', '\\1') || '?' || split_part(c, '?', 2) ELSE regexp_replace(c, '([^/])/+$', '\\1') END AS canonical FROM (SELECT page_id, {_CANON} AS c FROM pages)""")
def l1_canonical_url(s, d):
    return pages(s, d).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(V("listing") + r"SELECT id, CASE WHEN contains(url, '?') THEN split_part(regexp_replace(url, '/apply\?.*$', ''), '?', 1) || '?gh_jid=7' ELSE url END AS job_url FROM listing")
def l2_job_url(s, d):
    return listing(s, d).select("id", urls.job_url(F.col("url")).alias("job_url"))


@query(V("listing") + r"SELECT id, CASE WHEN contains(url, 'gh_jid=7') THEN '7' WHEN id >= 100 THEN CAST(id AS VARCHAR) END AS job_id FROM listing")
def l3_job_id(s, d):
    return listing(s, d).select("id", urls.job_id(F.col("url")).alias("job_id"))


@query(V("listing") + "SELECT id, CASE id % 6 WHEN 0 THEN 'company' || CAST(company_id AS VARCHAR) WHEN 1 THEN 'company' || CAST(company_id AS VARCHAR) WHEN 2 THEN 'linkedin' WHEN 3 THEN 'jobright' WHEN 4 THEN 'acme' ELSE 'example' END AS organization FROM listing")
def l4_organization(s, d):
    return listing(s, d).select("id", urls.organization(F.col("url")).alias("organization"))


@query(V("listing") + "SELECT CASE id % 6 WHEN 0 THEN 'ats' WHEN 1 THEN 'ats' WHEN 2 THEN 'linkedin' WHEN 3 THEN 'aggregator' WHEN 4 THEN 'ats' ELSE 'other' END AS class, count(*) AS n FROM listing GROUP BY 1")
def l5_host_class(s, d):
    return listing(s, d).groupBy(urls.host_class(F.col("url")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS label, regexp_matches(url, '^https?://([^/?#]+\\.)?example\\.com([/?#]|$)') AS same FROM pages")
def l6_same_site(s, d):
    return pages(s, d).select("page_id", urls.bare_host(F.col("url")).alias("label"), urls.same_site(F.col("url"), F.lit("https://www.example.com/x")).alias("same"))


@query(V("listing") + "SELECT id, CASE id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'linkedin.com' WHEN 3 THEN 'jobright.ai' WHEN 4 THEN 'workday' ELSE 'careers.example.com' END AS provider FROM listing")
def l7_provider(s, d):
    return listing(s, d).select("id", urls.provider(F.col("url")).alias("provider"))


@query(V("listing") + "SELECT id, CASE id % 6 WHEN 0 THEN 'Company ' || company_id WHEN 1 THEN 'Company ' || company_id WHEN 2 THEN 'Linkedin' WHEN 3 THEN 'Jobright' WHEN 4 THEN 'Acme' ELSE 'Example' END AS company FROM listing")
def l9_company_from_url(s, d):
    return listing(s, d).select("id", urls.company_of(F.col("url")).alias("company"))


@query()
def l10_html_to_text(s, d):
    @F.pandas_udf(StringType())
    def plain(x):
        return x.map(text.fragment_text)

    t = plain("html")
    return load(s, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


# ---- dates


@query(f"""SELECT id, CASE id % 7 WHEN 0 THEN {NOW_MS} - (id % 30) * 86400000 WHEN 1 THEN {NOW_MS} - (id % 30) * 604800000 WHEN 2 THEN {NOW_MS} - (id % 30) * 2592000000 WHEN 3 THEN NULL WHEN 4 THEN {NOW_MS} - 86400000 WHEN 5 THEN epoch_ms(CAST(d AS DATE)) ELSE NULL END AS ms FROM (SELECT o_orderkey AS id, o_orderdate AS d FROM orders)""")
def t1_posting_date(s, d):
    n = (F.col("o_orderkey") % 30).cast("string")
    raw = F.when(F.col("k") == 0, F.concat(n, F.lit(" days ago"))).when(F.col("k") == 1, F.concat(F.lit("Posted: "), n, F.lit("w"))).when(F.col("k") == 2, F.concat(n, F.lit("mo"))).when(F.col("k") == 3, F.concat(n, F.lit("m")))
    raw = raw.when(F.col("k") == 4, F.lit("Yesterday")).when(F.col("k") == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("N/A"))
    df = load(s, d, "orders").withColumn("k", F.col("o_orderkey") % 7)
    return df.select(F.col("o_orderkey").alias("id"), dates.posting_ms(raw, F.lit(NOW_MS)).alias("ms"))


#: Ways to write a deadline: Spark's format and what stands round it, and the answer in the comparing engine's SQL over the day ``d`` (a day of 2026, given twice: with and without year).
_DUE = [
    ("yyyy-MM-dd", "{}", "e"), ("M/d/yyyy", "Apply by {}", "e"), ("MMMM d, yyyy", "Closing date: {}", "e"), ("MMM d, yyyy", "{} 5:00 PM EDT", "epoch_ms(d) + 21 * 3600000"), ("d MMMM yyyy", "Applications close {}.", "e"), ("d MMM", "before {}", "e"), ("MMMM d", "{}", "e"),
    ("MM/dd/yyyy", "{}, 12:00 AM", "epoch_ms(d)"), ("d MMM yyyy", "until {} at 11:59 pm PST", "epoch_ms(d) + (23 + 8) * 3600000 + 59 * 60000"), ("M-d-yyyy", "{}", "e"), ("MMMM", "in {}", "NULL"), ("yyyy", "someday in {}", "NULL"), ("d/yyyy", "{}", "NULL"), ("'Feb 30,' yyyy", "{}", "NULL"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "{}", "epoch_ms(d)"), ("MMMM d'th', yyyy", "{} 25:00", "e"), ("d'.' MMM yyyy", "{}", "NULL"), ("MMM d 'at' H", "{}", "epoch_ms(d)"),
]


@query(f"SELECT id, CASE k " + " ".join(f"WHEN {k} THEN {'epoch_ms(d) + 86399999' if x[2] == 'e' else x[2]}" for k, x in enumerate(_DUE)) + f" END AS ms FROM (SELECT o_orderkey AS id, o_orderkey % {len(_DUE)} AS k, TIMESTAMP '2026-01-01' + to_days(CAST(o_orderkey % 365 AS INT)) AS d FROM orders)")
def t2_deadline(s, d):
    day = F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(CAST(o_orderkey % 365 AS INT))")
    raw = None
    for n, (pattern, frame, _) in enumerate(_DUE):
        before, after = frame.split("{}")
        one = F.concat(F.lit(before), F.date_format(day, pattern), F.lit(after))
        raw = F.when(F.col("o_orderkey") % len(_DUE) == n, one) if raw is None else raw.when(F.col("o_orderkey") % len(_DUE) == n, one)
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), dates.deadline_ms(raw, F.lit(1782864000000)).alias("ms"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTHS AS DATE) AS cutoff FROM orders")
def t3_clamped_cutoff(s, d):
    day = F.col("o_orderdate").cast("date")
    return load(s, d, "orders").select(day.alias("day"), F.add_months(day, -2).alias("cutoff")).distinct()


@query("SELECT event_id, CAST(floor(epoch_ms(ts) / 900000.0) AS BIGINT) AS bucket, strftime(ts, '%Y-%-m-%-d') AS day FROM events")
def t4_buckets(s, d):
    return load(s, d, "events").select("event_id", dates.bucket(dates.millis(F.col("ts"))).alias("bucket"), F.date_format("ts", "yyyy-M-d").alias("day"))


#: Sentences by detail, each with what is read from it.
_TIMES = {
    "duration": ["Duration: 4 months.", "A 12-week internship awaits you.", "The placement runs for 8 to 16 weeks.", "We move from May to August.", "No length is given.", ""],
    "posted": ["Posted on June 3, 2026.", "Date posted: 2026-05-04.", "Posted: 3 days ago.", "It was posted somewhere."],
    "deadline": ["Apply by June 30, 2027.", "Applications close on 2027-01-15.", "Closing date: 5 March 2027.", "Apply soon.", ""],
    "salary": ["Pay is $30 - $40 per hour.", "We pay $90,000 per year.", "USD 45 an hour.", "Pay is fair.", "Paid €20/hour.", ""],
}
_NONE = {"No length is given.", "It was posted somewhere.", "Apply soon.", "Pay is fair.", ""}


def _picked(values: list[str], key: str, none: set[str] | None = None) -> str:
    """SQL of both engines for a value by a key modulo their number; null for those in ``none``."""
    quoted = ["CAST(NULL AS STRING)" if none and v in none else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


_TIME_KEYS = {k: f"o_orderkey + {7 * i} * o_custkey" for i, k in enumerate(_TIMES)}


@query("SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'Summer' WHEN 1 THEN 'Fall' END AS term, CASE o_custkey % 3 WHEN 0 THEN '2027' WHEN 1 THEN '2026' END AS year, " + ", ".join(f"{_picked(v, _TIME_KEYS[k], _NONE)} AS {k}" for k, v in _TIMES.items()) + " FROM orders")
def t5_temporal_details(s, d):
    season = F.when(F.col("o_custkey") % 3 == 1, "Our internship program starts in fall.").otherwise("")
    start = F.when(F.col("o_custkey") % 3 == 1, "Start date: September 2026.").otherwise("")
    title = F.when(F.col("o_custkey") % 3 == 0, "Software Intern, summer 2027").otherwise("Software Intern")
    body = F.array_join(F.filter(F.array(F.lit("About us."), season, start, *[F.expr(_picked(v, _TIME_KEYS[k])) for k, v in _TIMES.items()]), lambda x: x != ""), " ")
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"), body.alias("body"))
    rows = rows.select("id", "title", "body", text.sentences(F.col("body")).alias("ss"))
    t = rows.select("id", dates.temporal(F.col("title"), F.col("body"), F.col("ss")).alias("t"))
    return t.select("id", "t.term", "t.year", "t.duration", "t.posted", "t.deadline", "t.salary")


@query(V("listing") + """SELECT id, concat_ws(',', CASE WHEN regexp_matches(t, '\\bwinter\\b') THEN 'winter' END, CASE WHEN regexp_matches(t, '\\bspring\\b') THEN 'spring' END, CASE WHEN regexp_matches(t, '\\bsummer\\b') THEN 'summer' END, CASE WHEN regexp_matches(t, '\\b(fall|autumn)\\b') THEN 'fall' END) AS seasons FROM (SELECT id, lower(concat_ws(chr(10), title, description, term)) AS t FROM listing)""")
def t6_seasons(s, d):
    return listing(s, d).select("id", F.array_join(dates.seasons(F.concat_ws("\n", "title", "description", "term")), ",").alias("seasons"))


_AGES = ["", "3 Days ago ", "{className: 1} ", "Yesterday, self.__next_f ", "12w children ", "6 minutes ago $L1 ", "\n today. "]


@query(rf"""SELECT doc_id, CASE WHEN t = '' THEN 'none' WHEN length(t) <= 240 AND k NOT IN (2, 3, 4, 5) AND NOT regexp_matches(t, '(?i)className|children|job-tag--|\$L\d') THEN t WHEN k = 1 THEN '3 Days ago' WHEN k = 3 THEN 'Yesterday' WHEN k = 4 THEN '12w' WHEN k = 6 THEN 'today' ELSE 'none' END AS kept
FROM (SELECT doc_id, doc_id % 7 AS k, regexp_replace({_picked(_AGES, "doc_id")} || coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def t7_sanitized(s, d):
    """Every document's text behind a beginning of seven kinds."""
    raw = F.concat(F.expr(_picked(_AGES, "doc_id")), F.coalesce("text", F.lit("")))
    return docs(s, d).select("doc_id", dates.sanitized(raw, F.lit("none")).alias("kept"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 90) * 1000 ELSE CAST(least(60000, 1000 * pow(2, event_id % 9)) AS BIGINT) END AS wait_ms FROM events")
def t8_retry_delay(s, d):
    header = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 90).cast("string"))
    return load(s, d, "events").select("event_id", dates.retry_delay(header, F.lit(NOW_MS), F.col("event_id") % 9 + 1).alias("wait_ms"))


@query(V("listing") + f"SELECT id, epoch_ms(last_seen) AS deadline, epoch_ms(last_seen) - 86400000 AS alert_at FROM listing WHERE epoch_ms(last_seen) > {NOW_MS} AND epoch_ms(last_seen) - {NOW_MS} < 86400000")
def t9_closing_soon(s, d):
    at = dates.millis(F.col("last_seen"))
    return listing(s, d).select("id", at.alias("deadline"), (at - dates.DAY_MS).alias("alert_at")).filter(dates.closing_soon(F.col("deadline"), F.lit(NOW_MS)))


@query(V("listing") + f"SELECT min(least(CASE WHEN epoch_ms(last_seen) - 86400000 > {NOW_MS} THEN epoch_ms(last_seen) - 86400000 END, CASE WHEN epoch_ms(last_seen) > {NOW_MS} THEN epoch_ms(last_seen) END)) AS refresh_at FROM listing")
def t10_next_refresh(s, d):
    return listing(s, d).agg(dates.next_refresh(dates.millis(F.col("last_seen")), F.lit(NOW_MS)).alias("refresh_at"))


# ---- numbers, arrays and JSON


@query("SELECT event_id, CAST(least(100, greatest(0, floor((value - 50) * 0.75 + 0.5))) AS INT) AS score FROM events")
def m1_clamped(s, d):
    return load(s, d, "events").select("event_id", k.clamp((F.col("value") - 50) * 0.75).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS finite FROM events")
def m2_finite(s, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    return load(s, d, "events").select("event_id", F.coalesce(F.when(~F.isnan(raw), raw), F.lit(0.0)).alias("finite"))


@query("SELECT l_orderkey AS id, bool_or(l_quantity > 40) AS any_large, bool_and(l_quantity > 5) AS all_more FROM lineitem GROUP BY l_orderkey")
def y1_array_predicates(s, d):
    rows = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    return rows.select("id", F.exists("q", lambda x: x > 40).alias("any_large"), F.forall("q", lambda x: x > 5).alias("all_more"))


@query(V("listing") + "SELECT id, nation AS place FROM listing")
def y2_first_element(s, d):
    return listing(s, d).select("id", F.try_element_at(F.split("location", ", "), F.lit(1)).alias("place"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def y3_json_path(s, d):
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(V("listing") + """SELECT id, CASE id % 4 WHEN 0 THEN concat_ws(chr(10), title, region, nation, remote) WHEN 1 THEN concat_ws(chr(10), company, location, title) WHEN 2 THEN title ELSE concat_ws(chr(10), description, term, year) END AS text FROM listing WHERE id % 9 <> 4 AND (id % 4 <> 3 OR description <> '' OR term IS NOT NULL OR year IS NOT NULL OR description IS NOT NULL)""")
def y4_flattened_text(s, d):
    """All strings of JSON of four shapes, up to seven levels deep; numbers, truth values and nulls are no text, and a broken body has none."""
    deep = lambda c, n: c if not n else F.array(deep(c, n - 1))
    shapes = [
        F.to_json(F.struct(F.array("title").alias("a"), F.struct(F.struct(F.array("region", "nation").alias("x"), F.lit(1).alias("n")).alias("in"), F.struct(F.array(F.struct("remote")).alias("y")).alias("out")).alias("b"))),
        F.to_json(F.array(F.struct("company"), F.struct(F.col("location").alias("company")), F.struct(F.col("title").alias("company")))), F.to_json(deep(F.col("title"), 6)),
        F.to_json(F.struct(F.col("description").alias("a"), F.struct("term", F.struct(F.col("year").alias("y"), F.lit(True).alias("t")).alias("year")).alias("b"))),
    ]
    body = F.coalesce(*[F.when(F.col("id") % 4 == k, c) for k, c in enumerate(shapes)])
    rows = listing(s, d).select("id", F.when(F.col("id") % 9 == 4, F.concat(F.lit("{"), body)).otherwise(body).alias("json"))
    return nested.texts(rows, ["id"], "json")


@query("""WITH e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS k, event_id % 6 AS m FROM events)
SELECT id, CASE m WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'Item ' || (k + 1) WHEN 2 THEN 'x y' WHEN 5 THEN 'true' END AS found, CASE m WHEN 0 THEN 'a[1].b' WHEN 1 THEN 'list[' || (k + 1) || ']' WHEN 2 THEN 'deep.in[0].c d' WHEN 3 THEN 'range' END AS stands FROM e""")
def y5_path_resolve(s, d):
    """Paths and evidence that differ by row: what stands at the path, and where the evidence stands after its list has changed."""
    k, m = (F.get_json_object("props", "$.k").cast("int") % 7), F.col("event_id") % 6
    items = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: F.concat(F.lit("Item "), x.cast("string")))
    made = F.to_json(F.struct(F.array(F.struct(F.lit(77).alias("b")), F.struct(k.alias("b"))).alias("a"), items.alias("list"), F.struct(F.array(F.struct(F.lit("x y").alias("c d"))).alias("in")).alias("deep"), F.struct(k.alias("min"), (k + 2).alias("max")).alias("range"), F.lit(True).alias("flag")))
    pick = lambda *cs: F.coalesce(*[F.when(m == n, c) for n, c in enumerate(cs)])
    text_ = lambda c: c.cast("string")
    path = pick(F.lit("a[1].b"), F.concat(F.lit("list["), text_(k + 1), F.lit("]")), F.lit("deep.in[0].c d"), F.lit("range"), F.lit("list[99]"), F.lit("flag"))
    rows = load(s, d, "events").select(F.col("event_id").alias("id"), F.try_parse_json(made).alias("v"), path.alias("path"), pick(F.lit("a[0].b"), F.lit("list[0]"), F.lit("deep.in[3].c d"), F.lit("range"), F.lit("nowhere"), F.lit("list[2]")).alias("was"),
                                       pick(text_(k), F.concat(F.lit(" ITEM-"), text_(k + 1)), F.lit("X, y"), F.concat_ws("-", text_(k), text_(k + 2)), F.lit("q"), F.lit("Item 77")).alias("said"))
    return rows.select("id", nested.resolved(F.col("v"), F.col("path")).alias("found"), nested.realigned(F.col("v"), F.col("was"), F.col("said")).alias("stands"))


@query(V("listing") + "SELECT id, CASE WHEN remote = 'unknown' THEN lower(coalesce(term, 'none')) ELSE remote END AS chosen FROM listing")
def y6_unknown_aware(s, d):
    return listing(s, d).select("id", F.coalesce(F.nullif("remote", F.lit("unknown")), F.lower(F.coalesce("term", F.lit("none")))).alias("chosen"))


# ---- classification

_PLACED = _sql_says("title", k.PLACEMENT_TITLE)
_BODY = " OR ".join(_sql_says("description", p) for p in (k.DIRECT_PLACEMENT, k.STUDY_CONTEXT, k.RELATED_PLACEMENT))
_IS = f"CASE WHEN {_PLACED} THEN NOT {_sql_says('title', k.PERMANENT_TITLE)} OR {_sql_says('title', k.EXPLICIT_PLACEMENT_TITLE)} ELSE {_BODY} END"


def _labels_sql(rules: dict[str, str], c: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_sql_says(c, p)} THEN '{n}' END" for n, p in rules.items()) + ")"


@query(V("listing") + f"SELECT id, {_IS} AS placement FROM listing")
def k1_placement(s, d):
    return listing(s, d, heavy=True).select("id", k.is_placement(F.col("title"), F.col("description")).alias("placement"))


_ACT = " + ".join(f"CAST({_sql_says('description', p)} AS INT)" for p in k.ACTIONS)
_TECH_N = " + ".join(f"CAST({_sql_says('t', p)} AS INT)" for p in k.TECHNOLOGIES.values())
_SCORE = f"""CAST(least(100, greatest(0, CASE WHEN p THEN 0 ELSE -45 END + CASE WHEN p AND {_sql_says('t', k.TARGET_TERM)} THEN 26 ELSE 0 END + CASE WHEN {_sql_says('title', k.DIRECT_PLACEMENT)} THEN 34 ELSE 0 END
 + CASE WHEN {_sql_says('title', k.SOFTWARE_TITLE)} THEN 29 WHEN {_sql_says('title', k.TECHNICAL_TITLE)} THEN 12 ELSE 0 END + CASE WHEN a > 0 THEN least(24, floor((a * 9 + 8) * 0.75 + 0.5)) ELSE 0 END + least(17, floor(n * 4 * 0.75 + 0.5))
 - CASE WHEN {_sql_says('title', k.OTHER_TITLE)} THEN 41 ELSE 0 END - CASE WHEN a = 0 AND {_sql_says('description', k.OTHER_CONTEXT)} THEN 23 ELSE 0 END)) AS INT)"""
_SCORED = V("listing") + f", x AS (SELECT *, concat_ws(chr(10), title, description, '') AS t, {_ACT} AS a, ({_PLACED} OR {_BODY}) AS p FROM listing), y AS (SELECT *, {_TECH_N} AS n FROM x) "


@query(_SCORED + f"SELECT id, {_SCORE} AS score FROM y")
def k2_role_score(s, d):
    return listing(s, d, heavy=True).select("id", k.role_score(F.col("title"), F.col("description")).alias("score"))


@query(_SCORED + f", z AS (SELECT id, {_SCORE} AS score, {_labels_sql(k.CATEGORIES, 't')} AS c FROM y) SELECT id, CASE WHEN c = '' AND score >= 45 THEN 'other-code' ELSE c END AS categories FROM z")
def k3_categories(s, d):
    body = F.concat_ws("\n", "title", "description", F.lit(""))
    return listing(s, d, heavy=True).select("id", F.array_join(k.categories(body, k.role_score(F.col("title"), F.col("description"))), ",").alias("categories"))


@query(V("listing") + f"SELECT id, {_labels_sql(k.TECHNOLOGIES, 'description')} AS technologies FROM listing")
def k4_technologies(s, d):
    return listing(s, d, heavy=True).select("id", F.array_join(k.technologies(F.col("description")), ",").alias("technologies"))


def _weights_sql(field: str, c: str) -> str:
    terms = " + ".join("CASE WHEN regexp_matches({c}, '{p}') THEN {w} ELSE 0 END".format(c=c, p=text.pattern_of([t]).replace("\\ ", " ").replace("\\-", "-"), w=w) for t, w in k.WEIGHTS[field].items())
    return f"least({terms}, {k.BOUNDS[field]})" if field in k.BOUNDS else f"({terms})"


_REL = f"""CAST(least(100, greatest(0, least(100, {_weights_sql('title_positive', 'title')} + {_weights_sql('title_ambiguous', 'title')} - {_weights_sql('title_negative', 'title')})
 + {_weights_sql('department_positive', 'category')} - {_weights_sql('department_negative', 'category')} + {_weights_sql('snippet_positive', 'description')} - {_weights_sql('snippet_negative', 'description')})) AS INT)"""


@query(V("listing") + f"SELECT id, {_REL} AS score FROM listing")
def k5_weighted_relevance(s, d):
    return listing(s, d, heavy=True).select("id", k.relevance(F.col("title"), F.col("category"), F.col("description")).alias("score"))


#: Sentences with what they tell: e(ducation), g(raduation), x (experience).
_FACTS = [
    ("Currently pursuing a degree in computer science.", "e"), ("Minimum Qualifications: Enrolled at a university.", "e"), ("Graduating between 2027 and 2028.", "g"), ("Returning to school in fall.", "g"), ("Two years of professional experience.", "x"),
    ("Experience with Python is needed.", "x"), ("Hands-on experience using Spark and a Bachelor's degree.", "ex"), ("You like to learn.", ""), ("Class of 2027, third year students.", "g"), ("We are a team of five.", ""), ("Prior experience is a plus.", "x"),
]
_HEADED = "Minimum Qualifications: "


def _sentence_at(k: int) -> str:
    return _picked([t for t, _ in _FACTS], f"o_orderkey + {k} * o_custkey + {3 * k}")


def _told(kind: str) -> str:
    these = ", ".join("'" + t.replace("'", "''") + "'" for t, x in _FACTS if kind in x)
    return f"list_transform(list_filter(list_distinct3, lambda v: v IN ({these})), lambda v: replace(v, '{_HEADED}', ''))"


def _facts(s, d):
    body = F.concat_ws(" ", *[F.expr(_sentence_at(k)) for k in range(3)])
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))
    return rows.select("id", text.sentences(F.col("body")).alias("ss"))


@query(f"""WITH x AS (SELECT o_orderkey AS id, {_sentence_at(0)} AS a, {_sentence_at(1)} AS b, {_sentence_at(2)} AS c FROM orders),
y AS (SELECT id, list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c NOT IN (a, b) THEN c END], lambda v: v IS NOT NULL) AS list_distinct3 FROM x)
SELECT id, array_to_string({_told('e')}, '|') AS education, array_to_string({_told('g')}, '|') AS graduation, array_to_string({_told('x')}, '|') AS experience FROM y""")
def k9_requirement_facts(s, d):
    f = _facts(s, d).select("id", req.facts(F.col("ss")).alias("f"))
    return f.select("id", *[F.array_join(F.col(f"f.{c}"), "|").alias(c) for c in ("education", "graduation", "experience")])


@query("""WITH x AS (SELECT o_orderkey AS id, 2020 + o_orderkey % 6 AS a, o_custkey % 4 AS w, o_orderkey % 5 AS k FROM orders)
SELECT id, CAST(CASE k WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN w < 2 THEN a END ELSE a END AS INT) AS first_year, CAST(CASE k WHEN 0 THEN a WHEN 1 THEN a + w WHEN 2 THEN a + w WHEN 4 THEN CASE WHEN w < 2 THEN a + w END END AS INT) AS last_year FROM x""")
def k10_year_range(s, d):
    """One year, two kinds of explicit ranges, a year that speaks of no graduation, and two years that are a range only if contiguous."""
    a, b = (2020 + F.col("o_orderkey") % 6).cast("string"), (2020 + F.col("o_orderkey") % 6 + F.col("o_custkey") % 4).cast("string")
    k = F.col("o_orderkey") % 5
    body = F.when(k == 0, F.concat(F.lit("Class of "), a, F.lit("."))).when(k == 1, F.concat(F.lit("Expected graduation between "), a, F.lit(" and "), b, F.lit("."))).when(k == 2, F.concat(F.lit("You graduate in "), a, F.lit("–"), b, F.lit(".")))
    body = body.when(k == 3, F.concat(F.lit("Founded in "), a, F.lit("."))).otherwise(F.concat(F.lit("Graduating in "), a, F.lit(". Degree completion by "), b, F.lit(".")))
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.sentences(F.concat(F.lit("Since 1999. "), body)).alias("ss"))
    return rows.select("id", req.graduation(F.col("ss")).alias("g")).select("id", F.col("g.first").alias("first_year"), F.col("g.last").alias("last_year"))


#: Sentences on years of study, with the years, whether first years may apply and whether upper years are asked for.
_STUDY = [
    ("First-year students are welcome.", "first-year", "yes", "unknown"), ("Not open to freshmen.", "first-year", "no", "unknown"), ("Must be a junior.", "third-year", "unknown", "yes"), ("Rising seniors preferred.", "fourth-year,upper-year", "unknown", "no"),
    ("Second year or above, sophomore.", "second-year", "unknown", "yes"), ("Third-year or above only.", "third-year", "unknown", "yes"), ("Penultimate year required.", "upper-year", "unknown", "yes"), ("Year 1 applicants may apply.", "first-year", "yes", "unknown"), ("All are students here.", "", "unknown", "unknown"),
]


@query("SELECT o_orderkey AS id, " + ", ".join(f"{_picked([x[k] for x in _STUDY], 'o_orderkey')} AS {n}" for k, n in enumerate(("study", "first_year", "upper_year"), 1)) + " FROM orders")
def k11_study_year(s, d):
    body = F.concat(F.lit("We hire often. "), F.expr(_picked([x[0] for x in _STUDY], "o_orderkey")))
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.sentences(body).alias("ss"))
    return rows.select("id", req.study_years(F.col("ss")).alias("y")).select("id", F.array_join("y.values", ",").alias("study"), "y.first_year", "y.upper_year")


#: Sentences on being a student, on enrollment and on returning to school, with their states.
_ASKED = [
    ("You must be a student.", "required", "unknown", "unknown"), ("Students only.", "required", "unknown", "unknown"), ("Being a student is a plus.", "preferred", "unknown", "unknown"), ("You do not need to be a student.", "not_required", "unknown", "unknown"),
    ("You must be registered in a college.", "unknown", "required", "unknown"), ("You must return to school afterwards.", "unknown", "unknown", "required"), ("Returning to college is nice to have.", "unknown", "unknown", "preferred"), ("You need not apply.", "unknown", "unknown", "unknown"),
    ("You must be a student. Candidates who are not a student may write too.", "conflict", "unknown", "unknown"),
]


@query("SELECT o_orderkey AS id, " + ", ".join(f"{_picked([x[k] for x in _ASKED], 'o_orderkey')} AS {n}" for k, n in enumerate(("student", "enrollment", "returning"), 1)) + " FROM orders")
def k12_requirement_state(s, d):
    body = F.expr(_picked([x[0] for x in _ASKED], "o_orderkey"))
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.sentences(body).alias("ss"))
    return rows.select("id", *[req.state(F.col("ss"), t).alias(t) for t in req.TOPICS])


#: Statements on sponsorship and the right to work: state, how many sentences offer and deny, and the right to work.
_SPONSOR = [
    ("Visa sponsorship will not be provided.", "unavailable", 0, 1, "unknown"), ("Sponsorship: available.", "available", 1, 0, "unknown"), ("We cannot provide visa sponsorship. Must be legally authorized to work in Canada.", "unavailable", 0, 1, "required"),
    ("Employer sponsorship is available for eligible candidates.", "available", 1, 0, "unknown"), ("Sponsorship is available.", "unknown", 0, 0, "unknown"), ("Security clearance sponsorship is available.", "unknown", 0, 0, "unknown"), ("Visa sponsorship may be available.", "unknown", 0, 0, "unknown"),
    ("Will you now or in the future require sponsorship?", "unknown", 0, 0, "unknown"), ("We provide sponsorship for campus events.", "unknown", 0, 0, "unknown"), ("The company will not pursue visa sponsorship for this position.", "unavailable", 0, 1, "unknown"), ("Candidates must not require U.S. Venture's sponsorship now.", "unavailable", 0, 1, "unknown"),
    ("Visa sponsorship is available, but this employer will not provide it for this role.", "conflict", 1, 1, "unknown"), ("Immigration sponsorship will be provided. We do not sponsor visas.", "conflict", 1, 1, "unknown"), ("Visa sponsorship is available for select roles.", "unknown", 0, 0, "unknown"),
    ("Our history includes offering visa sponsorship. We do not guarantee sponsorship for this role.", "unknown", 0, 0, "unknown"), ("The position does not require sponsorship.", "unknown", 0, 0, "unknown"), ("The right to work is preferred.", "unknown", 0, 0, "preferred"), ("This role does not require work authorization.", "unknown", 0, 0, "not_required"), ("", "unknown", 0, 0, "unknown"),
]
_FRAMES = [("Join us. ", " Benefits are good."), ("• Python\n• ", "\n• SQL"), ("", ""), ("We build robots!\n\n", "\nApply by June 30, 2027.")]


@query(f"SELECT o_orderkey AS id, {_picked([x[1] for x in _SPONSOR], 'o_orderkey')} AS sponsorship, " + ", ".join(f"CAST({_picked([str(x[n]) for x in _SPONSOR], 'o_orderkey')} AS INT) AS {name}" for n, name in ((2, "n_offers"), (3, "n_denials"))) + f", {_picked([x[4] for x in _SPONSOR], 'o_orderkey')} AS authorization FROM orders")
def k13_sponsorship(s, d):
    """Statements in four kinds of surroundings."""
    frame = lambda n: F.expr(_picked([x[n] for x in _FRAMES], "o_custkey"))
    body = F.concat(frame(0), F.expr(_picked([x[0] for x in _SPONSOR], "o_orderkey")), frame(1))
    rows = spread(load(s, d, "orders")).select(F.col("o_orderkey").alias("id"), sponsorship.evidence(body).alias("e"), sponsorship.state(body).alias("sponsorship"), sponsorship.work_authorization(body).alias("authorization"))
    return rows.select("id", "sponsorship", F.size("e.available").alias("n_offers"), F.size("e.unavailable").alias("n_denials"), "authorization")


#: Texts of pages, with the state and the reason that they mean (empty: an ordinary page).
_SAID = [
    ("Sorry, the page you are looking for does not exist.", "not-found", "Page not found"), ("This job has expired.", "closed", "Job expired"), ("We are no longer accepting applications.", "closed", "No longer accepting applications"), ("404 Not Found", "not-found", "Page not found"),
    ("The position has been closed; the page could not be found.", "not-found", "Page not found"), ("This listing was no longer available.", "closed", "Job no longer available"), ("Applications remain open until the position is filled.", "", ""), ("This requisition cannot be found", "not-found", "Job not found"),
    ("The posting has been removed", "closed", "Job posting removed or closed"), ("Please complete the captcha.", "", ""), ("Our system could not find the requested page", "not-found", "Page not found"), ("Log in to continue", "", ""), ("", "", ""),
]
_WALLED = {"Please complete the captcha.", "Log in to continue"}
_STATUS = [200, 404, 403, 301, 500, 410, 429]


def _page_sql(k: int) -> str:
    return _picked([x[k] for x in _SAID], "page_id")


_PAGE_STATE = f"SELECT page_id, {_page_sql(0)} AS t, {_page_sql(1)} AS c, {_page_sql(2)} AS r, [{', '.join(map(str, _STATUS))}][page_id % {len(_STATUS)} + 1] AS status, page_id % 11 = 3 AS login FROM pages"


def _landed(s, d):
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("page_id") % len(_STATUS) + 1).cast("int"))
    url = F.concat(F.lit("https://jobs.lever.co/acme/"), F.when(F.col("page_id") % 11 == 3, "login").otherwise(F.col("page_id").cast("string")))
    return load(s, d, "pages").select("page_id", F.concat(F.lit("Careers. "), F.expr(_page_sql(0)), F.lit(" Thanks!")).alias("body"), status.alias("status"), url.alias("url"))



@query(f"SELECT page_id, CASE WHEN status = 404 THEN 'HTTP 404' WHEN status = 410 THEN 'HTTP 410 Gone' ELSE nullif(r, '') END AS reason FROM ({_PAGE_STATE})")
def k16_closed_page(s, d):
    return _landed(s, d).select("page_id", k.closed_reason(F.col("status"), F.col("url"), F.col("body")).alias("reason"))


def _keyword_sql() -> str:
    import re

    sep = r"[\s\-–—‑]+"
    whole = lambda p: f"regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{p})(?:[^\\p{{L}}\\p{{N}}_]|$)')"
    return whole("|".join(sep.join(re.escape(w).replace("\\-", "-") for w in x.split()) for x in k.TECHNICAL_KEYWORDS)) + " AND " + whole(k.PLACEMENT_KEYWORDS)


@query(V("listing") + f"SELECT id, {_keyword_sql()} AS kept FROM (SELECT id, concat_ws(chr(10), title, description) AS t FROM listing)")
def f2_keyword_gate(s, d):
    return listing(s, d, heavy=True).select("id", k.keyword_gate(F.concat_ws("\n", "title", "description")).alias("kept"))


@query(V("listing") + "SELECT id, title NOT LIKE '%Sales%' AND (url NOT LIKE '%linkedin.com%' OR id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS allowed FROM listing")
def f3_content_gate(s, d):
    verified = load(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("verified", F.lit(True))
    ok = ~F.contains("title", F.lit("Sales")) & (~F.contains("url", F.lit("linkedin.com")) | F.col("verified").isNotNull())
    return listing(s, d).join(verified, "id", "left").select("id", ok.alias("allowed"))


@query(V("listing") + r"SELECT id, CASE WHEN contains(title, '2026') AND NOT contains(title, '2027') THEN '2026' WHEN regexp_matches(title, '(?i)\bnew[\s-]+grad') THEN 'new grad' WHEN regexp_matches(title, '(?i)\bph\.?\s*d\.?\b') THEN 'PhD' WHEN regexp_matches(title, '(?i)\b12\s*-?\s*months?\b') THEN '12 months without a standalone 4' END AS reason FROM listing")
def f6_excluded_title(s, d):
    return listing(s, d).select("id", k.excluded_title(F.col("title")).alias("reason"))


@query(V("listing") + "SELECT id, CASE WHEN contains(description, 'No visa sponsorship') THEN CASE WHEN id % 24 = 6 THEN 'not_stated' ELSE 'unavailable' END WHEN contains(description, 'Employer sponsorship is available') THEN 'available' ELSE 'not_stated' END AS shown FROM listing")
def f17_sponsorship_shown(s, d):
    state = sponsorship.state(F.col("description"))
    return listing(s, d).select("id", F.when((F.col("id") % 24 == 6) | (state == "unknown"), "not_stated").otherwise(state).alias("shown"))


@query(f"SELECT page_id, nullif(c, '') AS state, nullif(r, '') AS reason FROM ({_PAGE_STATE})")
def f19_unavailable_page(s, d):
    return _landed(s, d).select("page_id", k.page_content(F.col("body")).alias("c")).select("page_id", "c.state", "c.reason")


@query(f"""SELECT page_id, CASE WHEN c = 'closed' THEN 'closed' WHEN status IN (401, 403, 407, 429) OR t IN ({', '.join(repr(x) for x in sorted(_WALLED))}) OR login THEN 'access-controlled'
 WHEN status IN (404, 410) OR c = 'not-found' THEN 'closed' WHEN status BETWEEN 200 AND 399 THEN 'reachable' ELSE 'failed' END AS state FROM ({_PAGE_STATE})""")
def f20_link_state(s, d):
    return _landed(s, d).select("page_id", k.link_state(F.col("status"), F.col("url"), F.col("body")).alias("state"))


@query(V("listing") + "SELECT id, contains(description, 'security clearance') AS clearance FROM listing")
def f21_clearance(s, d):
    return listing(s, d).select("id", k.needs_clearance(F.col("description")).alias("clearance"))


@query(V("listing") + f"""SELECT id, CASE WHEN regexp_matches(title, '(?i)\\bph\\.?\\s*d|new grad') OR (contains(title, '2026') AND NOT contains(title, '2027')) OR contains(title, '12 months') THEN 'title' WHEN length(description) < 80 THEN 'incomplete'
 WHEN NOT ({_IS}) THEN 'not a placement' WHEN relevance < 20 THEN 'score' WHEN relevance < 45 AND {_labels_sql(k.CATEGORIES, "concat_ws(chr(10), title, description, '')")} = '' THEN 'no category' WHEN region = 'EUROPE' AND remote <> 'remote' THEN 'location' WHEN availability = 'closed' THEN 'dead link' END AS reason FROM listing""")
def f26_admission(s, d):
    t, b = F.col("title"), F.col("description")
    dead = k.link_state(F.when(F.col("availability") == "closed", 404).otherwise(200), F.col("url"), F.lit("")) == "closed"
    reason = k.rejected(t, F.col("company"), b, F.col("relevance"), 20, (F.col("region") != "EUROPE") | (F.col("remote") == "remote"), dead)
    return listing(s, d, heavy=True).select("id", reason.alias("reason"))


@query(V("listing") + f"SELECT id, NOT ({' + '.join(_weights_sql(f, {'title': 'title', 'department': 'category', 'snippet': 'description'}[f.split('_')[0]]) for f in k.WEIGHTS if f.endswith('negative'))} > 0 AND {' + '.join(_weights_sql(f, {'title': 'title', 'department': 'category', 'snippet': 'description'}[f.split('_')[0]]) for f in k.WEIGHTS if not f.endswith('negative'))} = 0) AS fetch FROM listing")
def f27_acquisition(s, d):
    return listing(s, d, heavy=True).select("id", (~k.Weighted(k.WEIGHTS).rejects(F.col("title"), F.col("category"), F.col("description"))).alias("fetch"))


@query(V("listing") + f"""SELECT id, {_IS} AND relevance >= 20 AS accepted, {_labels_sql(k.TECHNOLOGIES, 'description')} AS technologies, CASE WHEN contains(description, 'No visa sponsorship') THEN 'unavailable' WHEN contains(description, 'Employer sponsorship is available') THEN 'available' ELSE 'unknown' END AS sponsorship,
 {_labels_sql(k.CATEGORIES, "concat_ws(chr(10), title, description, '')")} AS categories, CASE WHEN contains(description, 'per hour') THEN 'Salary $30 - $40 per hour.' END AS salary, CASE WHEN contains(description, 'Apply by') THEN 'Apply by June 30, 2027.' END AS deadline FROM listing WHERE length(description) >= 80""")
def k14_analyze(s, d):
    """The analysed listing: admission, technologies, categories, sponsorship and the sentences on pay and deadline, from one reading of its sentences."""
    t, b = F.col("title"), F.col("description")
    df = listing(s, d, heavy=True).filter(F.length(b) >= 80).select("id", "title", "description", "relevance", text.sentences(b).alias("ss"))
    df = df.select("*", dates.temporal(t, b, F.col("ss")).alias("when"))
    return df.select("id", (k.is_placement(t, b) & (F.col("relevance") >= 20)).alias("accepted"), F.array_join(k.technologies(b), ",").alias("technologies"), sponsorship.state(b).alias("sponsorship"),
                     F.array_join(k.labels(F.concat_ws("\n", t, b, F.lit("")), k.CATEGORIES), ",").alias("categories"), "when.salary", "when.deadline")


@query(r"""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]{3,}'), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was'))) AS w FROM benchmark), c AS (SELECT DISTINCT unnest(w) AS w FROM b WHERE item_id % 4 = 0),
t AS (SELECT item_id, unnest(w) AS w FROM b), n AS (SELECT t.item_id, count(*) AS shared FROM t JOIN c ON c.w = t.w GROUP BY t.item_id), x AS (SELECT b.item_id, coalesce(shared, 0) + 5 * (CAST(list_contains(w, 'that.') AS INT) + CAST(list_contains(w, 'ing') OR list_contains(w, 'tion') AS INT)) AS score FROM b LEFT JOIN n ON n.item_id = b.item_id)
SELECT item_id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INT) AS place FROM x""")
def e16_keyword_rank(s, d):
    """Benchmark items as short texts against the words of every fourth, with two skills, of which one has an alias."""
    items = load(s, d, "benchmark").select("item_id", match.keywords(F.col("text")).alias("words"))
    corpus = items.filter("item_id % 4 = 0").select(F.explode("words").alias("word")).distinct()
    return match.ranked(items, "item_id", corpus, {"that.": ["that."], "ing": ["ing", "tion"]}).select("item_id", "score", "place")


