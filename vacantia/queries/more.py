"""Locations, sections, evidence, checked feed parameters, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places, sections, urls
from ..operators import relations as rel
from ..operators import windows as win
from ..operators.stage import folder
from ..plans import eligibility, feed, frontier
from ..sources import search, sinks
from ..sources.tables import listing, load
from ..sources.tables import sql_views as V
from ..streaming import leases, versions
from ..streaming import sightings as stream
from .registry import query

#: Raw locations, and the city, region, country, remote scope (null: not remote) that they mean.
PLACES = [
    ("Toronto, ON", "Toronto", "Ontario", "Canada", None), ("Austin, TX, United States", "Austin", "Texas", "United States", None), ("Remote - Canada", None, None, "Canada", "canada"), ("Richmond, VA", "Richmond", "Virginia", "United States", None),
    ("Melbourne, Victoria, Australia", "Melbourne", None, "Australia", None), ("US-CA-San Jose", "San Jose", "California", "United States", None), ("Richmond", "Richmond", None, None, None), ("Vancouver, CA", "Vancouver", None, "Canada", None),
    ("Remote, worldwide", None, None, None, "worldwide"), ("Somewhere", None, None, None, None), ("Los Angeles, CA", "Los Angeles", "California", "United States", None), ("Remote (US only)", None, None, None, "usa"),
]


def _case(column: int) -> str:
    quoted = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    return f"CASE o_orderkey % {len(PLACES)} " + " ".join(f"WHEN {i} THEN {quoted(p[column])}" for i, p in enumerate(PLACES)) + " END"


def _raw(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*[F.lit(p[0]) for p in PLACES]), (F.col("o_orderkey") % len(PLACES) + 1).cast("int")).alias("raw"))


@query(f"SELECT o_orderkey AS id, {_case(1)} AS city, {_case(2)} AS region, {_case(3)} AS country, {_case(4)} AS scope FROM orders")
def k6_locations(s, d):
    return _raw(s, d).select("id", places.parsed(F.col("raw")).alias("p")).select("id", "p.city", "p.region", "p.country", "p.scope")


@query(f"SELECT o_orderkey AS id, {_case(4)} IS NOT NULL OR coalesce({_case(3)} IN ('Canada', 'United States'), false) AS allowed FROM orders")
def f5_location_allowed(s, d):
    return _raw(s, d).select("id", F.coalesce(places.allowed(F.array(places.parsed(F.col("raw"))), F.lit("unknown")), F.lit(False)).alias("allowed"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS status FROM orders")
def k7_remote_resolution(s, d):
    m = F.col("o_orderkey") % 4
    given = F.when(m == 0, F.array(F.lit("Remote"), F.lit("Toronto"))).when(m == 1, F.array(F.lit("Hybrid or remote"))).when(m == 2, F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), places.remote_status(given, F.when(m == 2, F.lit("This role is onsite."))).alias("status"))


@query(V("listing") + """SELECT id, section, line FROM (SELECT id, unnest(['required', 'required', 'preferred', 'responsibilities']) AS section, unnest([title, 'Knows SQL well', 'Has met ' || company, description]) AS line FROM listing) WHERE length(line) >= 3""")
def k8_sections(s, d):
    text = F.concat(F.lit("About us\nWe are "), "company", F.lit("\n\nMinimum Qualifications:\n• "), "title", F.lit("\n1) Knows SQL well\n• knows sql well\nNice to have\n- Has met "), "company", F.lit("\nWhat you will do:\n"), "description", F.lit("\nBenefits\nFree lunch"))
    return sections.sections(listing(s, d).select("id", text.alias("text")), "id", "text").select("id", "section", "line")


@query(V("listing") + "SELECT id, field, value, CAST(start AS INT) AS start FROM (SELECT id, unnest(['title', 'company']) AS field, unnest([title, company]) AS value, unnest([9, length(title) + 13]) AS start FROM listing)")
def k15_field_evidence(s, d):
    df = listing(s, d).withColumn("text", F.concat(F.lit("We seek: "), "title", F.lit(" at "), "company"))
    return sections.evidence(df, "id", "text", {"title": F.col("title"), "company": F.col("company"), "salary": F.lit("$5")})


@query(V("listing") + """SELECT id, (SELECT count(*) FROM listing WHERE availability = 'open' AND lifecycle = 'NEW' AND contains(lower(concat_ws(' ', title, company, location, description)), 'intern')) AS total FROM listing
WHERE availability = 'open' AND lifecycle = 'NEW' AND contains(lower(concat_ws(' ', title, company, location, description)), 'intern') ORDER BY relevance DESC, company, title, id LIMIT 20""")
def f14_checked_query(s, d):
    q = feed.FeedQuery.parse({"status": "new", "sort": "relevance", "q": " Intern ", "limit": "20", "tab": "main"})
    return feed.page(listing(s, d), q).select("id", "total")


@query(V("listing") + "SELECT id, title, location FROM listing WHERE relevance > 90")
def s21_json_and_csv(s, d):
    rows = listing(s, d).filter("relevance > 90").select("id", "title", "location")
    back = [s.read.schema(rows.schema).json(sinks.write_rows(rows.filter("id % 2 = 0"), folder(s), "json")), s.read.schema(rows.schema).option("header", True).csv(sinks.write_rows(rows.filter("id % 2 = 1"), folder(s), "csv"))]
    return rel.union_all(*back)


@query(V("listing") + """SELECT id, '## ' || CAST(row_number() OVER (ORDER BY relevance DESC, id) AS VARCHAR) || '. ' || company || ' — ' || title || chr(10) || chr(10) || 'Location: ' || location || chr(10) || 'Term: ' || coalesce(term, 'Unknown') || chr(10) || chr(10) || 'Technologies:' || chr(10) || '- Not stated' AS entry
FROM listing WHERE availability = 'open' AND relevance > 95""")
def s22_report(s, d):
    df = rel.numbered(listing(s, d).filter("availability = 'open' and relevance > 95").select("id", "company", "title", "location", "term", "relevance"), [F.desc("relevance"), F.col("id")], "n")
    entry = sinks.report_entry(F.col("n"), F.col("company"), F.col("title"), {"Location": F.col("location"), "Term": F.col("term")}, {"Technologies": F.array().cast("array<string>")})
    return df.select("id", entry.alias("entry"))


@query(V("listing") + "SELECT id, company, title FROM listing WHERE id % 9 <> 4")
def s15_validated_table(s, d):
    """Rows of a serialized table; a row that lacks a company or title, or has a bad id, is left out."""
    row = F.to_json(F.struct(F.when(F.col("id") % 9 == 4, F.lit("x")).otherwise(F.col("id").cast("string")).alias("id"), "company", "title"))
    table = listing(s, d).groupBy("company_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("body"))
    rows = table.select(F.inline(F.from_json("body", "array<struct<id:string,company:string,title:string>>")))
    return rows.select(F.expr("try_cast(id AS bigint)").alias("id"), "company", "title").filter("id is not null and company <> '' and title <> ''")


def _landed(s: SparkSession, d: str, parts: int = 3) -> str:
    """The events as files of a landing folder."""
    path = folder(s)
    load(s, d, "events").repartition(parts, "event_id").write.parquet(path)
    return path


def _schema(s: SparkSession, d: str):
    return load(s, d, "events").schema


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def x1_bounded_stream(s, d):
    """One file a micro-batch: the source is read no faster than it is worked off."""
    out, log = folder(s), folder(s)
    rows = s.readStream.schema(_schema(s, d)).option("maxFilesPerTrigger", 1).parquet(_landed(s, d))
    rows.select("event_type").writeStream.format("parquet").option("checkpointLocation", log).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")
def x2_incremental_merge(s, d):
    """Each micro-batch is merged into the state of the batch before."""
    target = folder(s)

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))
        if old is None:
            return new
        both = old.unionByName(new)
        return both.groupBy("user_id").agg(F.max("last_event").alias("last_event"), F.sum("n").alias("n"))

    q = stream.merged_batches(s, _landed(s, d), _schema(s, d), target, merge, folder(s))
    q.awaitTermination()
    return s.read.parquet(f"{target}/{q.lastProgress['batchId']}")


@query("SELECT e.user_id AS id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS first_run, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_run, count(CASE WHEN event_id > coalesce(m, -1) THEN 1 END) AS misses FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON p.user_id = e.user_id GROUP BY e.user_id")
def x5_keyed_state(s, d):
    """First and last run that saw an id, and the misses since, kept as state over the stream."""
    name, out = f"state_{uuid.uuid4().hex}", folder(s)
    path = folder(s)
    load(s, d, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    rows = s.readStream.schema(_schema(s, d)).parquet(path).select(F.col("user_id").alias("id"), F.col("event_id").alias("run_id"), (F.col("event_type") == "purchase").alias("seen"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.lifecycle_state(rows).writeStream.queryName(name).outputMode("update").foreachBatch(write).option("checkpointLocation", folder(s)).trigger(availableNow=True).start().awaitTermination()
    return win.first_of(s.read.parquet(f"{out}/*"), ["id"], F.desc("batch")).select("id", "first_run", "last_run", "misses")


_HOUR = 3_600_000


def _by_time(s: SparkSession, d: str, parts: int = 3) -> str:
    """The events as files of a landing folder, by time."""
    path = folder(s)
    load(s, d, "events").repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return path


def _leases(s: SparkSession, d: str, lease_ms: int, final: bool) -> DataFrame:
    out = folder(s)
    rows = s.readStream.schema(_schema(s, d)).parquet(_by_time(s, d)).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    with leases.timed_state(s):
        leases.leased(rows, lease_ms, final, "1 hour").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder(s)).trigger(availableNow=True).start().awaitTermination()
    return leases.latest(s.read.parquet(out))


_GAPS = "WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events), w AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS mark FROM events), g AS (SELECT *, CASE WHEN nxt IS NULL THEN t + {lease} <= mark ELSE nxt - t > {lease} END AS ends FROM e, w) "


def _counted(s: SparkSession, d: str) -> tuple[versions.Versions, int]:
    """Events of users counted batch by batch."""
    state = versions.Versions(s, folder(s), "user_id", "user_id bigint, last_event bigint, n bigint", "counts")

    def rule(batch: DataFrame, old: DataFrame) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))
        return old.unionByName(new).groupBy("user_id").agg(F.max("last_event").alias("last_event"), F.sum("n").alias("n"))

    path, last = folder(s), []
    load(s, d, "events").repartitionByRange(3, "event_id").write.parquet(path)
    rows = s.readStream.schema(_schema(s, d)).option("maxFilesPerTrigger", 1).parquet(path)
    rows.writeStream.foreachBatch(lambda batch, number: last.append(number) if state.merge(batch, number, rule) is not None else None).option("checkpointLocation", folder(s)).trigger(availableNow=True).start().awaitTermination()
    return state, last[-1]


@query("SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")
def x2_bucketed_merge(s, d):
    """Only the buckets that a batch touches are read and written anew."""
    state, last = _counted(s, d)
    return state.state(last)


@query("SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")
def x9_change_log(s, d):
    """The same state from the log of its changes alone."""
    state, last = _counted(s, d)
    return state.replayed(last)


@query(_GAPS.format(lease=72 * _HOUR) + f"SELECT id, min(t) AS first_ms, max(t) AS last_ms, max(CASE WHEN ends AND nxt IS NULL THEN t + {72 * _HOUR} END) AS ended_ms, count_if(ends) AS times FROM g GROUP BY id")
def x5_timed_state(s, d):
    """Listings that close by a timer 72 hours after they were last seen, and open again when they are seen: state over the stream."""
    return _leases(s, d, 72 * _HOUR, False)


@query(_GAPS.format(lease=36 * _HOUR) + f"SELECT id, CASE WHEN count_if(ends) > 0 THEN 'FAILED' ELSE 'RUNNING' END AS status, min(CASE WHEN ends THEN t + {36 * _HOUR} END) AS failed_ms FROM g GROUP BY id")
def x7_lease_timers(s, d):
    """Runs that fail by a timer 36 hours after their last heartbeat, and stay failed."""
    out = _leases(s, d, 36 * _HOUR, True)
    return out.select("id", F.when(F.col("times") > 0, "FAILED").otherwise("RUNNING").alias("status"), F.col("ended_ms").alias("failed_ms"))


@query("""SELECT DISTINCT user_id % 20 AS source_id, event_id // 3 AS identity, CASE WHEN event_id // 3 % 7 = 0 THEN 'new' WHEN event_id // 3 % 7 = 1 THEN 'retryable' WHEN event_id // 3 % 2 = 0 AND event_id // 3 % 3 > 0 THEN 'unchanged' ELSE 'possibly_changed' END AS change FROM events""")
def x3_stream(s, d):
    """Sightings of micro-batches, repeated within and across them, each once with its change against the stored listings."""
    out, k = folder(s), F.floor(F.col("event_id") / 3)
    rows = s.readStream.schema(_schema(s, d)).option("maxFilesPerTrigger", 1).parquet(_by_time(s, d))
    rows = rows.select(F.lit(1).alias("run_id"), (F.col("user_id") % 20).alias("source_id"), k.alias("identity"), F.col("ts").cast("timestamp").alias("at"), F.lit("h").alias("hash"))
    i = F.col("identity")
    known = load(s, d, "events").select(k.alias("identity")).distinct().filter(i % 7 != 0).select("identity", F.when(i % 2 == 0, "h").otherwise("x").alias("hash"), (i % 3 > 0).alias("is_open"), (i % 7 == 1).alias("retry"))
    stream.sighting_changes(rows, known, "40 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("source_id", "identity", "change")


@query("SELECT page_id, page_id % 8 IN (5, 6, 7) AS public FROM pages")
def l8_public_address(s, d):
    hosts = ["http://localhost/x", "http://10.1.2.3/", "http://192.168.0.1:80/", "http://172.20.0.1", "http://printer/", "http://172.32.0.1/", "https://example.com/", "http://8.8.8.8"]
    raw = F.element_at(F.array(*map(F.lit, hosts)), (F.col("page_id") % 8 + 1).cast("int"))
    return load(s, d, "pages").select("page_id", urls.is_public(raw).alias("public"))


# ---- the nine criteria, over facts that each listing's id gives it

PROFILE = eligibility.Profile()


def _criteria(s: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    none = F.array().cast("array<string>")
    where = F.when(i % 3 == 0, F.array(places.parsed(F.lit("Toronto, ON")))).when(i % 3 == 1, F.array(places.parsed(F.lit("Paris, France")))).otherwise(F.array(places.parsed(F.lit("Remote"))))
    countries = F.when(i % 3 == 0, F.array(F.lit("Canada"))).when(i % 3 == 1, F.array(F.lit("United States"))).otherwise(none)
    degrees = F.when(i % 4 == 0, none).when(i % 4 == 1, F.array(F.lit("bachelors"), F.lit("masters"))).otherwise(F.array(F.lit("phd")))
    low, high = F.when(i % 5 < 2, 2027), F.when(i % 5 < 2, F.lit(2027) + (i % 5).cast("int"))
    listed = F.when(i % 5 == 2, F.array(F.lit(2028))).when(i % 5 == 3, F.array(F.lit(2026))).otherwise(F.array().cast("array<int>"))
    years = F.when(i % 7 == 0, F.array(F.lit(2027), F.lit(2026))).when(i % 7 < 4, F.array(F.lit(2027))).otherwise(F.array().cast("array<int>"))
    e, p = eligibility, PROFILE
    made = {
        "term": e.term(p, F.when(i % 7 < 5, F.lit("summer")).when(i % 7 == 5, F.lit("winter")), F.lit(None).cast("string"), years), "location": e.location(p, where, F.lit("unknown")),
        "work_authorization": e.authorization(p, pick(4, "required", "unknown", "preferred", "required"), countries), "sponsorship": e.sponsorship(p, pick(5, "unavailable", "available", "unknown", "conflict", "unavailable"), countries),
        "degree": e.degree(p, degrees), "graduation": e.graduation(p, listed, low, high), "year_of_study": e.study_year(p, F.when(i % 2 == 0, F.array(F.lit("upper-year"))).otherwise(none), pick(3, "unknown", "yes", "no"), pick(5, "unknown", "unknown", "yes", "unknown", "unknown")),
        "current_enrollment": e.enrollment(p, pick(3, "unknown", "required", "preferred"), F.lit("unknown")), "returning_to_school": e.returning(p, pick(4, "unknown", "required", "conflict", "preferred")),
    }
    return load(s, d, "orders").select(i.alias("id"), *[c.alias(n) for n, c in made.items()])


_PLACE3 = "CASE i % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'United States' END"
_NINE = """, f AS (SELECT o_orderkey AS id, o_orderkey AS i FROM orders), c AS (SELECT id,
 CASE WHEN i % 7 = 0 THEN 'conflict' WHEN i % 7 < 4 THEN 'pass' WHEN i % 7 = 4 THEN 'unknown' WHEN i % 7 = 5 THEN 'fail' ELSE 'unknown' END AS term,
 CASE i % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS location,
 CASE WHEN i % 4 = 1 THEN 'unknown' WHEN i % 4 = 2 THEN 'not_applicable' WHEN i % 3 = 0 THEN 'pass' WHEN i % 3 = 1 THEN 'fail' ELSE 'unknown' END AS work_authorization,
 CASE WHEN i % 5 = 1 THEN 'pass' WHEN i % 5 = 2 THEN 'unknown' WHEN i % 5 = 3 THEN 'conflict' WHEN i % 3 = 0 THEN 'pass' WHEN i % 3 = 1 THEN 'fail' ELSE 'unknown' END AS sponsorship,
 CASE i % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'pass' ELSE 'fail' END AS degree,
 CASE i % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'pass' WHEN 3 THEN 'fail' ELSE 'unknown' END AS graduation,
 CASE WHEN i % 3 = 1 THEN 'pass' WHEN i % 5 = 2 THEN 'pass' WHEN i % 2 = 0 AND i % 3 <> 2 THEN 'pass' ELSE 'unknown' END AS year_of_study,
 CASE i % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'pass' ELSE 'not_applicable' END AS current_enrollment,
 CASE i % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'pass' WHEN 2 THEN 'conflict' ELSE 'not_applicable' END AS returning_to_school FROM f) """


@query("WITH " + _NINE[2:] + "SELECT * FROM c")
def e1_nine_criteria(s, d):
    return _criteria(s, d).select("id", *[F.col(f"{c}.state").alias(c) for c in eligibility.CRITERIA])


_ALL = "[" + ", ".join(eligibility.CRITERIA) + "]"


@query("WITH " + _NINE[2:] + f"SELECT id, CASE WHEN list_contains({_ALL}, 'fail') THEN 'not_eligible' WHEN list_contains({_ALL}, 'conflict') THEN 'unclear' WHEN NOT list_contains({_ALL}, 'unknown') THEN 'eligible' ELSE 'likely_eligible' END AS status FROM c")
def e2_nine_status(s, d):
    return _criteria(s, d).select("id", eligibility.status(F.array(*eligibility.CRITERIA)).alias("status"))


# ---- frontier of a crawl

#: Rounds, admitted addresses and pages of a source.
_DEPTH, _ADMITTED, _PAGES = 4, 60, 40
#: A source's list pages name each other and its postings; a posting names the applicant system's page, which names all sources' postings, and a stranger's.
_CRAWL = """WITH line AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
address AS (SELECT o, s, concat('https://src-', s, '.example/jobs?page=', o % 8) AS list, concat('https://src-', s, '.example/jobs/', o) AS own, concat('https://boards.greenhouse.io/c', c, '/jobs/', o) AS ats FROM line),
page AS (SELECT DISTINCT list AS url FROM address UNION SELECT own FROM address WHERE o % 5 <> 0 UNION SELECT ats FROM address WHERE o % 7 <> 0),
link AS (SELECT list AS url, own AS link, 80 AS p FROM address UNION SELECT own, ats, 100 FROM address WHERE o % 5 <> 0 UNION SELECT ats, own, 80 FROM address WHERE o % 7 <> 0
  UNION SELECT DISTINCT list, concat('https://src-', s, '.example/jobs?page=', o % 8 + 1), 50 FROM address),
r0 AS (SELECT s AS source, min(concat('https://src-', s, '.example')) AS home, concat('https://src-', s, '.example/jobs?page=0') AS url, 0 AS depth, 1 AS place, CAST(NULL AS VARCHAR) AS referrer FROM line GROUP BY s)"""
_LINES = " UNION ALL ".join(["SELECT * FROM r0", *[f"SELECT * FROM r{k}" for k in range(1, _DEPTH + 1)]])


def _round(k: int) -> str:
    before = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(k))
    return f""", r{k} AS (SELECT source, home, link AS url, {k} AS depth, n + row_number() OVER (PARTITION BY source ORDER BY p DESC, link) AS place, referrer
 FROM (SELECT source, home, link, max(p) AS p, min(url) AS referrer FROM r{k - 1} JOIN link USING (url) WHERE url IN (SELECT url FROM page) AND place <= {_PAGES}
  AND (starts_with(link, home) OR starts_with(link, 'https://boards.greenhouse.io/')) GROUP BY ALL) JOIN (SELECT source, count(*) AS n FROM ({before}) GROUP BY source) USING (source)
 WHERE (source, link) NOT IN (SELECT (source, url) FROM ({before})) QUALIFY place <= {_ADMITTED})"""


def _linked_pages(s, d):
    """The pages as HTML, with the links in the ways that pages write them."""
    text = lambda c: F.col(c).cast("string")
    line = load(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct().join(load(s, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")), "o")
    src = F.concat(F.lit("https://src-"), text("s"), F.lit(".example"))
    own, ats = F.concat(src, F.lit("/jobs/"), text("o")), F.concat(F.lit("https://boards.greenhouse.io/c"), text("c"), F.lit("/jobs/"), text("o"))
    anchor = lambda *href: F.concat(F.lit('<li><a class="x" href="'), *href, F.lit('">Intern</a></li>'))
    every = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
    nr = (F.col("o") % 8).alias("nr")
    lists = line.groupBy("s", nr).agg(every(anchor(F.lit("/jobs/"), text("o"), F.lit("?utm_source=list#top"))).alias("rows")).select(F.concat(src, F.lit("/jobs?page="), text("nr")).alias("url"), F.concat("rows", anchor(F.lit("?page="), (F.col("nr") + 1).cast("string")), F.lit('<a href="mailto:x@y.example">mail</a>')).alias("html"))
    details = line.filter("o % 5 <> 0").select(own.alias("url"), F.concat(anchor(ats), F.lit("<A HREF='https://stranger.example/jobs/"), text("o"), F.lit("'>x</A>")).alias("html"))
    systems = line.filter("o % 7 <> 0").groupBy("c", "o").agg(every(anchor(own)).alias("html")).select(ats.alias("url"), "html")
    return rel.union_all(lists, details, systems)


@query(_CRAWL + "".join(map(_round, range(1, _DEPTH + 1))) + f" SELECT source, url, depth, CAST(place AS INT) AS place, referrer, CASE WHEN place > {_PAGES} THEN 'waiting' WHEN url IN (SELECT url FROM page) THEN 'read' ELSE 'missing' END AS state FROM ({_LINES})")
def x11_frontier_rounds(s, d):
    """Each source's crawl from its first list page, in rounds: what it admits, in which order, and what is read."""
    roots = load(s, d, "lineitem").select(F.col("l_suppkey").alias("source")).distinct().withColumn("url", F.concat(F.lit("https://src-"), F.col("source").cast("string"), F.lit(".example/jobs?page=0")))
    return frontier.crawl(roots, _linked_pages(s, d), _DEPTH, _ADMITTED, _PAGES)


# ---- search by an index

_SEARCHES = ["python", "C++ on Linux", "r", "summer 2027 internship for current students", "nowhere at all"]


@query(V("listing") + "SELECT q, id FROM listing, (SELECT unnest([" + ", ".join(f"'{q}'" for q in _SEARCHES) + "]) AS q) WHERE contains(lower(concat_ws(' ', title, company, location, description, url)), lower(q))")
def f13_indexed_search(s, d):
    """Searches of one letter up to a sentence, through an index of trigrams."""
    path = folder(s)
    search.build(listing(s, d), "id", F.concat_ws(" ", "title", "company", "location", "description", "url"), path)
    return rel.union_all(*[search.search(s, path, q).select(F.lit(q).alias("q"), F.col("key").alias("id")) for q in _SEARCHES])
