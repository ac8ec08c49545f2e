"""Readers, identity and lifecycle, matching, operations and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sponsorship, urls
from ..functions import classify as k
from ..operators import aggregates as agg
from ..operators import identity as ident
from ..operators import relations as rel
from ..operators import windows as win
from ..operators.stage import stored
from ..plans import matching as match
from ..plans import operations as ops
from ..sources import extract
from ..sources.tables import NOW, account, configured, crawl, listing, load, outcome, run, sighting
from ..sources.tables import sql_views as V
from ..streaming import sightings as stream
from .registry import query

CUT = "2024-01-30 12:00:00"


def ts(value: str):
    return F.lit(value).cast("timestamp_ntz")


# ---- readers: pages and feeds are composed from listings, so that what is read can be compared with them


def _pages(s, d):
    job = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("nation").alias("addressLocality")).alias("address")).alias("jobLocation"), "url", F.date_format("posted_at", "yyyy-MM-dd").alias("datePosted")))
    state = F.to_json(F.struct(F.struct(F.array(F.struct("title", "company", "location", "url")).alias("jobs")).alias("props")))
    page = F.when(F.col("id") % 3 == 0, F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), job, F.lit("]}</script><h1>x</h1>")))
    page = page.when(F.col("id") % 3 == 1, F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>")))
    body = "<p>This internship is a student position. " + "Apply with your qualifications. " * 4 + "</p>"
    page = page.otherwise(F.concat(F.lit("<html><h1>"), "title", F.lit(f"</h1>{body}")))
    return listing(s, d).select(F.col("id").alias("page_id"), page.alias("html"), "id")


@query(V("listing") + "SELECT id AS page_id, CASE id % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'page_state' ELSE 'semantic' END AS reader, title, CASE WHEN id % 3 < 2 THEN company END AS company FROM listing")
def s6_extractor_dispatch(s, d):
    return extract.postings(_pages(s, d)).select("page_id", "reader", "title", "company")


@query(V("listing") + "SELECT id AS page_id, title, company, nation AS location, url, strftime(posted_at, '%Y-%m-%d') AS posted FROM listing WHERE id % 3 = 0")
def s7_jsonld(s, d):
    """All pages are read; only every third has such data."""
    return extract.structured_postings(_pages(s, d)).select("page_id", "title", "company", "location", "url", "posted")


@query(V("listing") + "SELECT id AS page_id, title FROM listing WHERE id % 3 = 2")
def s8_semantic_html(s, d):
    return extract.postings(_pages(s, d), (extract.semantic,)).select("page_id", "title")


@query(V("listing") + "SELECT company_id, company, title, location FROM listing WHERE availability <> 'closed'")
def s9_markdown_table(s, d):
    cell = F.concat(F.lit("| "), "company", F.lit(" | "), "title", F.when(F.col("availability") == "closed", F.lit(" 🔒")).otherwise(F.lit("")), F.lit(" | "), "location", F.lit(" |"))
    rows = listing(s, d).groupBy("company_id").agg(F.array_sort(F.collect_list(cell)).alias("rows"))
    carried = F.transform("rows", lambda r, i: F.when(i > 0, F.regexp_replace(r, r"^\| [^|]+ \|", "| ↳ |")).otherwise(r))
    text = F.concat(F.lit("# Board\n| Company | Role | Location |\n| --- | --- | --- |\n"), F.array_join(carried, "\n"))
    return extract.table_rows(rows.select("company_id", text.alias("text")), "company_id", "text").select("company_id", "company", "title", "location")


@query(V("listing") + "SELECT id AS page_id, title, company, location FROM listing WHERE id % 3 = 1")
def s10_page_state(s, d):
    return extract.state_postings(_pages(s, d)).select("page_id", "title", "company", "location")


@query(V("listing") + "SELECT id FROM listing WHERE region IN ('AMERICA', 'ASIA') AND year IN ('2027')")
def s14_source_filter(s, d):
    df = listing(s, d).select("id", F.array("region").alias("places"), F.array_compact(F.array("year")).alias("years"))
    return extract.filtered_feed(df, ["AMERICA", "ASIA"], ["2027"]).select("id")


# ---- identity and lifecycle


def _payload(i):
    """The fields that a listing brings along, which differ by its number; some are missing."""
    word = lambda name, n: F.concat(F.lit(name), (i % n).cast("string"))
    lists = {c: F.when(i % k != 0, F.array(word(c, k), F.lit("Shared item."), F.lit("shared ITEM"))) for k, c in enumerate((c for c in ident.LISTS if c != "skills"), 2)}
    rest = {c: F.when(i % k != 1, word(c, k)) for k, (c, (_, rule)) in enumerate(ident.PAYLOAD.items(), 3) if rule == "first"}
    known = {c: F.when(i % k != 1, F.when(i % 2 == 0, F.lit("unknown")).otherwise(word(c, k))) for k, (c, (_, rule)) in enumerate(ident.PAYLOAD.items(), 3) if rule == "known"}
    told = F.array(*[F.struct(F.lit(c).alias("field"), v.alias("value"), word("page", 9).alias("page")) for c, v in (("term", rest["term"]), ("salary", rest["salary"]), ("required", F.lit("shared item.")))])
    return [v.alias(c) for c, v in (lists | rest | known | {"provenance": told}).items()]


def _records(s, d):
    """Listings whose links, requisitions, roles and places repeat within their company: direct pages of four hosts and an aggregator's copies."""
    i, c, n = F.col("id"), F.concat(F.lit("c"), "company_id"), F.concat(F.lit("100"), (F.col("id") % 5).cast("string"))
    board = F.concat(F.lit("https://boards.greenhouse.io/"), c, F.lit("/jobs/"), n, F.lit("?utm_source=x"))
    posting = F.when(i % 4 == 0, board).when(i % 4 == 1, F.concat(F.lit("https://jobs.lever.co/"), c, F.lit("/"), n, F.lit("/apply"))).when(i % 4 == 2, F.concat(F.lit("https://jobright.ai/info/z"), i, F.lit("z")))
    posting = posting.otherwise(F.concat(F.lit("https://www.careers.example.com/jobs/"), n, F.lit("?team="), c))
    title = F.when(i % 3 == 0, "Software Engineering Intern").when(i % 3 == 1, "Data Analyst (Co-op)").otherwise("Platform Developer")
    return listing(s, d, heavy=True).select(
        "id", posting.alias("posting_url"), F.when(i % 8 == 2, board).otherwise(posting).alias("application_url"), F.lit(None).cast("string").alias("provider"), F.concat(c, F.lit(", Inc.")).alias("company"), title.alias("title"),
        F.array(F.when(F.floor(i / 3) % 2 == 0, "Toronto").otherwise("Austin")).alias("locations"), F.when(i % 3 == 0, F.concat(F.lit("R"), (i % 4).cast("string"))).alias("job_id"), "description", F.array(F.col("category"), F.coalesce("term", F.lit("none"))).alias("skills"),
        "relevance", F.concat(F.lit("r"), F.col("relevance").cast("string")).alias("reason"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("sponsorship"), F.col("first_seen").alias("discovered"), F.col("last_seen").alias("verified"), (F.col("relevance") % 7).alias("base_quality"), "first_seen", "availability", *_payload(i),
    )


_REC = V("listing") + """, r0 AS (SELECT *, 'c' || company_id AS c, '100' || (id % 5) AS n, id % 4 = 2 AS agg, CASE id % 3 WHEN 0 THEN 'software engineer' WHEN 1 THEN 'data analyst' ELSE 'platform developer' END AS role, CASE WHEN id // 3 % 2 = 0 THEN 'toronto' ELSE 'austin' END AS place,
 CASE WHEN id % 3 = 0 THEN 'r' || (id % 4) END AS jid, CASE id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'jobright.ai' ELSE 'careers.example.com' END AS provider FROM listing),
r1 AS (SELECT *, CASE id % 4 WHEN 0 THEN ['g' || c || n] WHEN 1 THEN ['l' || c || n, 'a' || c || n] WHEN 2 THEN list_filter(['j' || id, CASE WHEN id % 8 = 2 THEN 'g' || c || n END], lambda x: x IS NOT NULL) ELSE ['e' || c || n] END AS urls, CASE WHEN id % 8 <> 6 THEN n END AS nid FROM r0),
rec AS (SELECT *, list_filter([jid, nid], lambda x: x IS NOT NULL) AS ids, list_filter([CASE WHEN NOT agg THEN jid END, nid], lambda x: x IS NOT NULL) AS direct, id % 8 = 6 AS app_agg FROM r1) """
_APART = "(len({a}.direct) > 0 AND len({b}.direct) > 0 AND NOT list_has_any({a}.direct, {b}.direct))"


@query(_REC + "SELECT id, CAST(len(urls) + len(ids) + 1 AS INT) AS n, 'role-location:' || c || '|' || role || '|' || place AS last_key, CASE WHEN len(ids) > 0 THEN 'provider-job:' || provider || '|' || c || '|' || ids[1] END AS job_key FROM rec")
def d1_identity_keys(s, d):
    df = ident.described(_records(s, d)).select("id", ident.keys().alias("keys"))
    job = F.try_element_at(F.filter("keys", lambda k: F.startswith(k, F.lit("provider-job:"))), F.lit(1))
    return df.select("id", F.size("keys").alias("n"), F.element_at("keys", -1).alias("last_key"), job.alias("job_key"))


@query(_REC + f"""SELECT a.id, b.id AS other FROM rec a JOIN rec b ON a.c = b.c AND a.id < b.id WHERE list_has_any(a.urls, b.urls) OR (list_has_any(a.ids, b.ids) AND (a.provider = b.provider OR (a.role = b.role AND a.place = b.place)))
 OR (a.role = b.role AND a.place = b.place AND NOT {_APART.format(a='a', b='b')})""")
def d2_pair_matches(s, d):
    return ident.matches(stored(ident.described(_records(s, d))))


@query(V("listing") + "SELECT company, title, region, min(id) AS id FROM listing GROUP BY company, title, region")
def d3_first_wins(s, d):
    return win.first_of(listing(s, d).select("company", "title", "region", "id"), ["company", "title", "region"], F.col("id"))


@query()
def d4_dedup_fold(s, d):
    """The merged records; blocks are what merging cannot leave."""
    df = stored(ident.described(_records(s, d)))
    out = ident.deduplicated(df.join(ident.merge_blocks(df), "id"), "block")
    return out.select("merged_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "company", "posting_url", F.array_join("locations", ",").alias("locations"), F.array_join("skills", ",").alias("skills"), "relevance", "reason", "sponsorship", F.length("description").alias("n_description"), "discovered", "verified")


@query(V("listing") + f"""SELECT id, CAST(points[1 + id % 5] + shown[1 + id // 5 % 5] + CASE WHEN id % 5 <> id // 5 % 5 THEN 15 ELSE 0 END + least(25, length(repeat(description, 12)) // 500) + relevance % 4 AS INT) AS quality
FROM (SELECT *, [40, 0, -35, 0, 0] AS points, [30, 30, 0, 30, 30] AS shown FROM listing)""")
def d5_quality_score(s, d):
    """Forms and postings on hosts of five kinds, each with each; of the points above a form's host gives the first, a posting's the second."""
    hosts = F.array(*[F.lit(f"https://{h}/1") for h in ("boards.greenhouse.io/a/jobs", "www.linkedin.com/jobs/view", "jobright.ai/jobs/info", "github.com/a/jobs", "careers.example.com/jobs")])
    at = lambda c: F.get(hosts, (c % 5).cast("int"))
    i = F.col("id")
    return listing(s, d).select("id", ident.quality(at(F.floor(i / 5)), at(i), F.repeat("description", 12), F.col("relevance") % 4).cast("int").alias("quality"))


_MERGE = _REC + """, w AS (SELECT *, relevance % 7 AS q, CASE WHEN id % 17 <> 1 THEN 'term' || id % 17 END AS term17, CASE WHEN id % 20 <> 1 THEN 'salary' || id % 20 END AS salary20, CASE WHEN id % 26 <> 1 THEN CASE WHEN id % 2 = 0 THEN 'unknown' ELSE 'student_status' || id % 26 END END AS student, CASE WHEN id % 4 <> 0 THEN ['required' || id % 4, 'Shared item.'] ELSE [] END AS req, lead(id) OVER (PARTITION BY c ORDER BY id) AS nxt FROM rec), pq AS (SELECT CASE WHEN b.q > a.q THEN b ELSE a END AS p, CASE WHEN b.q > a.q THEN a ELSE b END AS s FROM w a JOIN w b ON b.id = a.nxt)
SELECT p.id AS id, s.id AS other, coalesce(upper(p.jid), upper(s.jid)) AS job_id, array_to_string(list_distinct3, ',') AS locations, CASE WHEN length(p.description) < 100 AND length(s.description) >= 100 THEN s.description ELSE p.description END AS description, CASE WHEN p.agg AND NOT s.agg THEN s.id ELSE p.id END AS company_of,
 greatest(p.relevance, s.relevance) AS relevance, 'r' || greatest(p.relevance, s.relevance) AS reason, CASE WHEN CASE WHEN p.agg <> s.agg THEN NOT p.agg ELSE p.last_seen >= s.last_seen END THEN 's' || (p.id % 3) ELSE 's' || (s.id % 3) END AS sponsorship, least(p.first_seen, s.first_seen) AS discovered, greatest(p.last_seen, s.last_seen) AS verified,
 coalesce(p.term17, s.term17) AS term, coalesce(p.salary20, s.salary20) AS salary, coalesce(nullif(p.student, 'unknown'), s.student, p.student) AS student_status, array_to_string(list_concat(p.req, list_filter(s.req, lambda x: NOT list_contains(p.req, x))), ',') AS required,
 CAST(len(list_distinct(list_filter([CASE WHEN p.term17 IS NOT DISTINCT FROM coalesce(p.term17, s.term17) THEN 't' || coalesce(p.term17, '') || p.id % 9 END, CASE WHEN s.term17 IS NOT DISTINCT FROM coalesce(p.term17, s.term17) THEN 't' || coalesce(s.term17, '') || s.id % 9 END,
  CASE WHEN p.salary20 IS NOT DISTINCT FROM coalesce(p.salary20, s.salary20) THEN 's' || coalesce(p.salary20, '') || p.id % 9 END, CASE WHEN s.salary20 IS NOT DISTINCT FROM coalesce(p.salary20, s.salary20) THEN 's' || coalesce(s.salary20, '') || s.id % 9 END,
  CASE WHEN len(p.req) + len(s.req) > 0 THEN 'r' || p.id % 9 END, CASE WHEN len(p.req) + len(s.req) > 0 THEN 'r' || s.id % 9 END], lambda x: x IS NOT NULL))) AS INT) AS n_provenance
FROM (SELECT *, CASE WHEN p.place = s.place THEN [initcap1(p.place)] ELSE [initcap1(p.place), initcap1(s.place)] END AS list_distinct3 FROM pq)"""
_MERGE = _MERGE.replace("initcap1(p.place)", "upper(p.place[1]) || p.place[2:]").replace("initcap1(s.place)", "upper(s.place[1]) || s.place[2:]")


@query(_MERGE)
def d6_field_merge(s, d):
    """Each listing merged with the next of its company, the better one first."""
    from pyspark.sql import Window as W

    df = _records(s, d).withColumn("posting_aggregator", F.col("id") % 4 == 2).withColumn("key", F.regexp_extract("company", r"^c(\d+)", 1)).withColumn("company", F.col("id").cast("string"))
    rows = df.select("key", "id", F.col("base_quality").alias("q"), F.struct("id", "company", "job_id", "locations", "posting_aggregator", *ident.PAYLOAD).alias("v"))
    by = W.partitionBy("key").orderBy("id")
    pairs = rows.select("q", "v", F.lead("q").over(by).alias("q2"), F.lead("v").over(by).alias("v2")).filter("q2 is not null")
    better = F.col("q2") > F.col("q")
    pairs = pairs.select(F.when(better, F.col("v2")).otherwise(F.col("v")).alias("p"), F.when(better, F.col("v")).otherwise(F.col("v2")).alias("s"))
    m = ident.merged_fields(F.col("p"), F.col("s"))
    return pairs.select(F.col("p.id").alias("id"), F.col("s.id").alias("other"), m["job_id"].alias("job_id"), F.array_join(m["locations"], ",").alias("locations"), m["description"].alias("description"), m["company"].cast("bigint").alias("company_of"), *[m[c].alias(c) for c in ("relevance", "reason", "sponsorship", "discovered", "verified", "term", "salary", "student_status")], F.array_join(m["required"], ",").alias("required"), F.size(m["provenance"]).alias("n_provenance"))


_STORE = _REC + f""", n AS (SELECT * FROM rec WHERE availability = 'open'), o AS (SELECT * FROM rec WHERE availability = 'closed'), role AS (SELECT n.id, o.id AS old, n.place = o.place AS near FROM n JOIN o ON n.c = o.c AND n.role = o.role AND (n.app_agg <> o.app_agg OR (n.app_agg AND n.place = o.place))),
 rc AS (SELECT id, bool_or(near) AS anynear, count(*) AS k FROM role GROUP BY id), m AS (SELECT n.id, o.id AS old, 'url' AS kind FROM n JOIN o ON n.c = o.c AND list_has_any(n.urls, o.urls) UNION ALL SELECT n.id, o.id, 'provider' FROM n JOIN o ON n.c = o.c AND n.provider = o.provider AND list_has_any(n.ids, o.ids)
 UNION ALL SELECT role.id, old, 'role' FROM role JOIN rc ON rc.id = role.id WHERE CASE WHEN anynear THEN near ELSE k = 1 END) """


def _stores(s, d):
    df = stored(ident.described(_records(s, d).filter("availability IN ('open', 'closed')")).select(*ident.STORE, "availability"))
    return df.filter("availability = 'open'"), df.filter("availability = 'closed'")


@query(_STORE + "SELECT id, old, kind FROM m")
def d7_store_match(s, d):
    return ident.store_matches(*_stores(s, d))


@query(_STORE + f""", cand AS (SELECT m.id, old, CASE kind WHEN 'url' THEN 0 ELSE 1 END AS rank, CASE WHEN kind <> 'url' THEN o.first_seen ELSE TIMESTAMP '1970-01-01' END AS seen FROM m JOIN o ON o.id = m.old
 UNION ALL SELECT n.id, o.id, 2, TIMESTAMP '1970-01-01' FROM n JOIN o ON n.c = o.c AND n.jid = o.jid UNION ALL SELECT n.id, o.id, 3, TIMESTAMP '1970-01-01' FROM n JOIN o ON n.c = o.c AND n.role = o.role AND n.place = o.place AND NOT {_APART.format(a='n', b='o')})
SELECT id, old FROM (SELECT id, old, row_number() OVER (PARTITION BY id ORDER BY rank, seen, old) AS k FROM cand) WHERE k = 1""")
def d8_find_existing(s, d):
    return ident.existing(*_stores(s, d))


@query(V("listing") + "SELECT id, CASE WHEN m IS NULL THEN 'NEW' WHEN availability = 'closed' OR relevance <> m % 101 THEN 'UPDATED' ELSE 'UNCHANGED' END AS lifecycle FROM listing LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = id")
def d9_lifecycle_decision(s, d):
    prior = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("m"))
    df = listing(s, d).join(prior, "id", "left")
    return df.select("id", rel.lifecycle(F.col("m").isNotNull(), F.col("relevance") == F.col("m") % 101, F.col("availability") == "closed").alias("lifecycle"))


@query(V("sighting") + "SELECT CASE WHEN id % 10 = 3 THEN id - 1 ELSE id END AS id, source_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM sighting GROUP BY 1, 2")
def d10_relation_merge(s, d):
    links = sighting(s, d).select("id", "source_id", "first_seen", "last_seen")
    merged = links.select("id").distinct().filter("id % 10 = 3").select("id", (F.col("id") - 1).alias("canonical"))
    return rel.repointed(links, "id", merged, "source_id")


@query(V("listing") + "SELECT company_id, CASE max(CASE lifecycle WHEN 'REMOVED' THEN 4 WHEN 'NEW' THEN 3 WHEN 'UPDATED' THEN 2 ELSE 0 END) WHEN 4 THEN 'REMOVED' WHEN 3 THEN 'NEW' WHEN 2 THEN 'UPDATED' ELSE 'UNCHANGED' END AS status FROM listing GROUP BY company_id")
def d11_status_lattice(s, d):
    return listing(s, d).groupBy("company_id").agg(rel.strongest(F.col("lifecycle")).alias("status"))


@query(V("listing", "sighting") + """, cov AS (SELECT id, bool_and(source_id % 5 <> 0) AS covered FROM sighting GROUP BY id)
SELECT listing.id, CAST(relevance % 3 + CASE WHEN availability <> 'closed' AND coalesce(covered, false) THEN 1 ELSE 0 END AS INT) AS misses, availability <> 'closed' AND coalesce(covered, false) AND relevance % 3 + 1 >= 2 AS closes FROM listing LEFT JOIN cov ON cov.id = listing.id""")
def d12_missing_aging(s, d):
    covered = sighting(s, d).groupBy("id").agg(F.bool_and(F.col("source_id") % 5 != 0).alias("covered"))
    df = listing(s, d).join(covered, "id", "left")
    misses, closes = rel.aged(F.col("relevance") % 3, F.col("availability") != "closed", F.coalesce("covered", F.lit(False)))
    return df.select("id", misses.cast("int").alias("misses"), closes.alias("closes"))


@query(V("listing") + "SELECT id FROM listing WHERE url LIKE '%lever.co%' AND availability = 'open' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def d13_close_by_url(s, d):
    protected = load(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return listing(s, d).filter((urls.provider(F.col("url")) == "lever") & (F.col("availability") == "open")).select("id").join(protected, "id", "left_anti")


@query("SELECT user_id, max(ts) AS visited FROM events GROUP BY user_id")
def d15_monotone_visit(s, d):
    e = load(s, d, "events").select("user_id", "ts", "event_id")
    sides = [e.filter(f"event_id % 2 = {r}").groupBy("user_id").agg(F.max("ts").alias("visited")) for r in (0, 1)]
    return rel.upsert(sides[0], sides[1], "user_id", {"visited": "max"})


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def d16_last_wins(s, d):
    return rel.last_wins(load(s, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type")


@query(V("listing") + "SELECT listing.id, coalesce(p_name, description) AS description, coalesce(p_type, url) AS url, 'unknown' AS availability FROM listing LEFT JOIN part ON p_partkey = listing.id")
def d17_sparse_refresh(s, d):
    prior = load(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return listing(s, d).join(prior, "id", "left").select("id", F.coalesce("p_name", "description").alias("description"), F.coalesce("p_type", "url").alias("url"), F.lit("unknown").alias("availability"))


@query(V("listing") + "SELECT listing.id, title, CASE WHEN length(p_name) >= 9 THEN p_name ELSE description END AS description FROM listing LEFT JOIN part ON p_partkey = listing.id")
def d19_detail_enrichment(s, d):
    detail = load(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return listing(s, d).join(detail, "id", "left").select("id", "title", F.when(F.length("p_name") >= 9, F.col("p_name")).otherwise(F.col("description")).alias("description"))


# ---- matching

P = match.Preferences()
_TERM = "CASE WHEN term IS NOT NULL AND year IS NOT NULL THEN CASE WHEN lower(term) || ':' || year IN ('summer:2027', 'fall:2027') THEN 30 ELSE 0 END WHEN lower(term) IN ('summer', 'fall') OR year IN ('2027') THEN 14 ELSE 0 END"
_PLACE = "greatest(CASE WHEN region = 'AMERICA' AND nation = 'NATION_1' THEN 30 WHEN region = 'AMERICA' THEN 20 ELSE 0 END, CASE WHEN remote = 'remote' THEN 24 ELSE 0 END)"
_STATE = "CASE WHEN term IS NULL THEN 'unknown' WHEN lower(term) IN ('summer', 'fall') THEN 'pass' ELSE 'fail' END AS c1, CASE WHEN region = 'AMERICA' OR remote = 'remote' THEN 'pass' ELSE 'fail' END AS c2, CASE WHEN contains(description, 'No visa sponsorship') THEN 'fail' WHEN contains(description, 'Employer sponsorship is available') THEN 'pass' ELSE 'unknown' END AS c3"
_ELIG = V("listing") + f", e AS (SELECT *, {_STATE} FROM listing), f AS (SELECT *, CASE WHEN 'fail' IN (c1, c2, c3) THEN 'not_eligible' WHEN 'unknown' NOT IN (c1, c2, c3) THEN 'eligible' ELSE 'likely_eligible' END AS status FROM e) "


def _states():
    term = match.criterion(F.col("term").isNotNull(), F.lower("term").isin("summer", "fall"))
    place = match.criterion(F.lit(True), (F.col("region") == "AMERICA") | (F.col("remote") == "remote"))
    offer = sponsorship.state(F.col("description"))
    return F.array(term, place, match.criterion(offer.isin("available", "unavailable"), offer == "available", offer == "conflict"))


@query(_ELIG + "SELECT id, c1 AS term, c2 AS place, c3 AS sponsorship FROM f")
def e1_criteria(s, d):
    states = _states()
    return listing(s, d).select("id", states[0].alias("term"), states[1].alias("place"), states[2].alias("sponsorship"))


@query(_ELIG + "SELECT id, status FROM f")
def e2_eligibility(s, d):
    return listing(s, d).select("id", match.eligibility(_states(), F.lit(True)).alias("status"))


_TECH = "least(25, 5 * (CAST(regexp_matches(description, '(?i)\\bpython\\b') AS INT) + CAST(regexp_matches(description, '(?i)\\bsql\\b') AS INT) + CAST(regexp_matches(description, '(?i)\\bpytorch\\b') AS INT)))"
_SOFT = f"CASE WHEN category IN ('machinery', 'building') THEN 12 ELSE 0 END + {_TECH} + CAST(floor(relevance / 10.0 + 0.5) AS INT) + CASE lifecycle WHEN 'NEW' THEN 4 WHEN 'UPDATED' THEN 2 ELSE 0 END"


def _matched(s, d):
    df = listing(s, d, heavy=True).select("*", F.transform(k.technologies(F.col("description")), F.lower).alias("tech"), _states().alias("states"))
    df = df.select("*", match.eligibility(F.col("states"), F.lit(True)).alias("status"))
    points = match.term_points(P, F.lower("term"), F.col("year")) + match.place_points(P, F.col("region"), F.concat_ws("", "nation"), F.col("remote")) + match.soft_points(P, F.col("category"), F.col("tech"), F.col("relevance"), F.col("lifecycle"))
    overlap = F.col("category").isin(*P.categories) | (F.size(F.array_intersect("tech", F.array(*map(F.lit, P.technologies)))) > 0)
    return df.select("id", "relevance", match.total(F.col("status"), points).alias("score"), match.verdict(F.col("status"), overlap, F.array_contains("states", "unknown")).alias("verdict"))


_MATCH = _ELIG + f", g AS (SELECT id, relevance, CAST(CASE WHEN status = 'not_eligible' THEN 0 ELSE least(100, {_TERM} + {_PLACE} + {_SOFT}) END AS INT) AS score, CASE WHEN status = 'not_eligible' THEN 'excluded' WHEN category NOT IN ('machinery', 'building') AND {_TECH} = 0 THEN 'insufficient_fit' WHEN 'unknown' IN (c1, c2, c3) THEN 'recommended_with_uncertainty' ELSE 'recommended' END AS verdict FROM f) "


@query(_MATCH + "SELECT id, score FROM g")
def e3_match_score(s, d):
    return _matched(s, d).select("id", F.col("score").cast("int").alias("score"))


@query(_MATCH + "SELECT id, verdict FROM g")
def e4_match_status(s, d):
    return _matched(s, d).select("id", "verdict")


@query(_MATCH + "SELECT verdict, count(*) AS n, CAST(sum(score) AS BIGINT) AS points FROM g GROUP BY verdict")
def e5_match_diagnostics(s, d):
    return _matched(s, d).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("points"))


@query(_MATCH + "SELECT id, score FROM g ORDER BY score DESC, relevance DESC, id LIMIT 25")
def o14_match_ranking(s, d):
    return _matched(s, d).orderBy(F.desc("score"), F.desc("relevance"), "id").select("id", F.col("score").cast("int").alias("score")).limit(25)


# ---- operations


OPS_NOW = "2024-01-31 12:00:00"
_OK = "completed AND coverage AND NOT stale AND trusted AND NOT suspicious AND status NOT IN ('partial', 'rate_limited', 'parse_error')"
_HEALTH = V("outcome") + f""", w AS (SELECT *, {_OK} AS ok, least(fallbacks, fallback_successes) AS useful, greatest(rate_limits, CASE WHEN status = 'rate_limited' OR http_status = 429 THEN 1 ELSE 0 END) AS limits, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM outcome WHERE NOT excluded),
g AS (SELECT source_id, list(w ORDER BY rn) AS r, list(w ORDER BY rn)[1:24] AS h FROM w GROUP BY source_id),
k AS (SELECT source_id, len(h) AS attempts, len(list_filter(h, lambda x: x.ok)) AS successes, len(list_filter(h, lambda x: NOT x.ok)) AS failures, r[1].settled_at AS last_attempt_at, list_filter(r, lambda x: x.ok)[1].settled_at AS last_success_at, list_filter(r, lambda x: NOT x.ok)[1].settled_at AS last_failure_at,
 list_filter(r, lambda x: x.fallbacks > 0)[1].settled_at AS last_fallback_at, coalesce(list_filter(r, lambda x: x.useful > 0)[1].rn, 1000000) AS helped, r, list_avg(list_transform(list_filter(h, lambda x: x.ok), lambda x: x.inventory)) AS listing_yield, list_avg(list_transform(h, lambda x: x.duration_ms)) AS latency_ms,
 len(h) AS latency_samples, list_sum(list_transform(h, lambda x: x.limits)) AS rate_limit_count, list_sum(list_transform(h, lambda x: x.fallbacks)) AS fallback_count, list_sum(list_transform(h, lambda x: x.useful)) AS fallback_successes,
 len(list_filter(h, lambda x: NOT x.ok AND (x.status = 'partial' OR (x.completed AND NOT x.coverage) OR x.suspicious))) AS partial_count, len(list_filter(h, lambda x: x.stale)) AS stale_count, len(list_filter(h, lambda x: x.suspicious)) AS suspicious_count, r[1].inventory AS last_inventory,
 list_filter(r, lambda x: x.ok)[1].inventory AS trusted_inventory, r[1].status AS last_status, r[1].http_status AS last_http_status, r[1].error AS last_error, r[1].stale AS last_stale, least(len(h), coalesce(list_filter(r, lambda x: x.ok)[1].rn - 1, len(h))) AS consecutive_failures FROM g),
c AS (SELECT *, CASE WHEN consecutive_failures < 3 THEN 0 ELSE CAST(least(86400000, 900000 * pow(2, consecutive_failures - 3)) AS BIGINT) END AS cooldown_ms, coalesce(list_sum(list_transform(list_filter(r, lambda x: x.rn < helped), lambda x: x.fallbacks)), 0) AS fallback_streak FROM k),
hh AS (SELECT source_id, attempts, successes, failures, last_attempt_at, last_success_at, last_failure_at, last_fallback_at, CAST(fallback_streak AS BIGINT) AS fallback_streak, listing_yield, latency_ms, latency_samples, CAST(rate_limit_count AS BIGINT) AS rate_limit_count, CAST(fallback_count AS BIGINT) AS fallback_count,
 CAST(fallback_successes AS BIGINT) AS fallback_successes, partial_count, stale_count, suspicious_count, last_inventory, trusted_inventory, last_status, last_http_status, last_error, consecutive_failures, cooldown_ms, CASE WHEN cooldown_ms > 0 THEN last_failure_at + to_milliseconds(cooldown_ms) END AS cooldown_until,
 coalesce(TIMESTAMP '{OPS_NOW}' < CASE WHEN cooldown_ms > 0 THEN last_failure_at + to_milliseconds(cooldown_ms) END, false) AS cooling_down, last_stale OR CASE WHEN last_success_at IS NULL THEN attempts > 0 ELSE epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(last_success_at) // 1000 > 86400000 END AS is_stale,
 successes / attempts AS success_rate, fallback_count / attempts AS fallback_rate, fallback_successes / nullif(fallback_count, 0) AS fallback_success_rate, partial_count / attempts AS partial_rate, stale_count / attempts AS stale_rate FROM c) """


@query(_HEALTH + "SELECT * FROM hh")
def a18_source_health(s, d):
    return ops.health(outcome(s, d), OPS_NOW)


_GOOD = "completed AND coverage AND NOT stale AND NOT excluded AND trusted"
_FRESH = V("outcome", "crawl") + f""", conf AS (SELECT DISTINCT source_id FROM outcome WHERE source_id % 2 = 0), kn AS (SELECT run_id, source_id, settled_at FROM outcome WHERE {_GOOD} AND source_id % 2 = 0), cov AS (SELECT run_id FROM kn GROUP BY run_id HAVING count(*) >= (SELECT count(*) FROM conf)),
full_ AS (SELECT max(run_id) AS full_run_id, arg_max(coalesce(finished_at, started_at), run_id) AS full_at FROM crawl WHERE status = 'COMPLETED' AND NOT cancelled AND run_id IN (SELECT run_id FROM cov)),
fr AS (SELECT coalesce(full_at, (SELECT max(settled_at) FROM kn)) AS last_crawl_at, full_run_id, (SELECT count(DISTINCT source_id) FROM kn) AS trusted_sources, (SELECT count(*) FROM conf) AS expected_sources FROM full_),
fresh AS (SELECT CASE WHEN epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(last_crawl_at) // 1000 > 86400000 THEN 'stale' WHEN full_run_id IS NOT NULL AND trusted_sources >= expected_sources THEN 'fresh' WHEN trusted_sources > 0 THEN 'partial' ELSE 'unknown' END AS state, last_crawl_at, epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(last_crawl_at) // 1000 AS age_ms, expected_sources, trusted_sources, full_run_id FROM fr) """


def _fresh(s, d):
    o = outcome(s, d)
    return ops.freshness(crawl(s, d), o, configured(o).select("source_id").distinct(), OPS_NOW)


@query(_FRESH + "SELECT * FROM fresh")
def e8_freshness(s, d):
    return _fresh(s, d)


_ANOM = _FRESH + f""", o AS (SELECT *, {_GOOD} AS good, greatest(rate_limits, CASE WHEN status = 'rate_limited' OR http_status = 429 THEN 1 ELSE 0 END) AS limits, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM outcome WHERE source_id % 2 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS gn FROM o WHERE good),
n AS (SELECT o.*, (SELECT min(rn) FROM o p WHERE p.source_id = o.source_id AND p.good) AS fg, (SELECT count(*) FROM o p WHERE p.source_id = o.source_id) AS cnt FROM o WHERE rn = 1),
b AS (SELECT source_id, max(CASE WHEN gn = 1 THEN settled_at END) AS last, max(CASE WHEN gn = 1 THEN inventory END) AS y, avg(CASE WHEN gn > 1 THEN inventory END) AS ym, count(CASE WHEN gn > 1 THEN 1 END) AS ys, median(CASE WHEN gn > 1 THEN duration_ms END) AS dm FROM t GROUP BY source_id),
q AS (SELECT n.source_id, n.run_id, epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(last) // 1000 AS age, coalesce(fg - 1, cnt) AS streak, y, ym, coalesce(ys, 0) AS ys, n.duration_ms AS d, dm, limits, fallbacks AS fb, least(fallbacks, fallback_successes) AS fs FROM n LEFT JOIN b ON b.source_id = n.source_id),
cmp AS (SELECT *, CASE WHEN finished_at >= started_at THEN (epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000) END AS dur, CASE WHEN discovered > 0 THEN skipped / discovered ELSE 0 END AS ratio, row_number() OVER (ORDER BY run_id DESC) AS rn FROM crawl WHERE status = 'COMPLETED' AND NOT cancelled),
z AS (SELECT max(CASE WHEN rn = 1 THEN run_id END) AS id, max(CASE WHEN rn = 1 THEN dur END) AS d, median(CASE WHEN rn > 1 THEN dur END) AS dm, count(CASE WHEN rn > 1 THEN dur END) AS ds, max(CASE WHEN rn = 1 THEN closed END) AS cl, avg(CASE WHEN rn > 1 THEN closed END) AS cm, count(CASE WHEN rn > 1 THEN 1 END) AS k,
 max(CASE WHEN rn = 1 THEN ratio END) AS ra, avg(CASE WHEN rn > 1 THEN ratio END) AS rm, max(CASE WHEN rn = 1 THEN skipped END) AS sk, avg(CASE WHEN rn > 1 THEN discovered END) AS gm, count(*) AS n FROM cmp), run_ AS (SELECT arg_max(run_id, run_id) AS id, arg_max(heartbeat_at, run_id) AS beat, arg_max(started_at, run_id) AS begun FROM crawl WHERE status = 'RUNNING'),
a AS (SELECT 'source' AS scope, run_id, source_id, 'STALE_SOURCE' AS code, 'warning' AS severity, age AS observed, 86400000 AS baseline, 86400000 AS threshold FROM q WHERE coalesce(age > 86400000, true)
 UNION ALL SELECT 'source', run_id, source_id, 'REPEATED_FAILURES', 'warning', streak, NULL, 3 FROM q WHERE streak >= 3 UNION ALL SELECT 'source', run_id, source_id, 'ZERO_YIELD', 'warning', 0, ym, 0 FROM q WHERE ys >= 3 AND ym >= 1 AND y = 0
 UNION ALL SELECT 'source', run_id, source_id, 'LOW_YIELD', 'warning', y, ym, ym * 0.25 FROM q WHERE ys >= 3 AND ym >= 1 AND y > 0 AND y < ym * 0.25 UNION ALL SELECT 'source', run_id, source_id, 'RATE_LIMITED', 'warning', limits, NULL, 1 FROM q WHERE limits > 0
 UNION ALL SELECT 'source', run_id, source_id, 'BROWSER_FALLBACK', CASE WHEN fs > 0 THEN 'info' ELSE 'warning' END, fb, fs, NULL FROM q WHERE fb > 0 UNION ALL SELECT 'source', run_id, source_id, 'SLOW_SOURCE', 'warning', d, dm, greatest(dm * 2, 300000) FROM q WHERE ys >= 3 AND d > greatest(dm * 2, 300000)
 UNION ALL SELECT 'database', (SELECT max(run_id) FROM crawl), NULL, 'WARMUP', 'info', n, 3, 3 FROM z WHERE n < 3 UNION ALL SELECT 'database', full_run_id, NULL, 'STALE_DATABASE', 'warning', age_ms, 86400000, 86400000 FROM fresh WHERE age_ms > 86400000
 UNION ALL SELECT 'run', id, NULL, 'STUCK_RUN', 'critical', greatest(epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(beat) // 1000, epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(begun) // 1000), NULL, 21600000 FROM run_ WHERE epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(beat) // 1000 > 1200000 OR epoch_ms(TIMESTAMP '{OPS_NOW}') - epoch_us(begun) // 1000 > 21600000
 UNION ALL SELECT 'run', id, NULL, 'DURATION_REGRESSION', 'warning', d, dm, greatest(dm * 2, 300000) FROM z WHERE ds >= 3 AND d > greatest(dm * 2, 300000) UNION ALL SELECT 'run', id, NULL, 'CLOSURE_SPIKE', 'warning', cl, cm, greatest(5, cm * 3) FROM z WHERE k >= 3 AND cl >= greatest(5, cm * 3) AND cl > cm
 UNION ALL SELECT 'run', id, NULL, 'DEDUP_DRIFT', 'warning', ra, rm, greatest(rm + 0.2, rm * 2) FROM z WHERE k >= 3 AND ra > greatest(rm + 0.2, rm * 2) AND sk > gm * 0.1) """


@query(_ANOM + "SELECT scope, run_id, source_id, code, severity, CAST(observed AS DOUBLE) AS observed, CAST(baseline AS DOUBLE) AS baseline, CAST(threshold AS DOUBLE) AS threshold FROM a")
def e7_anomalies(s, d):
    o = outcome(s, d)
    found = ops.source_anomalies(o, configured(o).select("source_id").distinct(), OPS_NOW)
    return found.unionByName(ops.run_anomalies(crawl(s, d), o, _fresh(s, d), (F.col("status") == "COMPLETED") & ~F.col("cancelled"), OPS_NOW))


@query(V("run") + "SELECT day FROM (SELECT CAST(settled_at AS DATE) AS day, bool_and(NOT failed OR inventory > 0) AS ok, count(DISTINCT source_id) AS n FROM run GROUP BY 1) WHERE ok AND n >= 5")
def e9_comparable_runs(s, d):
    days = run(s, d).groupBy(F.col("settled_at").cast("date").alias("day")).agg(F.bool_and(~F.col("failed") | (F.col("inventory") > 0)).alias("ok"), F.count_distinct("source_id").alias("n"))
    return days.filter("ok and n >= 5").select("day")


@query(V("run") + "SELECT source_id, CASE WHEN dm IS NULL THEN NULL WHEN d > dm * 1.1 THEN 'up' WHEN d < dm * 0.9 THEN 'down' ELSE 'steady' END AS trend FROM (SELECT source_id, max(CASE WHEN rn = 1 THEN duration_ms END) AS d, median(CASE WHEN rn > 1 THEN duration_ms END) AS dm FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM run) GROUP BY source_id)")
def e10_duration_trend(s, d):
    return win.latest_and_rest(run(s, d), "source_id", "run_id", "duration_ms").select("source_id", ops.trend(F.col("latest"), F.col("median")).alias("trend"))


@query(_HEALTH + "SELECT source_id, cooling_down AS is_open, fallback_streak >= 4 AND coalesce(fallback_success_rate, 0) = 0 AS suppressed FROM hh")
def e11_circuit(s, d):
    """A source is left alone while it cools down, and without a browser where that has not helped for long."""
    h = ops.health(outcome(s, d), OPS_NOW)
    return h.select("source_id", F.col("cooling_down").alias("is_open"), ((F.col("fallback_streak") >= 4) & (F.coalesce("fallback_success_rate", F.lit(0.0)) == 0)).alias("suppressed"))


@query(V("run") + "SELECT run_id, CASE WHEN trusted THEN inventory END AS inventory, CASE WHEN failed THEN 'failed' WHEN trusted AND inventory = 0 THEN 'empty' WHEN trusted THEN 'trusted' ELSE 'partial' END AS status FROM run")
def e12_trusted_inventory(s, d):
    t = F.col("trusted")
    status = F.when(F.col("failed"), "failed").when(t & (F.col("inventory") == 0), "empty").when(t, "trusted").otherwise("partial")
    return run(s, d).select("run_id", F.when(t, F.col("inventory")).alias("inventory"), status.alias("status"))


@query(V("listing") + f"SELECT id, first_seen FROM listing WHERE first_seen > TIMESTAMP '{NOW}' - INTERVAL 3 DAYS AND first_seen <= TIMESTAMP '{NOW}'")
def e13_today(s, d):
    since = F.coalesce(ts("2001-07-29 12:00:00"), ts(NOW) - F.expr("INTERVAL 7 DAYS"))
    return listing(s, d).filter((F.col("first_seen") > since) & (F.col("first_seen") <= ts(NOW))).select("id", "first_seen")


@query(V("listing") + "SELECT stage, count(*) AS n, CAST(count_if(event_type = 'purchase') AS BIGINT) AS offers FROM listing LEFT JOIN events ON event_id = id AND event_type <> 'view' GROUP BY stage")
def e14_application_tracker(s, d):
    actions = load(s, d, "events").filter("event_type <> 'view'").select(F.col("event_id").alias("id"), "event_type")
    return listing(s, d).join(actions, "id", "left").groupBy("stage").agg(F.count("*").alias("n"), agg.count_where(F.col("event_type") == "purchase").alias("offers"))


@query(V("listing") + "SELECT count(*) AS total, CAST(count_if(availability = 'open') AS BIGINT) AS open, CAST(count_if(lifecycle = 'NEW') AS BIGINT) AS new, CAST(count_if(lifecycle = 'UPDATED') AS BIGINT) AS updated FROM listing")
def e15_feed_stats(s, d):
    return listing(s, d).agg(F.count("*").alias("total"), agg.count_where(F.col("availability") == "open").alias("open"), agg.count_where(F.col("lifecycle") == "NEW").alias("new"), agg.count_where(F.col("lifecycle") == "UPDATED").alias("updated"))


# ---- incremental runs


@query("SELECT l_orderkey AS id, l_suppkey AS source_id, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey, l_suppkey")
def x3_sightings(s, d):
    rows = load(s, d, "lineitem").select(F.lit(1).alias("run_id"), F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("identity"), F.col("l_linenumber").alias("seq"))
    return stream.distinct_sightings(rows).select(F.col("identity").alias("id"), "source_id", F.col("seq").alias("first_line"))


@query(V("listing") + "SELECT id, CASE WHEN id % 7 = 0 THEN 'new' WHEN id % 7 = 1 THEN 'retryable' WHEN id % 2 = 0 AND availability = 'open' THEN 'unchanged' ELSE 'possibly_changed' END AS change FROM listing")
def x4_change_class(s, d):
    df = listing(s, d).select("id", "availability", F.lit("h").alias("hash")).alias("n")
    old = listing(s, d).filter("id % 7 <> 0").select(F.col("id").alias("old_id"), F.when(F.col("id") % 2 == 0, "h").otherwise("other").alias("hash")).alias("o")
    j = df.join(old, F.col("id") == F.col("old_id"), "left")
    state = stream.changed(F.col("old_id").isNotNull(), stream.validators_match("n", "o", "hash"), F.col("availability") == "open", F.col("id") % 7 == 1)
    return j.select("id", state.alias("change"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 15 MINUTES, ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x6_tumbling_bucket(s, d):
    return stream.tumbling(load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@query(V("run") + f"SELECT run_id, CASE WHEN outcome = 'click' AND settled_at < TIMESTAMP '{CUT}' - INTERVAL 20 MINUTES THEN 'FAILED' WHEN outcome = 'click' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM run")
def x7_stale_runs(s, d):
    status = F.when(F.col("outcome") == "click", "RUNNING").otherwise("COMPLETED")
    return run(s, d).select("run_id", stream.lapsed(status, F.col("settled_at"), ts(CUT)).alias("status"))


@query("SELECT start_ms, user_id, n, n - 2 AS over FROM (SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, user_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 2")
def x8_rate_limit(s, d):
    return stream.rate_limited(load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", 2, "1 day")


@query("SELECT source_id, run_id, attempt FROM (SELECT user_id AS source_id, event_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS attempt FROM events WHERE event_type = 'error') WHERE attempt <= 2")
def x10_retry_pass(s, d):
    from pyspark.sql import Window as W

    failed = run(s, d).filter("failed").select("source_id", "run_id", F.row_number().over(W.partitionBy("source_id").orderBy("run_id")).alias("attempt"))
    return failed.filter("attempt <= 2")

