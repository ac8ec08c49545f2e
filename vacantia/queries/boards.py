"""Boards and their caches, action identities, merges of sources, re-derivation, tabs and run states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as k
from ..functions import dates, places, text, urls
from ..operators import identity as ident
from ..operators import relations as rel
from ..operators.stage import stored
from ..sources import boards
from ..sources.tables import account, crawl, listing, load
from ..sources.tables import sql_views as V
from .more import PLACES, _case
from .plans import _APART, _REC, _records
from .registry import query
from .texts import _IS, _sql_says

# ---- boards

_BODY = "This internship lets you learn a trade. You work with a team of people on real products, and you are paid for it."
_SYSTEM = "CASE id % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'ashby' WHEN 4 THEN 'bytedance' WHEN 5 THEN 'oracle' END"


def _ats_pages(s, d):
    """Pages of six systems, with elements of one name inside each other, and of none; every eleventh is too short to be a posting."""
    m, name, html = F.col("id") % 7, F.regexp_replace("company", "#", "-"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and p[:1] in "<\n" else p for p in parts])
    short = F.col("id") % 11 == 0
    body = F.when(short, "<div>Short internship.</div>").otherwise(html("<div><div>Who we are.</div></div><p>", F.lit(_BODY), "</p><nav>Menu</nav><ul><li>", "availability", "</li></ul><div>", "region", "</div>"))
    page = {
        0: html('<header><h1>Careers</h1></header><h1 class="big app-title">', "title", '</h1><div class="company-name"><span>', "company", '</span></div><div class="location">', "location", '</div><div id="content">', body, '</div><a href="/apply/1">Apply Now</a>'),
        1: html('<div class="posting-headline"><h2>', "title", '</h2></div><div class="posting-categories"><div class="location">', "location", '</div></div><div class="posting-page">', body, "</div>"),
        2: html("<div data-automation-id='jobPostingHeader'><h2>", "title", "</h2></div><div data-automation-id=\"locations\"><div>", "location", '</div></div><div data-automation-id="company">', "company", '</div><div data-automation-id="jobPostingDescription">', body, "</div><div data-automation-id=postedOn>Posted 3 Days Ago</div>"),
        3: html('<h1 data-testid="job-title">', "title", '</h1><div data-testid="job-location">', "location", '</div><div data-testid="company-name">', "company", '</div><div data-testid="job-description">', body, "</div>"),
    }
    text = F.when(short, "Short internship.").otherwise(html(F.lit(_BODY), "\n", "availability", "\n", "region"))
    lines = {
        4: html("\n", F.lit("Life"), "\n", "title", "\nLocation:\n", "location", "\nJob Code:\n", html(F.lit("A"), F.col("id").cast("string")), "\nResponsibilities\n", text, "\nAbout Us\nWe make things."),
        5: html("\nView More Jobs\n", "title", "\nTRENDING\nJOB INFORMATION\nJob Identification\n", F.col("id").cast("string"), "\nPosting Date\n08/11/2026\nLocations\n", "location", "\nJob Schedule\nFull time\nJOB DESCRIPTION\n", text, "\nABOUT US\nWe make things."),
    }
    laid = lambda c: html("<div>", F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit("<div>"), x, F.lit("</div>"))), ""), "</div>")
    page |= {k: laid(c) for k, c in lines.items()} | {6: html("<h1>", "title", "</h1>", body)}
    host = {0: html(F.lit("https://boards.greenhouse.io/"), name), 1: html(F.lit("https://jobs.lever.co/"), name), 2: F.lit("https://acme.wd5.myworkdayjobs.com/en"), 3: html(F.lit("https://jobs.ashbyhq.com/"), name), 4: F.lit("https://joinbytedance.com/search"), 5: F.lit("https://acme.fa.us6.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1"), 6: F.lit("https://example.org")}
    pick = lambda of: F.coalesce(*[F.when(m == k, c) for k, c in of.items()])
    heading = F.when(m == 5, html(F.lit("<title>"), "title", F.lit(" - "), "company", F.lit(" Careers</title>"))).otherwise("")
    return listing(s, d, heavy=True).select(F.col("id").alias("page_id"), F.concat(pick(host), F.lit("/jobs/"), F.col("id") + 100000).alias("url"), html("<html><head>", heading, "</head><body>", pick(page), "</body></html>").alias("html"))


@query(V("listing") + f"""SELECT id AS page_id, {_SYSTEM} AS provider, title, CASE id % 7 WHEN 1 THEN replace(replace(company, '#', ' '), '-', ' ') WHEN 4 THEN 'ByteDance' ELSE company END AS company, location AS locations,
 CASE WHEN id % 7 IN (4, 5) THEN '' ELSE 'Who we are.' || chr(10) END || '{_BODY}' || chr(10) || CASE WHEN id % 7 IN (4, 5) THEN '' ELSE '• ' END || availability || chr(10) || region AS description, CASE id % 7 WHEN 4 THEN 'A' || id WHEN 5 THEN CAST(id AS VARCHAR) ELSE CAST(id + 100000 AS VARCHAR) END AS job_id,
 CASE id % 7 WHEN 2 THEN 'Posted 3 Days Ago' WHEN 5 THEN '08/11/2026' END AS posted, CASE id % 7 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'acme.wd5.myworkdayjobs.com' WHEN 3 THEN 'jobs.ashbyhq.com' WHEN 4 THEN 'joinbytedance.com' ELSE 'acme.fa.us6.oraclecloud.com' END AS form_host,
 CASE id % 7 WHEN 0 THEN '1' WHEN 1 THEN 'apply' WHEN 3 THEN 'application' ELSE CAST(id + 100000 AS VARCHAR) END AS form_end FROM listing WHERE id % 7 < 6 AND id % 11 <> 0""")
def s11_ats_pages(s, d):
    df = boards.ats_postings(_ats_pages(s, d))
    return df.select("page_id", "provider", "title", "company", F.array_join("locations", "|").alias("locations"), "description", "job_id", "posted", urls.host(F.col("application_url")).alias("form_host"), F.substring_index("application_url", "/", -1).alias("form_end"))


@query(V("listing") + """SELECT company_id AS source, CASE company_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS provider, CAST(id AS VARCHAR) AS job_id, title, CASE WHEN company_id % 3 = 0 THEN location ELSE location || '|' || region END AS locations, url, CAST(epoch_ms(posted_at) AS VARCHAR) AS posted FROM listing WHERE id % 11 <> 0""")
def s12_ats_feed(s, d):
    """One feed a company in its system's shape; a broken body for every eleventh listing."""
    ms = dates.millis(F.col("posted_at"))
    df = listing(s, d).select("company_id", (F.col("id") % 11 == 0).alias("broken"), "id", "title", "url", "location", "region", ms.alias("ms"))
    green = F.struct("id", "title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.col("ms").cast("string").alias("updated_at"))
    lever = F.struct(F.col("id").cast("string").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct("location", F.array("location", "region").alias("allLocations")).alias("categories"), F.col("ms").alias("createdAt"))
    ashby = F.struct(F.col("id").cast("string").alias("id"), "title", F.col("url").alias("jobUrl"), "location", F.array(F.struct(F.col("region").alias("location"))).alias("secondaryLocations"), F.col("ms").cast("string").alias("publishedAt"))
    by = df.groupBy("company_id", "broken").agg(F.to_json(F.struct(F.collect_list(green).alias("jobs"))).alias("g"), F.to_json(F.collect_list(lever)).alias("l"), F.to_json(F.struct(F.collect_list(ashby).alias("jobs"))).alias("a"))
    m = F.col("company_id") % 3
    feeds = by.select(F.col("company_id").alias("source"), F.when(m == 0, "greenhouse").when(m == 1, "lever").otherwise("ashby").alias("provider"), F.when(F.col("broken"), "{not json").when(m == 0, F.col("g")).when(m == 1, F.col("l")).otherwise(F.col("a")).alias("body"))
    return boards.feed_jobs(feeds).select("source", "provider", "job_id", "title", F.array_join("locations", "|").alias("locations"), "url", "posted")


@query("""WITH p AS (SELECT l_suppkey AS k, l_linenumber AS page, list(l_orderkey) AS r, min(l_orderkey) AS lo FROM lineitem GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page) AS n FROM p), e AS (SELECT k, coalesce(min(CASE WHEN page <> n OR k % 4 = page % 4 AND page > 2 THEN n END), 1000) AS stop FROM q GROUP BY k)
SELECT q.k AS category, page, unnest(r) AS id FROM q JOIN e ON e.k = q.k WHERE n < stop""")
def s13_paged_feed(s, d):
    """A supplier's lines as pages of a category; some pages are empty, and what follows them is not read."""
    rows = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("category"), F.col("l_linenumber").alias("page")).agg(F.collect_list("l_orderkey").alias("rows"))
    empty = (F.col("category") % 4 == F.col("page") % 4) & (F.col("page") > 2)
    return boards.paged_rows(rows.withColumn("rows", F.when(~empty, F.col("rows"))), "category").select("category", "page", F.col("row").alias("id"))


@query("SELECT o_custkey AS id, 'https://x.example/' || CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS changed FROM orders")
def s13_sitemap(s, d):
    entry = F.concat(F.lit("<url><loc> https://x.example/"), "o_orderkey", F.lit(" </loc>"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("\n<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    maps = load(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.collect_list(entry), "\n").alias("xml"))
    return maps.select("id", F.explode(boards.sitemap(F.col("xml"))).alias("e")).select("id", "e.url", "e.changed")


@query("""WITH f AS (SELECT source AS repository, 'd' || lpad(CAST(doc_id % 13 AS VARCHAR), 2, '0') AS folder, doc_id, text FROM documents), x AS (SELECT *, dense_rank() OVER (PARTITION BY repository ORDER BY folder) AS n FROM f WHERE doc_id % 13 > 0 AND doc_id % 5 > 0 AND doc_id % 10 <> 9 AND text IS NOT NULL AND text <> ''),
a AS (SELECT repository, folder || '/' || doc_id || '.md' AS path, text FROM x WHERE n <= 8 UNION ALL SELECT repository, doc_id || '.md', text FROM f WHERE doc_id % 13 = 0 AND doc_id % 5 > 0 AND doc_id % 10 <> 9 AND text IS NOT NULL AND text <> '')
SELECT repository, path, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines FROM a""")
def s16_repository_text(s, d):
    """Documents as files of repositories: some no Markdown, some only as raw files, some without either."""
    i = F.col("doc_id")
    folder = F.when(i % 13 > 0, F.concat(F.lit("d"), F.lpad((i % 13).cast("string"), 2, "0"), F.lit("/"))).otherwise("")
    path = F.concat(folder, i.cast("string"), F.when(i % 5 == 0, ".txt").otherwise(".md"))
    full = F.nullif(F.col("text"), F.lit(""))
    files = load(s, d, "documents").select(F.col("source").alias("repository"), path.alias("path"), F.when(i % 2 == 0, full).otherwise("").alias("content"), F.when((i % 2 == 1) & (i % 10 != 9), full).alias("raw"))
    return boards.repository_files(files).select("repository", "path", F.size(F.split("text", "\n")).alias("n_lines"))


@query("""WITH p AS (SELECT o_custkey AS site, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders) SELECT site, 'https://b.example/' || kind || '/' || id || '-' || n AS url FROM p, (SELECT unnest(['jobs', 'position', 'jobs']) AS kind, unnest([0, 2, 3]) AS n) WHERE page <= 3""")
def s17_board_links(s, d):
    """List pages with links to postings (the fourth is beyond the bound) and to other pages."""
    from pyspark.sql import Window as W

    kinds = [("jobs", 0), ("about", 1), ("position", 2), ("jobs", 3), ("jobs", 4)]
    html = F.concat(*[F.concat(F.lit(f"<a class=x href='https://b.example/{kind}/"), F.col("o_orderkey").cast("string"), F.lit(f"-{n}'>x</a>")) for kind, n in kinds], F.lit("<a href=/jobs>all</a>"))
    pages = load(s, d, "orders").select(F.col("o_custkey").alias("site"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), html.alias("html"))
    return boards.board_links(pages, 3, 3)


@query(V("listing") + """SELECT 'board-' || p_partkey AS key, p_name AS company, 'Intern ' || p_type AS title, CASE WHEN p_size % 3 = 0 THEN 'remote' ELSE 'unknown' END AS remote, 'open' AS availability, 'board' AS origin FROM part UNION ALL SELECT 'stored-' || id, company, title, remote, availability, 'stored' FROM listing""")
def s18_second_source(s, d):
    """A board's JSON mapped to listings and joined to the stored ones."""
    body = F.to_json(F.struct(F.col("p_partkey").alias("_id"), F.struct(F.col("p_name").alias("name")).alias("company"), F.concat(F.lit(" Intern "), "p_type").alias("role"), (F.col("p_size") % 3 == 0).alias("remote"), F.lit(True).alias("active")))
    job = F.from_json(body, "struct<_id:bigint,company:struct<name:string>,role:string,remote:boolean,active:boolean>")
    board = load(s, d, "part").select(job.alias("j")).filter("j.active").select(F.concat(F.lit("board-"), F.col("j._id").cast("string")).alias("key"), F.col("j.company.name").alias("company"), text.one_line(F.col("j.role")).alias("title"), F.when(F.col("j.remote"), "remote").otherwise("unknown").alias("remote"), F.lit("open").alias("availability"), F.lit("board").alias("origin"))
    own = listing(s, d).select(F.concat(F.lit("stored-"), F.col("id").cast("string")).alias("key"), "company", "title", "remote", "availability", F.lit("stored").alias("origin"))
    return rel.union_all(board, own)


@query("""SELECT event_id, 'https://x.example/e/' || event_id AS url, 200 AS status, event_type AS title, event_type || chr(10) || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS text FROM events WHERE event_id % 10 <> 3""")
def s19_json_snapshot(s, d):
    """Structured JSON as the snapshot of a page: link, status, title, and all text of the value, line by line; malformed bodies give none."""
    body = F.when(F.col("event_id") % 10 == 3, "{oops").otherwise(F.to_json(F.struct(F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("title"), F.struct(F.get_json_object("props", "$.k").alias("k")).alias("more"))))
    v = F.from_json(body, "struct<url:string,title:string,more:struct<k:string>>")
    df = load(s, d, "events").select("event_id", v.alias("v")).filter("v.url is not null")
    return df.select("event_id", F.concat(F.lit("https://x.example"), "v.url").alias("url"), F.lit(200).alias("status"), "v.title", F.concat_ws("\n", "v.title", "v.more.k").alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 AND value <= 20 THEN 'hit' WHEN user_id % 9 = 0 THEN CASE WHEN event_id % 3 > 0 THEN 'stale' ELSE 'failed' END WHEN event_type = 'error' THEN CASE WHEN event_id % 3 > 0 THEN 'stale' ELSE 'failed' END
 WHEN event_id % 3 > 0 AND (event_type = 'view' OR (event_id % 4 = 1 AND event_type IN ('click', 'signup'))) THEN 'revalidated' WHEN event_type IN ('click', 'signup') THEN 'stored' ELSE 'failed' END AS outcome FROM events""")
def s20_cache_state(s, d):
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 304).when(F.col("event_type") == "purchase", 404).otherwise(200)
    outcome = boards.cached(F.col("event_id") % 3 > 0, F.col("value") * 1000, 20_000, F.col("event_id") % 4 == 1, status, F.col("user_id") % 9 == 0)
    return load(s, d, "events").select("event_id", outcome.alias("outcome"))


# ---- identities of actions, merges of sources, re-derivation


@query(_REC + f"""SELECT a.id, b.id AS stored FROM rec a JOIN rec b ON a.c = b.c AND a.id % 5 <> 0 AND b.id % 5 = 0 WHERE list_has_any(a.urls, b.urls) OR (a.provider = b.provider AND list_has_any(a.ids, b.ids)) OR (a.role = b.role AND a.place = b.place AND NOT {_APART.format(a='a', b='b')})""")
def j9_identity_with_guard(s, d):
    """Candidates that a stored action covers: by a shared identity key; a role's key is vetoed by different direct requisitions, links and providers' ids are not."""
    df = stored(ident.described(_records(s, d)).select("id", "direct", ident.keys().alias("keys"))).select("id", "direct", F.explode("keys").alias("key"))
    a, b = df.filter("id % 5 <> 0").alias("a"), df.filter("id % 5 = 0").alias("b")
    sure = F.startswith("a.key", F.lit("url:")) | F.startswith("a.key", F.lit("provider-job:"))
    apart = (F.size("a.direct") > 0) & (F.size("b.direct") > 0) & ~F.arrays_overlap("a.direct", "b.direct")
    return a.join(b, F.col("a.key") == F.col("b.key")).filter(sure | ~apart).select(F.col("a.id").alias("id"), F.col("b.id").alias("stored")).distinct()


@query(_REC + """SELECT id, unnest(list_sort(list_distinct(list_concat(['role:' || c || '|' || role || '|' || place, 'role-city:' || c || '|' || role || '|' || place, 'role-location:' || c || '|' || role || '|' || place], list_transform(ids, lambda x: 'provider-job:' || provider || '|' || c || '|' || x),
 CASE id % 4 WHEN 0 THEN ['url:https://boards.greenhouse.io/' || c || '/jobs/' || n] WHEN 1 THEN ['url:https://jobs.lever.co/' || c || '/' || n, 'url:https://jobs.lever.co/' || c || '/' || n || '/apply'] WHEN 2 THEN list_filter(['url:https://jobright.ai/info/z' || id || 'z', CASE WHEN id % 8 = 2 THEN 'url:https://boards.greenhouse.io/' || c || '/jobs/' || n END], lambda x: x IS NOT NULL) ELSE ['url:https://www.careers.example.com/jobs/' || n || '?team=' || c] END,
 list_transform(list_filter([jid], lambda x: x IS NOT NULL), lambda x: 'job:' || c || '|' || x), list_transform(list_filter([nid], lambda x: x IS NOT NULL), lambda x: 'embedded:' || c || '|' || x))))) AS key FROM rec""")
def d14_action_identities(s, d):
    """Every alias of a listing that an action on it covers: links, role with all, one and the raw places, providers' requisitions, its own job id and ids embedded in links."""
    df = ident.described(_records(s, d))
    return df.select("id", F.explode(ident.action_keys()).alias("key"))


@query(_REC + f""", st AS (SELECT * FROM rec WHERE id % 4 <> 2), bo AS (SELECT * FROM rec WHERE id % 4 = 2), hit AS (SELECT b.id, min(a.id) AS home FROM bo b JOIN st a ON a.c = b.c WHERE list_has_any(a.urls, b.urls) OR (list_has_any(a.ids, b.ids) AND (a.provider = b.provider OR (a.role = b.role AND a.place = b.place))) OR (a.role = b.role AND a.place = b.place AND NOT {_APART.format(a='a', b='b')}) GROUP BY b.id)
SELECT st.id, CASE WHEN count(hit.id) > 0 THEN 'board,stored' ELSE 'stored' END AS sources, CAST(count(hit.id) AS BIGINT) AS taken, 0 AS part FROM st LEFT JOIN hit ON hit.home = st.id GROUP BY st.id UNION ALL SELECT id, 'board', 0, 1 FROM bo WHERE id NOT IN (SELECT id FROM hit)""")
def u4_board_merge(s, d):
    """Stored listings, then those of a board that none of them is; a stored one that the board has too names both sources."""
    df = stored(ident.described(_records(s, d)))
    own, board = df.filter("id % 4 <> 2"), df.filter("id % 4 = 2")
    pairs = ident.matches(own.unionByName(board)).select(F.col("id").alias("a"), F.col("other").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = both.join(board.select(F.col("id").alias("b")), "b").join(own.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("home"))
    count = hit.groupBy(F.col("home").alias("id")).agg(F.count("*").alias("taken"))
    first = own.select("id").join(count, "id", "left").select("id", F.when(F.col("taken") > 0, "board,stored").otherwise("stored").alias("sources"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.lit(0).alias("part"))
    left = board.select("id").join(hit.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.lit("board").alias("sources"), F.lit(0).cast("bigint").alias("taken"), F.lit(1).alias("part"))
    return first.unionByName(left)


_KEYS18 = "list_concat(['p|' || c || '|' || role || '|' || urls[1]], list_transform(list_filter([jid], lambda x: x IS NOT NULL), lambda x: 'i|' || c || '|' || role || '|' || x))"


@query(_REC + f""", m AS (SELECT *, {_KEYS18} AS ks, description = '' OR starts_with(description, 'Accounts') AS empty_ FROM rec), kk AS (SELECT unnest(ks) AS k, description, id FROM m WHERE NOT empty_), best AS (SELECT k, max(length(description)) AS n FROM kk GROUP BY k),
t AS (SELECT m.id, max(best.n) AS n FROM m JOIN best ON list_contains(m.ks, best.k) GROUP BY m.id) SELECT m.id, CASE WHEN t.n IS NULL THEN length(description) WHEN empty_ OR t.n > length(description) THEN t.n ELSE length(description) END AS n_description FROM m LEFT JOIN t ON t.id = m.id""".replace("JOIN best ON list_contains(m.ks, best.k)", "JOIN (SELECT id AS i, unnest(ks) AS k FROM m) u ON u.i = m.id JOIN best ON best.k = u.k"))
def d18_richest_description(s, d):
    """The longest real description seen for the same posting or requisition of the role; a placeholder always gives way."""
    df = stored(ident.described(_records(s, d)).select("id", "description", "company_key", "title_key", "urls", F.lower("job_id").alias("jid")))
    role = lambda kind, c: F.concat_ws("|", F.lit(kind), "company_key", "title_key", c)
    keys = F.array_compact(F.array(F.when(F.size("urls") > 0, role("p", F.try_element_at("urls", F.lit(1)))), F.when(F.col("jid").isNotNull(), role("i", F.col("jid")))))
    placeholder = (F.trim("description") == "") | F.startswith("description", F.lit("Accounts"))
    keyed = df.select("id", "description", placeholder.alias("empty"), F.explode(keys).alias("k"))
    best = keyed.filter("not empty").groupBy("k").agg(F.max_by("description", F.length("description")).alias("best"))
    found = keyed.select("id", "k").join(best, "k").groupBy("id").agg(F.max_by("best", F.length("best")).alias("best"))
    out = df.join(found, "id", "left")
    taken = F.when(F.col("best").isNotNull() & (placeholder | (F.length("best") > F.length("description"))), F.col("best")).otherwise(F.col("description"))
    return out.select("id", F.length(taken).alias("n_description"))


_EVERY_TECHNOLOGY = ", ".join(f"CASE WHEN {_sql_says('description', p)} THEN '{n}' END" for n, p in k.TECHNOLOGIES.items())


@query(V("listing") + f"""SELECT id, list_sort(list_distinct(list_concat(prior, fresh))) AS facts, score FROM (SELECT id, CASE WHEN id % 3 = 0 THEN ['Legacy'] ELSE [] END AS prior, list_filter([{_EVERY_TECHNOLOGY}], lambda x: x IS NOT NULL) AS fresh,
 CASE WHEN {_IS} THEN 1 ELSE 0 END AS score, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS was FROM listing) WHERE score <> was OR len(list_filter(fresh, lambda x: NOT list_contains(prior, x))) > 0""")
def d20_rederived(s, d):
    """Stored rows classified anew: old and new facts joined; only rows whose payload changes are returned."""
    prior = F.when(F.col("id") % 3 == 0, F.array(F.lit("Legacy"))).otherwise(F.array().cast("array<string>"))
    df = listing(s, d, heavy=True).select("id", prior.alias("prior"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("was"), k.technologies(F.col("description")).alias("fresh"), k.is_placement(F.col("title"), F.col("description")).cast("int").alias("score"))
    df = df.select("*", F.array_sort(F.array_union("prior", "fresh")).alias("facts"))
    digest = lambda facts, score: F.xxhash64(facts, score)
    return df.filter(digest(F.col("facts"), F.col("score")) != digest(F.array_sort("prior"), F.col("was"))).select("id", "facts", "score")


# ---- tabs, reports, runs, accounts, changes

_CA = f"({_case(4)} = 'canada' OR coalesce({_case(3)} = 'Canada', false))".replace("o_orderkey", "id")


@query(V("listing") + f"""SELECT id, CASE WHEN q THEN 'quant' ELSE concat_ws(',', 'main', CASE WHEN {_CA} THEN 'canada' END, CASE WHEN p AND summer THEN 'summer' END, CASE WHEN p THEN 'internship' ELSE 'non-intern' END) END AS tabs
 FROM (SELECT *, regexp_matches(title, '(?i)\\b(?:quant|quantitative|trade|trader|trading)\\b') OR category = 'furniture' AS q, {_IS} AS p, regexp_matches(concat_ws(chr(10), title, description, term), '(?i)\\bsummer\\b') AS summer FROM listing)""")
def f15_tabs(s, d):
    """All tabs of a listing: those of quantitative roles are in that tab alone."""
    raw = F.element_at(F.array(*[F.lit(p[0]) for p in PLACES]), (F.col("id") % len(PLACES) + 1).cast("int"))
    t, b = F.col("title"), F.col("description")
    df = listing(s, d, heavy=True).select("id", "category", t, k.is_placement(t, b).alias("p"), places.parsed(raw).alias("place"), F.array_contains(dates.seasons(F.concat_ws("\n", t, b, "term")), "summer").alias("summer"))
    quant = k.says(t, r"\b(?:quant|quantitative|trade|trader|trading)\b") | (F.col("category") == "furniture")
    canada = F.coalesce(F.col("place.scope") == "canada", F.lit(False)) | F.coalesce(F.col("place.country") == "Canada", F.lit(False))
    tabs = F.concat_ws(",", F.lit("main"), F.when(canada, "canada"), F.when(F.col("p") & F.col("summer"), "summer"), F.when(F.col("p"), "internship").otherwise("non-intern"))
    return df.select("id", F.when(quant, "quant").otherwise(tabs).alias("tabs"))


@query(V("listing") + f"""SELECT id FROM listing WHERE availability = 'open' AND relevance >= 60 AND NOT regexp_matches(title, '(?i)\\bph\\.?\\s*d|new grad') AND NOT (contains(title, '2026') AND NOT contains(title, '2027')) AND NOT contains(title, '12 months')
 AND (NOT contains(url, 'linkedin.com/') OR id % 4 = 0) AND ({_case(4).replace('o_orderkey', 'id')} IS NOT NULL OR coalesce({_case(3).replace('o_orderkey', 'id')} IN ('Canada', 'United States'), false))""")
def f24_report_filter(s, d):
    """What the final report shows: open, of the least score, with an allowed title, a checked link where one is needed, and an allowed place."""
    raw = F.element_at(F.array(*[F.lit(p[0]) for p in PLACES]), (F.col("id") % len(PLACES) + 1).cast("int"))
    linked = ~urls.is_under(urls.host(F.col("url")), ["linkedin.com"]) | (F.col("id") % 4 == 0)
    ok = (F.col("availability") == "open") & (F.col("relevance") >= 60) & k.excluded_title(F.col("title")).isNull() & linked & F.coalesce(places.allowed(F.array(places.parsed(raw)), F.lit("unknown")), F.lit(False))
    return listing(s, d).filter(ok).select("id")


_ERRORS = ["Terminated by user.", "Out of memory", "run was TERMINATED BY USER at 12:00", ""]


@query(V("crawl") + f"SELECT run_id, CASE WHEN status = 'FAILED' AND run_id % 4 IN (0, 2) THEN 'TERMINATED' WHEN status = 'RUNNING' AND heartbeat_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 20 MINUTES THEN 'IDLE' ELSE status END AS shown FROM crawl")
def f28_run_status(s, d):
    """A failed run that a user ended shows as terminated; one that says it runs but has no fresh heartbeat as idle."""
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("run_id") % len(_ERRORS) + 1).cast("int"))
    old = F.col("heartbeat_at") < F.lit("2024-01-31 12:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 20 MINUTES")
    shown = F.when((F.col("status") == "FAILED") & k.says(message, "terminated by user"), "TERMINATED").when((F.col("status") == "RUNNING") & old, "IDLE").otherwise(F.col("status"))
    return crawl(s, d).select("run_id", shown.alias("shown"))


@query(V("account") + """, r AS (SELECT unnest([7, 30, 90]) AS days), n AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t) SELECT CAST(days AS INT) AS days, (SELECT count(*) FROM account) AS users, (SELECT count(*) FROM account, n WHERE last_active >= t - INTERVAL 30 DAYS) AS active, (SELECT count(*) FROM account, n WHERE signed_up >= t - to_days(CAST(days AS INT))) AS signups,
 (SELECT count(DISTINCT CAST(signed_up AS DATE)) FROM account, n WHERE signed_up >= t - to_days(CAST(days AS INT))) AS signup_days, (SELECT count(*) FROM account, n WHERE signed_up >= t - to_days(CAST(days AS INT)) AND last_active >= t - INTERVAL 30 DAYS) / nullif((SELECT count(*) FROM account, n WHERE signed_up >= t - to_days(CAST(days AS INT))), 0) AS kept FROM r""")
def e6_owner_snapshot(s, d):
    """For each range of days: all users, those active in 30 days whatever the range, signups, days with any, and the share of new users still active. One aggregation."""
    t = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    active = F.col("last_active") >= t - F.expr("INTERVAL 30 DAYS")
    ranges = F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("days")
    rows = account(s, d).select("signed_up", active.alias("active"), ranges).withColumn("new", F.coalesce(F.col("signed_up") >= t - F.make_dt_interval(F.col("days")), F.lit(False)))
    n, kept = F.count_if("new"), F.count_if(F.col("new") & F.col("active"))
    return rows.groupBy("days").agg(F.count("*").alias("users"), F.count_if("active").alias("active"), n.alias("signups"), F.count_distinct(F.when(F.col("new"), F.col("signed_up").cast("date"))).alias("signup_days"), (kept / F.nullif(n, F.lit(0))).alias("kept"))


@query("""WITH o AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 10 <> 1 GROUP BY user_id), n AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE user_id % 10 <> 2 GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'insert' WHEN n.user_id IS NULL THEN 'delete' ELSE 'update' END AS change, CASE WHEN o.user_id IS NULL THEN 1 ELSE o.n + 1 END AS revision FROM o FULL JOIN n ON n.user_id = o.user_id WHERE o.user_id IS NULL OR n.user_id IS NULL OR o.n <> n.n OR o.last <> n.last""")
def x9_revisions(s, d):
    """What changed between two states of the users: rows that came, went or differ, each with its next revision."""
    e = load(s, d, "events")
    state = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    old = state(e.filter("ts < timestamp_ntz'2024-01-20 00:00:00' and user_id % 10 <> 1")).withColumn("revision", F.col("n"))
    return rel.changes(old, state(e.filter("user_id % 10 <> 2")), "user_id", ["n", "last"], "revision")


@query("""WITH l AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_replace(url, '[?#].*$', '') AS link, length(html) AS n FROM pages), a AS (SELECT host, link, min(page_id) AS page_id FROM l GROUP BY host, link), b AS (SELECT a.*, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM a)
SELECT b.host, count(*) AS admitted, CAST(sum(CASE WHEN k <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS fetched, CAST(sum(CASE WHEN k <= 5 AND l.n >= 2000 THEN 1 ELSE 0 END) AS BIGINT) AS published FROM b JOIN l ON l.page_id = b.page_id GROUP BY b.host""")
def x11_frontier_admission(s, d):
    """A source's flow: links are admitted once, a bounded number is fetched, what is long enough is published; counts of each step."""
    from pyspark.sql import Window as W

    df = load(s, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.regexp_replace("url", r"[?#].*$", "").alias("link"), F.length("html").alias("n"))
    once = df.groupBy("host", "link").agg(F.min("page_id").alias("page_id"), F.min_by("n", "page_id").alias("n"))
    queued = once.withColumn("k", F.row_number().over(W.partitionBy("host").orderBy("page_id")))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    return queued.groupBy("host").agg(F.count("*").alias("admitted"), count(F.col("k") <= 5).alias("fetched"), count((F.col("k") <= 5) & (F.col("n") >= 2000)).alias("published"))

