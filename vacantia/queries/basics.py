"""Scans, filters, joins, aggregations, windows, orders and set operations over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import aggregates as agg
from ..operators import relations as rel
from ..operators import windows as win
from ..sources.tables import NOW, account, listing, load, run, sighting
from ..sources.tables import sql_views as V
from .registry import query

N = f"TIMESTAMP '{NOW}'"
CUT = "TIMESTAMP '2024-01-30 12:00:00'"
STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def cut():
    return F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")


# ---- scans


@query(V("listing") + "SELECT id, company, title FROM listing WHERE id > 100 ORDER BY id LIMIT 40")
def s1_keyset_scan(s, d):
    return rel.keyset(listing(s, d), "id", 100, 40).select("id", "company", "title")


@query(V("listing") + "SELECT id, title, availability FROM listing WHERE availability = 'open' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def s2_covering_semi(s, d):
    wanted = load(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return listing(s, d).filter("availability = 'open'").join(wanted, "id", "left_semi").select("id", "title", "availability")


@query(V("listing") + "SELECT id, company, title, relevance FROM listing WHERE id = 42")
def s3_point_lookup(s, d):
    return listing(s, d).filter("id = 42").select("id", "company", "title", "relevance")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def s4_full_scan(s, d):
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def s5_action_page(s, d):
    return rel.keyset(load(s, d, "events"), "event_id", 500, 100).select("event_id", "user_id", "event_type")


@query("""SELECT id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT l_orderkey AS id, l_shipdate AS first_seen, l_shipdate AS last_seen, 1 AS n FROM lineitem) GROUP BY id""")
def s23_upsert_sink(s, d):
    rows = load(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_linenumber")
    sides = [x.groupBy("id").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count("*").alias("n")) for x in (rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3"))]
    merged = rel.upsert(sides[0].withColumnRenamed("n", "a").withColumn("b", F.lit(0).cast("bigint")), sides[1].withColumnRenamed("n", "b").withColumn("a", F.lit(0).cast("bigint")), "id", {"first_seen": "min", "last_seen": "max", "a": "max", "b": "max"})
    return merged.select("id", "first_seen", "last_seen", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


@query("SELECT DISTINCT s_suppkey AS source_id FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49")
def s24_source_catalog(s, d):
    fixed = load(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"))
    return fixed.union(load(s, d, "lineitem").filter("l_quantity > 49").select("l_suppkey")).distinct()


# ---- filters


@query(V("listing") + "SELECT id, relevance FROM listing WHERE relevance >= 60 AND lifecycle = 'NEW' AND category IN ('machinery', 'building') AND contains(lower(location), 'asia')")
def f1_output_filter(s, d):
    return listing(s, d).filter((F.col("relevance") >= 60) & (F.col("lifecycle") == "NEW") & F.col("category").isin("machinery", "building") & F.contains(F.lower("location"), F.lit("asia"))).select("id", "relevance")


@query(V("listing") + f"""SELECT id FROM listing WHERE availability = 'closed' OR (relevance >= 40 AND remote <> 'onsite' AND NOT (CAST(posted_at AS DATE) < DATE '2001-06-01') AND region IN ('AMERICA', 'EUROPE'))""")
def f4_hard_filters(s, d):
    fresh = ~dates.too_old(F.col("posted_at").cast("date"), F.lit(NOW).cast("date"))
    return listing(s, d).filter((F.col("availability") == "closed") | ((F.col("relevance") >= 40) & (F.col("remote") != "onsite") & fresh & F.col("region").isin("AMERICA", "EUROPE"))).select("id")


@query(V("listing") + "SELECT id, posted_at FROM listing WHERE NOT (CAST(posted_at AS DATE) < DATE '2001-06-01')")
def f7_two_month_age(s, d):
    return listing(s, d).filter(~dates.too_old(F.col("posted_at").cast("date"), F.lit(NOW).cast("date"))).select("id", "posted_at")


@query(V("listing") + """SELECT status, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN availability = 'open' THEN 'open' END, CASE WHEN availability = 'closed' THEN 'closed' END, CASE WHEN availability = 'open' AND lifecycle = 'NEW' THEN 'new' END,
  CASE WHEN availability = 'open' AND lifecycle = 'UPDATED' THEN 'updated' END, 'all'], lambda x: x IS NOT NULL)) AS status FROM listing) GROUP BY status""")
def f8_status_filter(s, d):
    is_open = F.col("availability") == "open"
    tags = F.array_compact(F.array(F.when(is_open, "open"), F.when(F.col("availability") == "closed", "closed"), F.when(is_open & (F.col("lifecycle") == "NEW"), "new"), F.when(is_open & (F.col("lifecycle") == "UPDATED"), "updated"), F.lit("all")))
    return agg.per_tag(listing(s, d), tags, "status")


@query(V("listing") + "SELECT id, category FROM listing WHERE category = 'machinery'")
def f9_category(s, d):
    return listing(s, d).filter(F.array_contains(F.array("category"), "machinery")).select("id", "category")


@query(V("listing") + "SELECT id, remote FROM listing WHERE remote = 'hybrid'")
def f10_work_mode(s, d):
    return listing(s, d).filter("remote = 'hybrid'").select("id", "remote")


@query(V("listing") + "SELECT id, term FROM listing WHERE term IS NULL OR lower(term) IN ('summer', 'fall')")
def f11_season_any(s, d):
    found = dates.seasons(F.coalesce("term", F.lit("")))
    return listing(s, d).filter(F.arrays_overlap(found, F.array(F.lit("summer"), F.lit("fall"))) | (F.size(found) == 0)).select("id", "term")


@query(V("listing") + "SELECT id, location FROM listing WHERE contains(lower(location), 'east') OR contains(lower(location), 'nation_1,')")
def f12_location_substring(s, d):
    return listing(s, d).filter(F.exists(F.array(F.lit("east"), F.lit("nation_1,")), lambda q: F.contains(F.lower("location"), q))).select("id", "location")


@query(V("listing") + "SELECT id FROM listing WHERE contains(lower(concat_ws(' ', title, company, location, description, url)), 'python')")
def f13_substring_search(s, d):
    return listing(s, d).filter(F.contains(F.lower(F.concat_ws(" ", "title", "company", "location", "description", "url")), F.lit("python"))).select("id")


@query(V("listing") + "SELECT id, title, company, availability, CASE WHEN lifecycle = 'NEW' THEN true ELSE false END AS is_new, relevance, location, remote, term, year, posted_at, first_seen, last_seen, url FROM listing")
def f16_card(s, d):
    return listing(s, d).select("id", "title", "company", "availability", (F.col("lifecycle") == "NEW").alias("is_new"), "relevance", "location", "remote", "term", "year", "posted_at", "first_seen", "last_seen", "url")


@query(V("listing") + "SELECT id, first_seen FROM listing WHERE first_seen > TIMESTAMP '2001-07-30 20:00:00' AND first_seen <= TIMESTAMP '2001-07-31 12:00:00'")
def f18_window_16h(s, d):
    end = F.lit("2001-07-31 12:00:00").cast("timestamp_ntz")
    return listing(s, d).filter((F.col("first_seen") > end - F.expr("INTERVAL 16 HOURS")) & (F.col("first_seen") <= end)).select("id", "first_seen")


@query(V("run") + f"SELECT run_id, source_id, settled_at FROM run WHERE failed AND settled_at >= {CUT} - INTERVAL 24 HOURS")
def f22_recent_failures(s, d):
    return run(s, d).filter(F.col("failed") & (F.col("settled_at") >= cut() - F.expr("INTERVAL 24 HOURS"))).select("run_id", "source_id", "settled_at")


@query(V("listing") + "SELECT id, availability FROM listing WHERE (1 = 0 OR availability <> 'closed')")
def f23_optional_closed(s, d, include_closed: bool = False):
    df = listing(s, d)
    return (df if include_closed else df.filter("availability <> 'closed'")).select("id", "availability")


@query(V("listing") + "SELECT CASE WHEN url LIKE '%linkedin.com%' THEN 'linkedin' ELSE 'other' END AS kind, count(*) AS n FROM listing GROUP BY 1")
def f25_host_like(s, d):
    return listing(s, d).groupBy(F.when(F.col("url").like("%linkedin.com%"), "linkedin").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


# ---- joins


@query(V("listing", "sighting") + "SELECT DISTINCT s_name AS source, listing.id, url FROM sighting JOIN supplier ON source_id = s_suppkey JOIN listing ON listing.id = sighting.id")
def j1_three_way(s, d):
    names = load(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source"))
    return sighting(s, d).select("id", "source_id").join(names, "source_id").join(listing(s, d).select("id", "url"), "id").select("source", "id", "url").distinct()


@query(V("run") + "SELECT run_id, coalesce(s_name, 'unknown source') AS source FROM run LEFT JOIN supplier ON source_id = s_suppkey + 50 WHERE failed")
def j2_left_unknown(s, d):
    names = load(s, d, "supplier").select((F.col("s_suppkey") + 50).alias("source_id"), "s_name")
    return run(s, d).filter("failed").join(names, "source_id", "left").select("run_id", F.coalesce("s_name", F.lit("unknown source")).alias("source"))


@query(V("listing") + "SELECT listing.id, count(l_orderkey) AS n FROM listing LEFT JOIN lineitem ON l_orderkey = listing.id AND l_returnflag = 'R' GROUP BY listing.id")
def j3_left_with_constant(s, d):
    returned = load(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("one"))
    return listing(s, d).select("id").join(returned, "id", "left").groupBy("id").agg(F.count("one").alias("n"))


@query(V("sighting") + "SELECT a.id, count(DISTINCT b.source_id) AS sources, min(b.source_id) AS first_source FROM sighting a JOIN sighting b ON a.id = b.id WHERE a.source_id = 7 GROUP BY a.id")
def j4_all_provenance(s, d):
    links = sighting(s, d).select("id", "source_id")
    mine = links.filter("source_id = 7").select("id")
    return links.join(mine, "id", "left_semi").groupBy("id").agg(F.count_distinct("source_id").alias("sources"), F.min("source_id").alias("first_source"))


@query(V("listing") + "SELECT id, title FROM listing WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_shipdate >= TIMESTAMP '2001-07-01')")
def j5_semi_new(s, d):
    recent = load(s, d, "lineitem").filter("l_shipdate >= '2001-07-01'").select(F.col("l_orderkey").alias("id"))
    return listing(s, d).select("id", "title").join(recent, "id", "left_semi")


@query(V("listing") + "SELECT id FROM listing WHERE company = 'Customer#000000007' OR url = 'https://careers.example.com/company-1/jobs/5' OR title = 'Sales Manager'")
def j6_semi_union(s, d):
    df = listing(s, d).select("id", "company", "url", "title")
    parts = [df.filter(F.col(c) == v).select("id") for c, v in (("company", "Customer#000000007"), ("url", "https://careers.example.com/company-1/jobs/5"), ("title", "Sales Manager"))]
    return rel.union_all(*parts).distinct()


@query(V("listing") + """SELECT DISTINCT a.id, b.id AS other FROM (SELECT id, unnest([url, 'k' || CAST(id % 97 AS VARCHAR) || company]) AS key FROM listing) a
JOIN (SELECT id, unnest([url, 'k' || CAST(id % 97 AS VARCHAR) || company]) AS key FROM listing) b ON a.key = b.key WHERE a.id < b.id""")
def j7_any_key(s, d):
    df = listing(s, d).select("id", "url", F.concat(F.lit("k"), F.col("id") % 97, "company").alias("other_key"))
    keys = rel.any_key(df, ["url", "other_key"], "id")
    return keys.join(keys.select("key", F.col("id").alias("other")), "key").filter("id < other").select("id", "other").distinct()


@query(V("listing") + "SELECT id FROM listing WHERE company_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup')")
def j8_anti_handled(s, d):
    events = load(s, d, "events")
    keys = rel.any_key(listing(s, d).select("id", F.concat(F.lit("c"), "company_id").alias("a"), F.concat(F.lit("i"), "id").alias("b")), ["a", "b"], "id")
    handled = events.filter("event_type = 'purchase'").select(F.concat(F.lit("c"), "user_id").alias("key")).union(events.filter("event_type = 'signup'").select(F.concat(F.lit("i"), "event_id")))
    hidden = keys.join(handled.distinct(), "key", "left_semi").select("id").distinct()
    return listing(s, d).select("id").join(hidden, "id", "left_anti")


@query(V("listing") + "SELECT id, min(other) AS found FROM (SELECT a.id, b.id AS other FROM listing a JOIN listing b ON a.company = b.company AND a.category = b.category AND b.id < a.id AND a.relevance = b.relevance) GROUP BY id")
def j10_first_match(s, d):
    df = listing(s, d).select("id", "company", "category", "relevance")
    pairs = df.join(df.withColumnRenamed("id", "other"), ["company", "category", "relevance"]).filter("other < id")
    return pairs.groupBy("id").agg(F.min("other").alias("found"))


@query(V("listing") + "SELECT listing.id, coalesce(p_name, url) AS destination FROM listing LEFT JOIN part ON p_partkey = listing.id AND p_size > 20")
def j11_lookup(s, d):
    targets = load(s, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"), "p_name")
    return listing(s, d).select("id", "url").join(targets, "id", "left").select("id", F.coalesce("p_name", "url").alias("destination"))


@query(V("listing", "sighting") + "SELECT DISTINCT listing.id FROM listing JOIN sighting ON sighting.id = listing.id JOIN supplier ON source_id = s_suppkey WHERE availability <> 'closed' AND s_acctbal > 5000 AND listing.id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')")
def j12_missing_candidates(s, d):
    seen = load(s, d, "lineitem").filter("l_shipdate >= '2001-01-01'").select(F.col("l_orderkey").alias("id"))
    trusted = load(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("source_id"))
    linked = sighting(s, d).join(trusted, "source_id", "left_semi").select("id")
    return listing(s, d).filter("availability <> 'closed'").select("id").join(linked, "id", "left_semi").join(seen, "id", "left_anti")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def j13_known_users(s, d):
    e = load(s, d, "events")
    return e.filter("event_type = 'purchase'").select("event_id", "user_id").join(e.filter("event_type = 'signup'").select("user_id"), "user_id", "left_semi")


@query(V("sighting") + "SELECT id FROM sighting LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) ON source_id = s_suppkey GROUP BY id HAVING bool_and(s_suppkey IS NOT NULL)")
def j14_all_sources_covered(s, d):
    done = load(s, d, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("source_id"))
    return rel.all_in(sighting(s, d).select("id", "source_id"), "id", "source_id", done)


@query(V("sighting") + "SELECT id FROM sighting GROUP BY id HAVING count(DISTINCT source_id) = count(DISTINCT CASE WHEN source_id < 50 THEN source_id END) AND count(DISTINCT source_id) >= 4")
def j15_source_set(s, d):
    wanted = F.count_distinct(F.when(F.col("source_id") < 50, F.col("source_id")))
    return sighting(s, d).groupBy("id").agg(F.count_distinct("source_id").alias("n"), wanted.alias("m")).filter("n = m and n >= 4").select("id")


@query(V("run") + "SELECT day, n FROM (SELECT CAST(settled_at AS DATE) AS day, count(DISTINCT CASE WHEN trusted THEN source_id END) AS n FROM run GROUP BY 1) WHERE n >= 30")
def j16_full_coverage_run(s, d):
    days = run(s, d).groupBy(F.col("settled_at").cast("date").alias("day")).agg(F.count_distinct(F.when(F.col("trusted"), F.col("source_id"))).alias("n"))
    return days.filter("n >= 30")


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS n_new, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AS n_gone FROM orders")
def j17_scalar_counts(s, d):
    flag = F.col("l_returnflag")
    counts = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(agg.count_where(flag == "A").alias("n_new"), agg.count_where(flag == "N").alias("n_gone"))
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id")).join(counts, "id", "left").select("id", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_gone", F.lit(0)).alias("n_gone"))


@query(V("listing") + "SELECT company_id, min(url) AS url FROM listing WHERE availability = 'open' AND url LIKE '%greenhouse%' GROUP BY company_id HAVING count(DISTINCT url) = 1")
def j18_exactly_one(s, d):
    return rel.exactly_one(listing(s, d).filter("availability = 'open' and url like '%greenhouse%'"), "company_id", "url")


@query(V("listing") + "SELECT id, CASE WHEN category = 'machinery' THEN 12 ELSE 0 END + CASE WHEN remote = 'remote' THEN 24 ELSE 0 END AS points FROM listing")
def j19_one_user(s, d):
    wish = s.range(1).select(F.lit("machinery").alias("w_category"), F.lit("remote").alias("w_remote"))
    points = F.when(F.col("category") == F.col("w_category"), 12).otherwise(0) + F.when(F.col("remote") == F.col("w_remote"), 24).otherwise(0)
    return listing(s, d).crossJoin(F.broadcast(wish)).select("id", points.alias("points"))


# ---- aggregations


@query(V("listing") + f"SELECT count(*) AS total, CAST(count_if(availability = 'open') AS BIGINT) AS n_open, CAST(count_if(lifecycle = 'NEW' AND first_seen >= {N} - INTERVAL 60 DAYS) AS BIGINT) AS n_new, count(DISTINCT company) AS companies FROM listing")
def a1_inventory_stats(s, d):
    fresh = (F.col("lifecycle") == "NEW") & (F.col("first_seen") >= now() - F.expr("INTERVAL 60 DAYS"))
    return listing(s, d).agg(F.count("*").alias("total"), agg.count_where(F.col("availability") == "open").alias("n_open"), agg.count_where(fresh).alias("n_new"), F.count_distinct("company").alias("companies"))


@query(V("listing") + "SELECT region, CAST(coalesce(sum(CASE WHEN lifecycle = 'NEW' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_new, CAST(coalesce(sum(CASE WHEN lifecycle = 'UPDATED' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_updated, CAST(coalesce(sum(CASE WHEN lifecycle = 'REMOVED' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed FROM listing GROUP BY region")
def a2_lifecycle_counts(s, d):
    return listing(s, d).groupBy("region").agg(*[agg.count_where(F.col("lifecycle") == v).alias(f"n_{v.lower()}") for v in ("NEW", "UPDATED", "REMOVED")])


@query(V("listing") + "SELECT count(*) AS n FROM listing WHERE availability = 'closed'")
def a3_closed_count(s, d):
    return listing(s, d).filter("availability = 'closed'").agg(F.count("*").alias("n"))


@query(V("run") + "SELECT source_id, outcome, count(*) AS n FROM run WHERE failed GROUP BY source_id, outcome ORDER BY n DESC, source_id LIMIT 20")
def a4_failure_topn(s, d):
    return run(s, d).filter("failed").groupBy("source_id", "outcome").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(20)


@query("SELECT event_type, count(*) AS n, max(value) AS worst FROM events GROUP BY event_type ORDER BY n DESC LIMIT 100")
def a5_error_groups(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("worst")).orderBy(F.desc("n")).limit(100)


@query("SELECT l_suppkey AS source_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey")
def a6_distinct_per_source(s, d):
    return load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count_distinct("l_orderkey").alias("n"))


@query("SELECT l_orderkey AS id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS sources FROM lineitem GROUP BY l_orderkey")
def a7_concat_distinct(s, d):
    return load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("sources"))


@query(V("run") + "SELECT source_id, max(coalesce(CASE WHEN trusted THEN settled_at END, TIMESTAMP '2024-01-01')) AS latest FROM run GROUP BY source_id")
def a8_latest_trusted(s, d):
    floor = F.lit("2024-01-01").cast("timestamp_ntz")
    return run(s, d).groupBy("source_id").agg(F.max(F.coalesce(F.when(F.col("trusted"), F.col("settled_at")), floor)).alias("latest"))


@query(V("run") + "SELECT CAST(settled_at AS DATE) AS day, CAST(sum(inventory) AS BIGINT) AS inventory, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) AS n FROM run GROUP BY 1")
def a9_rollup(s, d):
    return run(s, d).groupBy(F.col("settled_at").cast("date").alias("day")).agg(F.sum("inventory").alias("inventory"), F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("n"))


@query(V("run") + "SELECT run_id, greatest(inventory, max(inventory) OVER (PARTITION BY source_id ORDER BY run_id ROWS UNBOUNDED PRECEDING)) AS progress FROM run")
def a10_monotone_progress(s, d):
    from pyspark.sql import Window as W

    so_far = F.max("inventory").over(W.partitionBy("source_id").orderBy("run_id").rowsBetween(W.unboundedPreceding, 0))
    return run(s, d).select("run_id", F.greatest("inventory", so_far).alias("progress"))


@query(V("account") + """SELECT CAST(day AS DATE) AS day, count(signed_up) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day) LEFT JOIN account ON CAST(signed_up AS DATE) = CAST(day AS DATE) GROUP BY 1""")
def a11_zero_filled_daily(s, d):
    return agg.zero_filled_days(account(s, d), "signed_up", "2024-01-31", 30)


@query(V("account") + "SELECT user_id, CASE WHEN actions = 0 OR user_id % 3 = 0 THEN NULL ELSE CAST(actions AS DOUBLE) / (user_id % 3) END AS share FROM account")
def a12_null_safe_ratio(s, d):
    return account(s, d).select("user_id", agg.ratio(F.col("actions"), F.col("user_id") % 3).alias("share"))


@query("SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS plan FROM events GROUP BY user_id")
def a13_priority_state(s, d):
    t = F.col("event_type")
    return load(s, d, "events").groupBy("user_id").agg(F.max(F.when(t == "purchase", 3).when(t == "signup", 2).when(t == "click", 1).otherwise(0)).alias("plan"))


@query("SELECT event_type AS plan, count(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY users DESC, plan")
def a14_users_per_plan(s, d):
    return load(s, d, "events").groupBy(F.col("event_type").alias("plan")).agg(F.count_distinct("user_id").alias("users")).orderBy(F.desc("users"), "plan")


@query("SELECT stage, count(o_orderkey) AS n FROM (SELECT unnest(['" + "','".join(STAGES) + "']) AS stage) LEFT JOIN orders ON o_orderpriority = stage GROUP BY stage UNION ALL SELECT 'all', count(*) FROM orders")
def a15_stage_histogram(s, d):
    return agg.histogram(load(s, d, "orders").select(F.col("o_orderpriority").alias("stage")), "stage", STAGES)


@query(V("listing") + """SELECT tab, count(*) AS n FROM (SELECT unnest(list_filter(['main', CASE WHEN region = 'AMERICA' THEN 'america' END, CASE WHEN term = 'Summer' THEN 'summer' END, CASE WHEN remote = 'remote' THEN 'remote' END], lambda x: x IS NOT NULL)) AS tab FROM listing) GROUP BY tab""")
def a16_multi_tab_counts(s, d):
    tabs = F.array_compact(F.array(F.lit("main"), F.when(F.col("region") == "AMERICA", "america"), F.when(F.col("term") == "Summer", "summer"), F.when(F.col("remote") == "remote", "remote")))
    return agg.per_tag(listing(s, d), tabs, "tab")


@query(V("listing") + "SELECT DISTINCT category FROM listing ORDER BY category")
def a17_distinct_categories(s, d):
    return listing(s, d).select("category").distinct().orderBy("category")


@query(V("run") + "SELECT source_id, CAST(median(duration_ms) AS DOUBLE) AS median_ms FROM run GROUP BY source_id")
def a19_median(s, d):
    return run(s, d).groupBy("source_id").agg(agg.median(F.col("duration_ms")).alias("median_ms"))


@query(V("run") + "SELECT source_id, round(avg(inventory), 6) AS mean FROM run GROUP BY source_id")
def a20_mean(s, d):
    return run(s, d).groupBy("source_id").agg(F.round(F.avg("inventory"), 6).alias("mean"))


@query(V("run") + "SELECT source_id, CAST(quantile_disc(duration_ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(duration_ms, 0.95) AS DOUBLE) AS p95 FROM run GROUP BY source_id")
def a21_nearest_rank(s, d):
    return run(s, d).groupBy("source_id").agg(*[F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY duration_ms) AS DOUBLE)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))])


@query(V("run") + "SELECT source_id, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total, min(duration_ms) AS least, max(duration_ms) AS most, round(avg(duration_ms), 6) AS mean FROM run GROUP BY source_id")
def a22_latency_merge(s, d):
    parts = run(s, d).groupBy("source_id", F.col("settled_at").cast("date").alias("day")).agg(*agg.latency(F.col("duration_ms")))
    return agg.merge_latency(parts, "source_id").withColumn("mean", F.round("mean", 6))


@query(V("run") + "SELECT source_id, count(*) + 1 AS n, round((avg(inventory) * count(*) + 100) / (count(*) + 1), 6) AS mean FROM run GROUP BY source_id")
def a23_running_average(s, d):
    state = run(s, d).groupBy("source_id").agg(F.avg("inventory").alias("mean"), F.count("*").alias("n"))
    mean, n = agg.running_mean(F.col("mean"), F.col("n"), F.lit(100))
    return state.select("source_id", n.alias("n"), F.round(mean, 6).alias("mean"))


@query(V("run") + "SELECT key, CAST(sum(value) AS BIGINT) AS total FROM (SELECT unnest(['inventory', 'duration', 'failures']) AS key, unnest([inventory, duration_ms, CAST(failed AS BIGINT)]) AS value FROM run) GROUP BY key")
def a24_metric_sums(s, d):
    pairs = F.create_map(F.lit("inventory"), F.col("inventory"), F.lit("duration"), F.col("duration_ms"), F.lit("failures"), F.col("failed").cast("bigint"))
    return run(s, d).select(F.explode(pairs).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


@query("SELECT user_id, CAST(count_if(event_type = 'click') AS BIGINT) AS applied, CAST(count_if(event_type = 'view') AS BIGINT) AS hidden FROM events GROUP BY user_id")
def a25_decision_counts(s, d):
    return load(s, d, "events").groupBy("user_id").agg(agg.count_where(F.col("event_type") == "click").alias("applied"), agg.count_where(F.col("event_type") == "view").alias("hidden"))


@query("SELECT count(*) AS n, max(ts) AS latest, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(CASE WHEN value > 100 THEN 1 END) AS large FROM events")
def a26_action_meta(s, d):
    return load(s, d, "events").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), agg.count_where(F.col("event_type") == "click").alias("clicks"), F.count(F.when(F.col("value") > 100, 1)).alias("large"))


@query(V("run") + "SELECT CASE WHEN failed THEN 'failed' WHEN NOT trusted THEN 'partial' ELSE 'successful' END AS outcome, count(*) AS n FROM run GROUP BY 1")
def a27_outcome_buckets(s, d):
    return run(s, d).groupBy(F.when(F.col("failed"), "failed").when(~F.col("trusted"), "partial").otherwise("successful").alias("outcome")).agg(F.count("*").alias("n"))


@query(V("run") + "SELECT count(DISTINCT source_id) AS sources, CAST(sum(inventory) AS BIGINT) AS found, CAST(count_if(failed) AS BIGINT) AS failures, bool_or(excluded) AS any_excluded FROM run")
def a28_crawl_reduction(s, d):
    return run(s, d).agg(F.count_distinct("source_id").alias("sources"), F.sum("inventory").alias("found"), agg.count_where(F.col("failed")).alias("failures"), F.bool_or("excluded").alias("any_excluded"))


@query(V("listing") + "SELECT split_part(url, '/', 3) AS host, min_by(id, id) AS first_id, string_agg(DISTINCT availability, ',' ORDER BY availability) AS kinds FROM listing GROUP BY 1")
def a29_link_types(s, d):
    kinds = F.array_join(F.array_sort(F.collect_set("availability")), ",")
    return listing(s, d).groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.min_by("id", "id").alias("first_id"), kinds.alias("kinds"))


@query("""SELECT l_returnflag AS flag, round(b - a, 4) AS delta, round((b - a) / a * 100, 4) AS percent FROM (SELECT l_returnflag, sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_quantity END) AS a, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN l_quantity END) AS b FROM lineitem GROUP BY l_returnflag)""")
def a30_before_after(s, d):
    early = F.col("l_shipdate") < "1998-01-01"
    sums = load(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.when(early, F.col("l_quantity"))).alias("a"), F.sum(F.when(~early, F.col("l_quantity"))).alias("b"))
    return sums.select("flag", *agg.compared(F.col("a"), F.col("b"))).select("flag", F.round("delta", 4).alias("delta"), F.round("percent", 4).alias("percent"))


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def a31_group_by_host(s, d):
    return load(s, d, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT source AS feed, count(*) AS n, count(DISTINCT doc_id) AS ids, CAST(count_if(n_chars < 200) AS BIGINT) AS dropped, CAST(count_if(n_chars >= 200) AS BIGINT) AS retained FROM documents GROUP BY source")
def a32_feed_evaluation(s, d):
    short = F.col("n_chars") < 200
    return load(s, d, "documents").groupBy(F.col("source").alias("feed")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), agg.count_where(short).alias("dropped"), agg.count_where(~short).alias("retained"))


# ---- windows


@query(V("run") + "SELECT source_id, run_id, rn FROM (SELECT source_id, run_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS INT) AS rn FROM run) WHERE rn <= 5")
def w1_newest_n_per_source(s, d):
    return win.newest(run(s, d), "source_id", "run_id", 5).select("source_id", "run_id", "rn")


@query(V("run") + "SELECT source_id, run_id, rn FROM (SELECT source_id, run_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS INT) AS rn FROM run WHERE NOT excluded) WHERE rn <= 24")
def w2_bounded_history(s, d):
    return win.newest(run(s, d).filter("not excluded"), "source_id", "run_id", 24).select("source_id", "run_id", "rn")


@query(V("run") + "SELECT r.source_id, CAST(count_if(run_id > coalesce(m, -1)) AS BIGINT) AS streak FROM run r LEFT JOIN (SELECT source_id, max(run_id) AS m FROM run WHERE trusted GROUP BY source_id) t ON r.source_id = t.source_id GROUP BY r.source_id")
def w3_failure_streak(s, d):
    return win.streaks(run(s, d), "source_id", "run_id", F.col("trusted"), F.lit(1).cast("bigint"), "streak")


@query(V("run") + "SELECT source_id, max(CASE WHEN trusted THEN run_id END) AS success, max(CASE WHEN failed THEN run_id END) AS failure, arg_max(CASE WHEN failed THEN duration_ms END, CASE WHEN failed THEN run_id END) AS failure_ms FROM run GROUP BY source_id")
def w4_first_last_matching(s, d):
    t, f = F.col("trusted"), F.col("failed")
    return run(s, d).groupBy("source_id").agg(win.latest_where(t, "run_id", "run_id").alias("success"), win.latest_where(f, "run_id", "run_id").alias("failure"), win.latest_where(f, "run_id", "duration_ms").alias("failure_ms"))


@query(V("run") + "SELECT r.source_id, CAST(coalesce(sum(CASE WHEN run_id > coalesce(m, -1) THEN inventory END), 0) AS BIGINT) AS attempts FROM run r LEFT JOIN (SELECT source_id, max(run_id) AS m FROM run WHERE trusted AND outcome <> 'view' GROUP BY source_id) t ON r.source_id = t.source_id WHERE outcome <> 'view' GROUP BY r.source_id")
def w5_fallback_streak(s, d):
    return win.streaks(run(s, d).filter("outcome <> 'view'"), "source_id", "run_id", F.col("trusted"), F.col("inventory"), "attempts")


@query(V("run") + """SELECT source_id, CAST(CASE WHEN streak < 3 THEN 0 ELSE least(86400000, 900000 * pow(2, streak - 3)) END AS BIGINT) AS cooldown_ms FROM (
SELECT r.source_id, count_if(run_id > coalesce(m, -1)) AS streak FROM run r LEFT JOIN (SELECT source_id, max(run_id) AS m FROM run WHERE trusted GROUP BY source_id) t ON r.source_id = t.source_id GROUP BY r.source_id)""")
def w6_cooldown(s, d):
    return w3_failure_streak(s, d).select("source_id", win.cooldown_ms(F.col("streak")).alias("cooldown_ms"))


_BASE = V("run") + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM run), base AS (SELECT source_id, max(CASE WHEN rn = 1 THEN inventory END) AS latest, count(CASE WHEN rn > 1 THEN 1 END) AS samples, round(avg(CASE WHEN rn > 1 THEN inventory END), 6) AS mean, CAST(median(CASE WHEN rn > 1 THEN inventory END) AS DOUBLE) AS median FROM ranked GROUP BY source_id) "


@query(_BASE + "SELECT * FROM base")
def w7_latest_vs_baseline(s, d):
    return win.latest_and_rest(run(s, d), "source_id", "run_id", "inventory").withColumn("mean", F.round("mean", 6))


@query(_BASE + "SELECT source_id, CASE WHEN mean = 0 THEN NULL ELSE round(latest / mean, 4) END AS ratio FROM base")
def w8_latest_ratio(s, d):
    return w7_latest_vs_baseline(s, d).select("source_id", F.round(agg.ratio(F.col("latest"), F.col("mean")), 4).alias("ratio"))


@query(V("run") + "SELECT source_id, run_id FROM run WHERE trusted AND inventory > 50 ORDER BY run_id DESC LIMIT 1")
def w9_newest_passing(s, d):
    return run(s, d).filter("trusted and inventory > 50").select("source_id", "run_id").orderBy(F.desc("run_id")).limit(1)


@query("SELECT l_orderkey AS id, arg_min(l_suppkey, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey) AS source_id FROM lineitem GROUP BY l_orderkey")
def w10_first_wins(s, d):
    rows = load(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source_id"), "l_linenumber", "l_partkey")
    return win.first_of(rows, ["id"], F.col("l_linenumber") * F.lit(100_000_000) + F.col("l_partkey") * 10_000 + F.col("source_id")).select("id", "source_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def w11_carry_forward(s, d):
    return load(s, d, "events").select("event_id", win.carried(F.when(F.col("event_type") == "signup", F.col("value")), F.col("event_id"), "user_id").alias("carried"))


# ---- orders, limits and sets


def posted(df):
    return df.orderBy(F.col("posted_at").cast("date").desc_nulls_last(), F.col("posted_at").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.desc("relevance"), "company", "title", "id")


_POSTED = "ORDER BY CAST(posted_at AS DATE) DESC NULLS LAST, posted_at DESC NULLS LAST, first_seen DESC NULLS LAST, relevance DESC, company, title, id"


@query(V("listing") + f"SELECT id, posted_at, relevance FROM listing WHERE availability = 'open' {_POSTED} LIMIT 40")
def o1_posted_sort_topk(s, d):
    return posted(listing(s, d).filter("availability = 'open'")).select("id", "posted_at", "relevance").limit(40)


def _place(order: str, *columns: str) -> str:
    return V("listing") + f"SELECT {', '.join(columns)}, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place FROM listing"


@query(_place("relevance DESC, company, title, id", "id", "relevance"))
def o2_relevance_sort(s, d):
    return rel.numbered(listing(s, d).select("id", "relevance", "company", "title"), [F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")], "place").select("id", "relevance", "place")


@query(_place("lifecycle = 'NEW' DESC, CASE WHEN lifecycle = 'NEW' THEN posted_at END DESC NULLS LAST, relevance DESC, company, title, id", "id", "lifecycle"))
def o3_default_sort(s, d):
    new = F.col("lifecycle") == "NEW"
    order = [new.desc(), F.when(new, F.col("posted_at")).desc_nulls_last(), F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")]
    return rel.numbered(listing(s, d).select("id", "lifecycle", "posted_at", "relevance", "company", "title"), order, "place").select("id", "lifecycle", "place")


@query(_place("last_seen DESC NULLS LAST, relevance DESC, company, title, id", "id", "last_seen"))
def o4_last_seen_sort(s, d):
    order = [F.col("last_seen").desc_nulls_last(), F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")]
    return rel.numbered(listing(s, d).select("id", "last_seen", "relevance", "company", "title"), order, "place").select("id", "last_seen", "place")


@query(_place("term IS NULL, CASE term WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 WHEN 'Fall' THEN 4 END, CASE WHEN term IS NULL THEN NULL ELSE year END NULLS LAST, relevance DESC, company, title, id", "id", "term", "year"))
def o5_season_sort(s, d):
    df = listing(s, d).select("id", "term", "year", "relevance", "company", "title", dates.season_rank(dates.seasons(F.coalesce("term", F.lit("")))).alias("rank"))
    order = [F.col("rank").isNull(), F.col("rank"), F.when(F.col("rank").isNotNull(), F.col("year")).asc_nulls_last(), F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")]
    return rel.numbered(df, order, "place").select("id", "term", "year", "place")


@query(_place("availability = 'open' DESC, relevance DESC, lower(company), lower(title), id", "id", "availability"))
def o6_stored_order(s, d):
    from ..functions.text import ascii_fold

    order = [(F.col("availability") == "open").desc(), F.desc("relevance"), ascii_fold(F.col("company")), ascii_fold(F.col("title")), F.col("id")]
    return rel.numbered(listing(s, d).select("id", "availability", "relevance", "company", "title"), order, "place").select("id", "availability", "place")


@query(_place("CASE lifecycle WHEN 'NEW' THEN 0 WHEN 'UPDATED' THEN 1 WHEN 'UNCHANGED' THEN 2 ELSE 3 END, lower(company), id", "id", "lifecycle"))
def o7_lifecycle_rank_sort(s, d):
    rank = F.array_position(F.array(*map(F.lit, ("NEW", "UPDATED", "UNCHANGED", "REMOVED"))), F.col("lifecycle"))
    return rel.numbered(listing(s, d).select("id", "lifecycle", "company"), [rank, F.lower("company"), F.col("id")], "place").select("id", "lifecycle", "place")


@query(V("listing") + "SELECT company_id, id FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN availability = 'open' THEN 0 WHEN availability = 'unknown' THEN 1 ELSE 2 END, relevance DESC, id) AS rn FROM listing) WHERE rn = 1")
def o8_ranked_match(s, d):
    rank = F.when(F.col("availability") == "open", 0).when(F.col("availability") == "unknown", 1).otherwise(2)
    return win.first_of(listing(s, d), ["company_id"], rank, F.desc("relevance"), F.col("id")).select("company_id", "id")


@query("SELECT s_suppkey AS source_id, s_name FROM supplier ORDER BY s_suppkey % 2 = 0 DESC, s_suppkey DESC LIMIT 30")
def o9_configured_first(s, d):
    return load(s, d, "supplier").orderBy((F.col("s_suppkey") % 2 == 0).desc(), F.desc("s_suppkey")).limit(30).select(F.col("s_suppkey").alias("source_id"), "s_name")


@query(V("listing") + f"SELECT id, (SELECT count(*) FROM listing WHERE availability = 'open') AS total, (SELECT count(*) FROM listing WHERE availability = 'open') > 48 AS has_more, CASE WHEN (SELECT count(*) FROM listing WHERE availability = 'open') > 48 THEN 48 END AS next_offset FROM listing WHERE availability = 'open' {_POSTED} LIMIT 8 OFFSET 40")
def o10_page_with_total(s, d):
    df = listing(s, d).filter("availability = 'open'")
    order = [F.col("posted_at").cast("date").desc_nulls_last(), F.col("posted_at").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.desc("relevance"), F.col("company"), F.col("title"), F.col("id")]
    return rel.page(df, order, 40, 8).select("id", "total", "has_more", "next_offset")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 40")
def o11_keyset_page(s, d):
    return rel.keyset(load(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 1000, 40)


@query(V("account") + "SELECT user_id, last_active FROM account ORDER BY last_active DESC, user_id LIMIT 10")
def o12_recent_users(s, d):
    return account(s, d).select("user_id", "last_active").orderBy(F.desc("last_active"), "user_id").limit(10)


@query(V("run") + "SELECT run_id, source_id, (SELECT count(*) FROM run WHERE failed) > 20 AS has_more FROM run WHERE failed ORDER BY run_id DESC LIMIT 20")
def o13_history_has_more(s, d):
    head = run(s, d).filter("failed").select("run_id", "source_id").orderBy(F.desc("run_id")).limit(21)
    more = head.agg((F.count("*") > 20).alias("has_more"))
    return head.orderBy(F.desc("run_id")).limit(20).crossJoin(F.broadcast(more))


@query(V("listing") + f"SELECT id, first_seen FROM listing WHERE first_seen > {N} - INTERVAL 7 DAYS AND first_seen <= {N} ORDER BY first_seen DESC, id")
def o15_today_feed(s, d):
    return listing(s, d).filter((F.col("first_seen") > now() - F.expr("INTERVAL 7 DAYS")) & (F.col("first_seen") <= now())).select("id", "first_seen").orderBy(F.desc("first_seen"), "id")


@query("SELECT p_partkey AS item, p_size AS priority FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def o16_priority_pop(s, d):
    return load(s, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("priority")).orderBy(F.desc("priority"), "item").limit(25)


@query("SELECT p_brand AS batch, p_partkey AS item, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS turn FROM part ORDER BY turn, batch LIMIT 60")
def o17_interleave(s, d):
    return rel.interleaved(load(s, d, "part").select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("item")), "batch", "item").limit(60)


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(url, 'page=') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(url, 'spam|#top') THEN 25 ELSE 0 END AS score FROM pages")
def o18_link_score(s, d):
    weights = {"/en/": 20, "page=": 10, "spam|#top": -25}
    score = F.lit(0)
    for pattern, weight in weights.items():
        score = score + F.when(F.regexp_like("url", F.lit(pattern)), F.lit(weight)).otherwise(F.lit(0))
    return load(s, d, "pages").select("page_id", score.alias("score"))


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_suppkey = 1 UNION SELECT o_orderkey FROM orders WHERE o_custkey = 3 UNION SELECT l_orderkey FROM lineitem WHERE l_partkey = 5")
def u1_union_distinct(s, d):
    lines = load(s, d, "lineitem")
    return rel.union_all(lines.filter("l_suppkey = 1").select(F.col("l_orderkey").alias("id")), load(s, d, "orders").filter("o_custkey = 3").select(F.col("o_orderkey").alias("id")), lines.filter("l_partkey = 5").select(F.col("l_orderkey").alias("id"))).distinct()


@query(V("listing") + "SELECT 'posting' AS kind, id, url FROM listing WHERE relevance >= 90 UNION ALL SELECT 'application', id, url || '/apply' FROM listing WHERE relevance >= 95")
def u2_union_all_links(s, d):
    df = listing(s, d).select("id", "url", "relevance")
    a = df.filter("relevance >= 90").select(F.lit("posting").alias("kind"), "id", "url")
    return rel.union_all(a, df.filter("relevance >= 95").select(F.lit("application").alias("kind"), "id", F.concat("url", F.lit("/apply")).alias("url")))


@query("SELECT DISTINCT l_suppkey AS source_id, l_returnflag AS flag FROM lineitem")
def u3_distinct(s, d):
    return load(s, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("flag")).distinct()


@query("SELECT DISTINCT s_suppkey AS source_id FROM (SELECT s_suppkey FROM supplier UNION SELECT user_id FROM events)")
def u5_catalog_union(s, d):
    return load(s, d, "supplier").select(F.col("s_suppkey").alias("source_id")).union(load(s, d, "events").select("user_id")).distinct()


@query(f"SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE ts >= {CUT} - INTERVAL 6 HOURS)")
def u7_not_attempted(s, d):
    tried = load(s, d, "events").filter(F.col("ts") >= cut() - F.expr("INTERVAL 6 HOURS")).select(F.col("user_id").alias("key"))
    return load(s, d, "orders").select(F.col("o_custkey").alias("key")).distinct().join(tried, "key", "left_anti")
