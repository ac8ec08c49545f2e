"""Loaders of the warehouse tables, and the domain views over them.

The warehouse is a retail schema, so listings are an explicit projection of it: an order stands for a listing, its customer
for the company, an order line for a sighting by a source (the supplier), an event for an outcome of a source's run. Titles,
descriptions and links are chosen from the fixed lists below by key. Every view is given twice, as a DataFrame and as SQL of the
same meaning (``sql_views``), so that results can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
#: The moment that all relative rules refer to; never the clock.
NOW = "2001-08-01 12:00:00"
TITLES = [
    "Software Engineer Intern, Summer 2027", "Data Science Co-op (Fall)", "Senior Platform Engineer", "Machine Learning Intern - Winter 2027", "Marketing Student", "New Grad Backend Developer",
    "Quantitative Developer Internship", "PhD Research Engineer 2026", "Mobile Developer Intern", "12 months QA Automation placement", "Sales Manager", "Firmware Intern 2026/2027",
    "Full Stack Developer Co op", "Site Reliability Intern, Spring 2027", "Human Resources Intern", "Research Intern, Computer Vision",
]
DESCRIPTIONS = [
    "Write code in Python and SQL. Build data pipelines with Apache Spark and Airflow. Pursuing a degree in computer science.",
    "Develop REST APIs with Java and Docker on AWS. Salary $30 - $40 per hour.",
    "Cold call customers and run a social media campaign.",
    "Design web APIs, unit tests and CI/CD for a React and TypeScript front end. Duration: 4 months.",
    "Summer 2027 internship for current students. U.S. citizenship is not required.",
    "Maintain embedded software in C++ on Linux. Apply by June 30, 2027.",
    "This position requires an active security clearance. No visa sponsorship is available.",
    "Train machine learning models with PyTorch and CUDA.",
    "Accounts payable and financial reporting.",
    "Test automation with Selenium, Playwright and Cypress.",
    "Fall or autumn placement; winter extension possible. Employer sponsorship is available.",
    "",
]
HOSTS = ["boards.greenhouse.io", "jobs.lever.co", "www.linkedin.com", "jobright.ai", "acme.wd5.myworkdayjobs.com", "careers.example.com"]
TERMS, YEARS = ["Summer", "Fall", "Winter", "Spring", None], ["2026", "2027", None]
REMOTE, LIFECYCLE = ["remote", "hybrid", "onsite", "unknown"], ["NEW", "UPDATED", "UNCHANGED", "REMOVED"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str | None], key: str) -> str:
    """SQL of both engines for the entry of ``values`` at ``key`` modulo their number."""
    quoted = ["CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


def _listing_sql(hours: str, days: str) -> str:
    """The listing view; ``hours`` and ``days`` turn a number into an interval in the engine's own way."""
    first = f"o_orderdate + {hours.format('o_orderkey % 72')}"
    return f"""
SELECT o_orderkey AS id, c_custkey AS company_id, c_name AS company, {_pick(TITLES, 'o_orderkey')} AS title, {_pick(DESCRIPTIONS, 'o_orderkey')} AS description,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS availability, {_pick(LIFECYCLE, 'o_custkey')} AS lifecycle,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS relevance, o_orderdate AS posted_at, {first} AS first_seen, {first} + {days.format('o_custkey % 10')} AS last_seen,
  n_name AS nation, r_name AS region, concat(n_name, ', ', r_name) AS location, {_pick(REMOTE, 'o_custkey')} AS remote, lower(c_mktsegment) AS category, o_orderpriority AS stage,
  {_pick(TERMS, 'o_orderkey')} AS term, {_pick(YEARS, 'o_custkey')} AS year,
  concat('https://', {_pick(HOSTS, 'o_orderkey')}, '/company-', CAST(c_custkey AS STRING), '/jobs/', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/apply?utm_source=x&gh_jid=7' ELSE '' END) AS url
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


_SIGHTING = "SELECT l_orderkey AS id, l_suppkey AS source_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS sightings FROM lineitem GROUP BY l_orderkey, l_suppkey"
_RUN = """SELECT user_id AS source_id, event_id AS run_id, ts AS settled_at, event_type AS outcome, event_type = 'error' AS failed, event_type = 'purchase' AS trusted,
  event_type = 'view' AS excluded, CAST(floor(value) AS BIGINT) AS inventory, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events"""
#: A source's outcome in a day's run, and the run: both count that day's events.
_OUTCOME = """SELECT *, err < 4 AS completed, err < 3 AS coverage, (run_id + source_id) % 17 = 0 AS stale, views < 6 AS trusted, clicks > 5 AS suspicious, (run_id + 2 * source_id) % 23 = 0 AS excluded,
  CASE WHEN err >= 4 THEN 'parse_error' WHEN clicks > 4 THEN 'rate_limited' WHEN err = 3 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN signups = 0 THEN 429 ELSE 200 END AS http_status, CASE WHEN clicks > 3 THEN clicks - 3 ELSE 0 END AS rate_limits,
  CASE WHEN views > 3 THEN 2 ELSE 0 END AS fallbacks, CASE WHEN signups > 2 THEN 1 ELSE 0 END AS fallback_successes, CASE WHEN err > 0 THEN concat('e', CAST(err AS STRING)) END AS error
FROM (SELECT day(ts) AS run_id, user_id % 25 AS source_id, max(ts) AS settled_at, CAST(floor(sum(value) * 1000) AS BIGINT) AS duration_ms, count_if(event_type = 'error') AS err, count_if(event_type = 'click') AS clicks, count_if(event_type = 'view') AS views,
  count_if(event_type = 'signup') AS signups, count_if(event_type = 'purchase') AS inventory FROM events GROUP BY day(ts), user_id % 25)"""
_CRAWL = """SELECT *, CASE WHEN run_id = 30 THEN 'RUNNING' WHEN run_id % 6 = 5 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN run_id < 30 THEN heartbeat_at END AS finished_at, run_id % 11 = 7 AS cancelled, settled AS requested, settled AS completed
FROM (SELECT day(ts) AS run_id, min(ts) AS started_at, max(ts) AS heartbeat_at, count(DISTINCT user_id % 25) AS settled, count(*) AS discovered, count_if(event_type = 'purchase') AS closed, count_if(event_type = 'click') AS skipped FROM events GROUP BY day(ts))"""
_ACCOUNT = "SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS signed_up, max(ts) AS last_active, count(*) AS actions FROM events GROUP BY user_id"


def sql_views(*names: str) -> str:
    """``WITH`` clause with the named views, for the comparing engine."""
    views = {"listing": _listing_sql("to_hours({})", "to_days(CAST({} AS INT))"), "sighting": _SIGHTING, "run": _RUN, "account": _ACCOUNT, "outcome": _OUTCOME, "crawl": _CRAWL}
    return "WITH " + ", ".join(f"{n} AS ({views[n]})" for n in names) + " "


def _view(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over the named tables, without names left in the catalog."""
    return spark.sql(sql, **{}) if not tables else spark.sql(_placed(sql, tables), **{t: load(spark, folder, t) for t in tables})


def _placed(sql: str, tables: tuple[str, ...]) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def spread(df: DataFrame) -> DataFrame:
    """A scan that fills fewer tasks than there are cores, dealt over them: for work that is heavy for each row. Large inputs stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def listing(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Listings: id, company, title, description, availability, lifecycle, relevance, dates, place, category, stage, term, url.

    ``heavy``: what follows reads texts, so a small table is dealt over all cores first.
    """
    sql = _placed(_listing_sql("make_dt_interval(0, CAST({} AS INT))", "make_dt_interval(CAST({} AS INT))"), ("orders", "customer", "nation", "region"))
    tables = {t: load(spark, folder, t) for t in ("orders", "customer", "nation", "region")}
    return spark.sql(sql, **tables | ({"orders": spread(tables["orders"])} if heavy else {}))


def sighting(spark: SparkSession, folder: str) -> DataFrame:
    """Links of listings and sources with first and last sight."""
    return _view(spark, folder, _SIGHTING, "lineitem")


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the runs of sources: source_id, run_id, settled_at, outcome and its flags, inventory, duration_ms."""
    return _view(spark, folder, _RUN, "events")


def outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of sources in runs, as ``plans.operations`` reads them."""
    return _view(spark, folder, _OUTCOME, "events")


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    """Runs over all sources, as ``plans.operations`` reads them."""
    return _view(spark, folder, _CRAWL, "events")


def account(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts: first signup, last activity, number of actions."""
    return _view(spark, folder, _ACCOUNT, "events")


def configured(df: DataFrame) -> DataFrame:
    """Sources of the catalog: those with an even id."""
    return df.filter(F.col("source_id") % 2 == 0)
