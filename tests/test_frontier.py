"""The frontier of a crawl against a plain crawler, and links as pages write them."""

import random

from pyspark.sql import functions as F

from vacantia.functions import urls
from vacantia.plans import frontier

ROOT = "https://a.example/jobs"


def plain(roots, pages, depth, most_admitted, most_pages):
    """{(source, url): (depth, place, referrer, state)} by one queue a source; ``pages`` are {url: [(link, priority)]}."""
    out = {}
    for source, root in roots.items():
        seen, level = {}, [(1000, root, None)]
        for at in range(depth + 1):
            read = []
            for _, url, referrer in sorted(level, key=lambda x: (-x[0], x[1])):
                if len(seen) < most_admitted:
                    place = len(seen) + 1
                    state = "waiting" if place > most_pages else "read" if url in pages else "missing"
                    seen[url] = (at, place, referrer, state)
                    read += [url] * (state == "read")
            found = {}
            for url in read:
                for link, p in pages[url]:
                    if link not in seen and (link.split("/")[2] == root.split("/")[2] or link.split("/")[2].endswith("greenhouse.io")):
                        q, r = found.get(link, (p, url))
                        found[link] = max(p, q), min(r, url)
            level = [(p, link, r) for link, (p, r) in found.items()]
        out |= {(source, url): row for url, row in seen.items()}
    return out


def test_rounds_equal_a_plain_crawler(spark):
    r = random.Random(4)
    names = [f"https://{h}/{way}{k}" for h in ("a.example", "b.example", "boards.greenhouse.io", "stranger.example") for way in ("jobs/", "list?page=", "about") for k in range(12)]
    rank = lambda u: 50 if "?page=" in u else 10 if "about" in u else 100 if "greenhouse" in u else 80
    pages = {u: [(v, rank(v)) for v in r.sample(names, 6) if v != u] for u in r.sample(names, 90)} | {ROOT: [(v, rank(v)) for v in r.sample(names, 25)]}
    roots = {1: ROOT, 2: "https://b.example/list?page=1", 3: "https://nothing.example"}
    html = [(u, "".join(f"<a href='{v}'>x</a>" for v, _ in links) * 2) for u, links in pages.items()] + [(None, "<a href=/x>"), (names[0], None)] * (names[0] in pages)
    landed = spark.createDataFrame(html, "url string, html string").withColumn("source", F.lit("clash")).withColumn("link", F.lit("clash"))
    start = spark.createDataFrame([*roots.items(), (1, ROOT), (None, ROOT), (4, None)], "source int, url string").withColumn("n", F.lit(7))
    for bounds in ((0, 5, 5), (2, 9, 4), (5, 30, 20), (6, 1000, 1000)):
        got = {(x.source, x.url): (x.depth, x.place, x.referrer, x.state) for x in frontier.crawl(start, landed, *bounds).collect()}
        assert got == plain(roots, pages, *bounds)
    assert {x[3] for x in got.values()} == {"read", "missing"}


def test_links_as_pages_write_them(spark):
    base = "https://a.example:8443/jobs/list?x=1"
    want = {
        "https://b.example/j#f": "https://b.example/j", "/r": "https://a.example:8443/r", "s": "https://a.example:8443/jobs/s", "?page=2&amp;y=3": "https://a.example:8443/jobs/list?page=2&y=3", "//c.example/t": "https://c.example/t",
        "mailto:x@y.example": None, "javascript:void(0)": None, "#top": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "href string").select("href", frontier.absolute(F.lit(base), F.col("href")).alias("to"), frontier.absolute(F.lit(None).cast("string"), F.lit("/r")).alias("none"))
    assert {r.href: r.to for r in df.collect()} == want and all(r.none is None for r in df.collect())
    ranks = spark.range(1).select(*[frontier.priority(F.lit(u)) for u in ("https://jobs.lever.co/acme/jobs/7", "https://a.example/careers/7/", "https://a.example/jobs?page=3", "https://a.example/")])
    assert list(ranks.first()) == [100, 80, 50, 10] and urls.host(F.lit("x")) is not None


def test_links_are_completed_once(spark):
    """The expression that completes a link stands once in the plan: neither filters nor the canonical form compute it anew."""
    page = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.concat(F.lit("<a href='/jobs/"), k.cast("string"), F.lit("?x=1&amp;ref=2#t'>"))), "")
    links = frontier.page_links(spark.range(1).select(F.lit("https://a.example/jobs").alias("url"), page.alias("html")))
    assert links._jdf.queryExecution().analyzed().toString().count("^[A-Za-z][A-Za-z0-9+.-]*:") == 1
    assert tuple(links.agg(F.count("*"), F.min("link"), F.min("priority")).first()) == (20_000, "https://a.example/jobs/10000?x=1", 80)


def test_canonical_links_stay(spark):
    same = ["https://a.example/", "http://a.example/x/y", "https://a-b.example/jobs/7//8"]
    other = {"https://a.example": "https://a.example/", "https://A.example/x": "https://a.example/x", "https://a.example/x/": "https://a.example/x", "https://a.example//": "https://a.example", "HTTPS://a.example/x": "https://a.example/x", "https://a.example:443/x": "https://a.example/x", "https://a.example/x#y": "https://a.example/x", "https://a.example/x?": "https://a.example/x", "https://a.example/x?token=1&b=2&a=1&&utm_source=z": "https://a.example/x?a=1&b=2", "x": None}
    df = spark.createDataFrame([(u,) for u in [*same, *other, None]], "u string").select("u", urls.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == {u: u for u in same} | other | {None: None}


def test_nothing_to_crawl(spark):
    none = spark.createDataFrame([], "source int, url string")
    assert frontier.crawl(none, spark.createDataFrame([], "url string, html string"), 3, 5, 5).count() == 0
