"""The frontier of a crawl over landed pages: breadth-first rounds, admission before a page is read, bounds for each source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.stage import stored

_HREF = r"(?i)<a\b[^>]*\bhref=[\"']?([^\"'\s>]+)"


#: A posting's address: its path ends in a posting of a known kind.
_POSTING = r"(?i)^https?://[^/?#:]+(?::\d+)?[^?#]*/(?:jobs?|positions?|careers?)/[^/?#]+/?(?:\?[^#]*)?(?:#.*)?$"


def priority(link: Column) -> Column:
    """What is read first: postings of applicant systems, other postings, further list pages, the rest."""
    own = F.when(urls.is_under(urls.host(link), urls.ATS_HOSTS), 100).otherwise(80)
    return F.when(F.regexp_like(link, F.lit(_POSTING)), own).when(F.regexp_like(link, F.lit(r"[?&]page=\d+")), 50).otherwise(10)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _base(url: Column) -> Column:
    """What links of a page are completed by: its scheme, host, root, path and the folder in which it lies."""
    scheme, way = F.lower(urls.part(url, 1)), urls.path(url)
    root = F.concat(scheme, F.lit("://"), urls.host(url), F.when(urls.part(url, 3) == "", "").otherwise(F.concat(F.lit(":"), urls.part(url, 3))))
    folder = F.regexp_replace(F.when(way == "", "/").otherwise(way), r"[^/]*$", "")
    return F.struct(scheme.alias("scheme"), urls.host(url).alias("host"), root.alias("root"), way.alias("path"), folder.alias("folder"))


def _completed(base: Column, href: Column) -> Column:
    def of(bare: Column) -> Column:
        return (
            F.when((bare == "") | (base["host"] == ""), None).when(F.regexp_like(bare, F.lit(r"^(?i:https?)://")), bare).when(F.regexp_like(bare, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None)
            .when(bare.startswith("//"), F.concat(base["scheme"], F.lit(":"), bare)).when(bare.startswith("/"), F.concat(base["root"], bare))
            .when(bare.startswith("?"), F.concat(base["root"], base["path"], bare)).otherwise(F.concat(base["root"], base["folder"], bare))
        )

    return _once(F.regexp_replace(F.replace(href, F.lit("&amp;"), F.lit("&")), "#.*$", ""), of)


def absolute(base: Column, href: Column) -> Column:
    """A link as an address without fragment: whole, of the base's scheme, below its host, a query of its page, or beside it. Null for other schemes and mere fragments."""
    return _once(_base(base), lambda b: _completed(b, href))


def page_links(pages: DataFrame) -> DataFrame:
    """(``url``, ``link``, ``priority``): the distinct links of each page (``url``, ``html``).

    A page's address is taken apart once, and each link completed once and made canonical once, inside the array: as columns, filters would compute them anew.
    """
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    read = pages.filter(F.contains(F.lower("html"), F.lit("href"))).select("url", hrefs.alias("hrefs"), _base(F.col("url")).alias("base"))
    links = F.transform("hrefs", lambda h: _once(_completed(F.col("base"), h), urls.canonical))
    links = F.filter(links, lambda to: to.isNotNull() & (to != F.col("url")))
    return read.select("url", F.explode(F.array_distinct(links)).alias("link")).distinct().withColumn("priority", priority(F.col("link")))


def crawl(roots: DataFrame, pages: DataFrame, depth: int, most_admitted: int, most_pages: int) -> DataFrame:
    """(``source``, ``url``, ``depth``, ``place``, ``referrer``, ``state``) of every address that a source admits.

    ``roots`` are (``source``, ``url``), one a source; ``pages`` are the landed pages (``url``, ``html``), addresses canonical. A round takes the links of what the round before read: those on the root's host or
    an applicant system's that the source has not admitted yet, by priority and address, until the source has admitted ``most_admitted``. Of those the first ``most_pages`` over all rounds are read: ``state`` is
    read, missing (no such page has landed) or waiting (beyond the bound). The referrer is the least of the pages that name the address.

    What a source admits of a round is cut to its bound before rows are shuffled by source, so a source that holds most links costs a task no more than that. Each
    round is stored; the set of admitted addresses is the union of the rounds. Sources and addresses that are null are left out; repeated rows count once.
    """
    landed = stored(pages.select("url").filter("url is not null").distinct())
    links = stored(page_links(pages))

    def admitted(candidates: DataFrame, before: DataFrame, at: int) -> DataFrame:
        """``before`` is (``source``, ``n``), what each source has admitted so far."""
        order = W.partitionBy("source").orderBy(F.desc("priority"), "url")
        first = candidates.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most_admitted)
        placed = first.join(before, "source", "left").withColumn("place", F.col("k") + F.coalesce("n", F.lit(0))).filter(F.col("place") <= most_admitted)
        here = placed.join(landed.withColumn("here", F.lit(True)), "url", "left")
        state = F.when(F.col("place") > most_pages, "waiting").when(F.col("here"), "read").otherwise("missing")
        return stored(here.select("source", "home", "url", F.lit(at).alias("depth"), F.col("place").cast("int").alias("place"), "referrer", state.alias("state")))

    start = roots.filter("source is not null and url is not null").groupBy("source").agg(F.min("url").alias("url"))
    start = start.select("source", urls.host(F.col("url")).alias("home"), "url", F.lit(1000).alias("priority"), F.lit(None).cast("string").alias("referrer"))
    rounds = [admitted(start, start.select("source", F.lit(0).alias("n")), 0)]
    for at in range(1, depth + 1):
        known = reduce(DataFrame.unionByName, rounds)
        name = urls.host(F.col("link"))
        found = rounds[-1].filter("state = 'read'").join(links, "url").filter((name == F.col("home")) | urls.is_under(name, urls.ATS_HOSTS))
        new = found.groupBy("source", "home", F.col("link").alias("to")).agg(F.max("priority").alias("priority"), F.min("url").alias("referrer")).withColumnRenamed("to", "url")
        rounds.append(admitted(new.join(known.select("source", "url"), ["source", "url"], "left_anti"), known.groupBy("source").agg(F.count("*").alias("n")), at))
        if rounds[-1].filter("state = 'read'").isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds).drop("home")
