"""Identity of listings: pair rules and the ordered merge against a plain version, store matches, work bounds."""

import copy
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from vacantia.operators import identity, stage

SCHEMA = "id bigint, posting_url string, application_url string, provider string, company string, title string, locations array<string>, job_id string, " + ", ".join(f"{c} {t}" for c, (t, _) in identity.PAYLOAD.items()) + ", base_quality int"
DAY = dt.datetime(2026, 1, 1)


def listing(i, posting, application=None, company="Acme", title="Software Intern", places=("Toronto",), job_id=None, description="x", base=0, **more):
    v = {"skills": ["a"], "relevance": i % 9, "reason": f"r{i}", "sponsorship": f"s{i}", "discovered": DAY + dt.timedelta(i), "verified": DAY + dt.timedelta(i)} | more
    v["description"] = description
    return (i, posting, application or posting, v.pop("provider", None), company, title, list(places), job_id, *[v.get(c) for c in identity.PAYLOAD], base)


def described(spark, rows):
    return stage.stored(identity.described(spark.createDataFrame(rows, SCHEMA)))


def pairs(spark, *rows):
    return {(r.id, r.other) for r in identity.matches(described(spark, rows)).collect()}


GH, LV = "https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/"


def test_pair_rules(spark):
    assert pairs(spark, listing(1, GH + "1001"), listing(2, GH + "1001/apply?utm_source=x", company="Other", title="Else")) == {(1, 2)}  # one link
    assert pairs(spark, listing(1, GH + "1001"), listing(2, GH + "1002")) == set()  # different requisitions of one role
    assert pairs(spark, listing(1, GH + "1001"), listing(2, LV + "1001")) == {(1, 2)}  # same requisition, role and place under two providers
    assert pairs(spark, listing(1, GH + "1001"), listing(2, LV + "1001", places=("Austin",))) == set()
    assert pairs(spark, listing(1, GH + "1001"), listing(2, "https://jobright.ai/info/zz")) == {(1, 2)}  # an aggregator's copy, by role and place
    assert pairs(spark, listing(1, "https://x.org/a", places=()), listing(2, "https://y.org/b", places=())) == set()  # no place is no evidence
    assert pairs(spark, listing(1, "https://dreamworkhq.com/c/acme"), listing(2, "https://dreamworkhq.com/c/acme", title="Else")) == set()  # landing pages are shared
    assert pairs(spark, listing(1, None, company=None, title=None, places=()), listing(2, None, company=None, title=None, places=())) == set()


def plain_fold(rows):
    """The ordered merge without an index: every record is asked, earliest first."""
    out = []
    for v in rows:
        r = identity.Record(v, [v["id"]])
        home = next((m for m in out if m.takes(r)), None)
        if home is None:
            out.append(r)
        else:
            identity.merge(home, r)
    return out


def rows_of(df):
    out = []
    for r in df.orderBy("id").collect():
        v = r.asDict()
        for c in identity.SETS:
            v[c] = set(v[c])
        v["provenance"] = [tuple(e) for e in v["provenance"] or ()]
        v["quality"] = identity._quality(v)
        out.append(v)
    return out


def more(r, i):
    """Some of the other fields, some missing."""
    out = {}
    for c, (kind, rule) in identity.PAYLOAD.items():
        if r.random() < 0.6 and c not in ("description", "skills", "relevance", "reason", "discovered", "verified", "sponsorship"):
            out[c] = [r.choice(["A", "B", "c"]) for _ in range(r.randint(0, 3))] if kind == "array<string>" else [("term", "x1", "p"), ("skills", "a", f"q{i % 3}")] if rule == "evidence" else r.choice(["x1", "x2", "unknown"])
            out[c] = list(dict.fromkeys(out[c])) if isinstance(out[c], list) else out[c]
    return out


def test_fold_against_plain_version(spark):
    r = random.Random(7)
    links = [lambda n: GH + f"100{n}", lambda n: LV + f"100{n}", lambda n: f"https://jobright.ai/info/z{r.randrange(9)}z", lambda n: f"https://careers.acme.com/jobs/100{n}"]
    rows = []
    for i in range(400):
        post, app = (r.choice(links)(r.randrange(6)) for _ in range(2))
        rows.append(listing(i, post, app if r.random() < 0.3 else None, f"C{r.randrange(12)}", f"Role {r.randrange(3)}", r.sample(["Toronto", "Austin", "Paris"], r.randint(0, 2)), f"R{r.randrange(3)}" if r.random() < 0.3 else None, "y" * r.choice([1, 99, 100, 600]), r.randrange(4), **more(r, i), verified=None if r.random() < 0.2 else DAY + dt.timedelta(r.randrange(9))))
    df = described(spark, rows)
    want = plain_fold(copy.deepcopy(rows_of(df)))
    blocks = identity.merge_blocks(df)
    got = {x.merged_id: x for x in identity.deduplicated(df.join(blocks, "id"), "block").collect()}
    assert {m: list(x.members) for m, x in got.items()} == {x.members[0]: x.members for x in want}
    assert any(len(x.members) > 2 for x in want) and len(want) < 400
    for x in want:
        for c in ("company", "posting_url", "job_id", "locations", *identity.PAYLOAD):
            assert (got[x.members[0]][c] or None) == (x.v[c] or None) if c != "relevance" else got[x.members[0]][c] == x.v[c], c


def test_fields_of_a_merge(spark):
    direct = listing(1, GH + "1001", description="short", skills=["a", "b"], sponsorship="no", base=40)
    copied = listing(2, "https://jobright.ai/info/zz", company="Acme Corp", places=("Austin", "Toronto"), description="z" * 150, skills=["b", "c"], relevance=8, sponsorship="yes")
    df = described(spark, [direct, copied])
    (one,) = identity.deduplicated(df.withColumn("block", F.lit(1)), "block").collect()
    assert (one.members, one.company, one.posting_url, one.locations, one.skills, one.relevance, one.reason, one.sponsorship, one.description) == ([1, 2], "Acme", GH + "1001", ["Toronto", "Austin"], ["a", "b", "c"], 8, "r2", "no", "z" * 150)
    struct = F.struct("id", "company", "job_id", "locations", "posting_aggregator", *identity.PAYLOAD)
    both = df.filter("id = 1").select(struct.alias("p")).crossJoin(df.filter("id = 2").select(struct.alias("q")))
    row = both.select(*[c.alias(n) for n, c in identity.merged_fields(F.col("p"), F.col("q")).items()]).first()
    assert all((row[c] or None) == (one[c] or None) for c in ("company", "locations", *identity.PAYLOAD))


def test_merged_records_are_indexed_anew(spark):
    """A merge gives the record the places of both, by which a third listing finds it."""
    rows = [listing(1, "https://jobright.ai/info/za", places=("Paris",)), listing(2, "https://jobright.ai/info/za", places=("Austin",)), listing(3, "https://y.org/b", places=("Austin",))]
    df = described(spark, rows).withColumn("block", F.lit(1))
    assert [list(r.members) for r in identity.deduplicated(df, "block").collect()] == [[1, 2, 3]]


@pytest.mark.parametrize("title", ["t", None])
def test_fold_does_not_compare_all(title):
    """8,000 requisitions of one role, or of one role each, stay apart in linear time."""
    v = lambda i: {"id": i, "urls": {f"u{i}"}, "ids": {f"{i}"}, "direct": {f"{i}"}, "url_ids": set(), "direct_url_ids": set(), "provider_key": "p", "company_key": "c", "title_key": title or f"t{i}", "places": {"x"}}
    began = time.process_time()
    assert len(identity.fold(v(i) for i in range(8000))) == 8000
    assert time.process_time() - began < 1


def test_one_family_of_companies_is_one_block(spark):
    """A merge by link may take the company of one record and the title of the other; who has both is in the block."""
    rows = [listing(1, "https://jobright.ai/info/za", "https://x.org/a/jobs/7", company="Left", title="Cook"), listing(2, "https://x.org/a/jobs/7", company="Right", title="Baker"), listing(3, "https://z.org/q", company="Right", title="Cook"), listing(4, "https://z.org/r", company="Left", title="Miller")]
    df = described(spark, rows)
    block = {r.id: r.block for r in identity.merge_blocks(df).collect()}
    assert block[1] == block[2] == block[3] != block[4]
    got = sorted(list(r.members) for r in identity.deduplicated(df.join(identity.merge_blocks(df), "id"), "block").collect())
    assert got == sorted(r.members for r in plain_fold(rows_of(df)))


def test_store_matches(spark):
    old = [listing(1, GH + "1001"), listing(2, LV + "1002", places=("Austin",)), listing(3, "https://jobright.ai/info/zo", title="Analyst"), listing(4, GH + "1009", title="Analyst", places=("Paris",))]
    new = [listing(11, GH + "1001/apply"), listing(12, "https://jobright.ai/info/zn", places=("Austin",)), listing(13, GH + "1008", title="Analyst", places=("Rome",)), listing(14, GH + "1777", title="Nothing like it")]
    o, n = (described(spark, x).withColumn("first_seen", F.col("discovered")) for x in (old, new))
    found = {(r.id, r.old, r.kind) for r in identity.store_matches(n, o).collect()}
    # 12 is an aggregator's copy: of the role's direct records the one in its place; 13 is direct: the only copy of its role, though elsewhere
    assert found == {(11, 1, "url"), (11, 1, "provider"), (12, 2, "role"), (13, 3, "role")}
    assert {r.id: r.old for r in identity.existing(n, o).collect()} == {11: 1, 12: 2, 13: 3}


def test_stores_hold_what_matching_reads(spark):
    """The payload of a listing is neither made nor stored for it, nor are listings that are in no store."""
    from vacantia.queries import plans

    new, old = plans._stores(spark, "/root/testdata/sf0.001")
    assert set(new.columns) == {*identity.STORE, "availability"} and not set(new.columns) & set(identity.PAYLOAD)
    want = {r.availability: r["count"] for r in plans._records(spark, "/root/testdata/sf0.001").groupBy("availability").count().collect()}
    assert (new.count(), old.count()) == (want["open"], want["closed"]) and set(want) > {"open", "closed"}
    whole = new.sparkSession.read.parquet(new.inputFiles()[0].rsplit("/", 1)[0])
    assert {r.availability for r in whole.select("availability").distinct().collect()} == {"open", "closed"}
