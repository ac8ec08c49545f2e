"""Identity of listings and their deduplication.

A listing is described by its links, requisition ids, provider, company, role and places. Buckets (link; company and id; company, role
and place) hold every pair that can match; a residual rule decides. The ordered merge (the earliest record that takes a
listing merges with it, field by field, and gets its buckets) is not a transitive closure, so blocks that merging cannot leave are found
first (``merge_blocks``). Each block is folded in order by one task through an index whose keys hold all that a rule asks for, requisitions of a
role included: a listing meets the records that it matches, not all of its role.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text, urls
from .stage import components

_TEXT, _LIST = "string", "array<string>"
#: What a listing brings along, apart from its identity, and how two values become one: ``joined`` lists (once each, but for case), the better one's value
#: if it has one (``first``; ``known``: if it is not "unknown"), the longer list, the record's that may speak of sponsorship (``policy``), or a rule of the field's own.
PAYLOAD = {
    "description": (_TEXT, "description"), "skills": (_LIST, "joined"), "sources": (_LIST, "joined"), "responsibilities": (_LIST, "joined"), "required": (_LIST, "joined"), "preferred": (_LIST, "joined"),
    "education": (_LIST, "joined"), "graduation": (_LIST, "joined"), "experience": (_LIST, "joined"), "authorization": (_LIST, "joined"), "categories": (_LIST, "joined"), "study_years": (_LIST, "joined"), "degrees": (_LIST, "joined"), "normalized": (_LIST, "longer"),
    "term": (_TEXT, "first"), "year": (_TEXT, "first"), "duration": (_TEXT, "first"), "salary": (_TEXT, "first"), "posted": (_TEXT, "first"), "deadline": (_TEXT, "first"), "expected_graduation": (_TEXT, "first"),
    "first_year": (_TEXT, "known"), "upper_year": (_TEXT, "known"), "student_status": (_TEXT, "known"), "enrollment": (_TEXT, "known"), "returning": (_TEXT, "known"), "work_authorization": (_TEXT, "known"), "modality": (_TEXT, "known"),
    "sponsorship": (_TEXT, "policy"), "relevance": ("int", "relevance"), "reason": (_TEXT, "relevance"), "discovered": ("timestamp_ntz", "earliest"), "verified": ("timestamp_ntz", "latest"),
    "provenance": ("array<struct<field:string,value:string,page:string>>", "evidence"),
}
LISTS = [c for c, (t, rule) in PAYLOAD.items() if t == _LIST]


def _some(*columns: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")))


def described(records: DataFrame) -> DataFrame:
    """Adds a listing's descriptor to ``id``, ``posting_url``, ``application_url``, ``provider``, ``company``, ``title``, ``locations``, ``job_id``.

    ``urls`` (without landing pages), ``ids``, ``direct`` (ids that no aggregator gave), ``provider``, ``company_key``, ``title_key``, ``places``,
    ``aggregator`` (either link is one), ``posting_aggregator`` and ``application_aggregator``.
    """
    own = F.lower("job_id")
    # each stage names what the next one uses more than once; a form's link that is the posting's own is not read again
    again = lambda c, value: F.when(F.col("again"), F.col(f"{c}0")).otherwise(value).alias(f"{c}1")
    df = records.select("*", F.col("application_url").eqNullSafe(F.col("posting_url")).alias("again"), urls.canonical(F.col("posting_url")).alias("link0"), text.company_identity(F.col("company")).alias("company_key"), text.role_identity(F.col("title")).alias("title_key"))
    of = {"form": urls.without_form, "class": urls.host_class, "landing": urls.is_landing}
    df = df.select("*", again("link", urls.canonical(F.col("application_url"))), *[f(F.col("link0")).alias(f"{c}0") for c, f in of.items()])
    number = lambda i: F.lower(F.coalesce(urls.job_id(F.col(f"form{i}")), F.when(F.col(f"form{i}") != F.col(f"link{i}"), urls.job_id(F.col(f"link{i}")))))
    df = df.select("*", *[again(c, f(F.col("link1"))) for c, f in of.items()], number(0).alias("id0"))
    df = df.select("*", again("id", number(1)), *[F.coalesce(F.col(f"class{i}") == "aggregator", F.lit(False)).alias(f"agg{i}") for i in (0, 1)])
    direct = [F.when(~F.col(f"agg{i}") & ~F.coalesce(f"landing{i}", F.lit(False)), F.col(f"id{i}")) for i in (0, 1)]
    shown = [F.when(~F.col(f"landing{i}"), F.col(c)) for i in (0, 1) for c in (f"link{i}", f"form{i}")]
    return df.select(
        *records.columns, _some(*shown).alias("urls"), _some(own, F.col("id0"), F.col("id1")).alias("ids"), _some(F.when(~F.col("agg0") & ~F.col("agg1"), own), *direct).alias("direct"), _some(F.col("id0"), F.col("id1")).alias("url_ids"), _some(*direct).alias("direct_url_ids"),
        F.coalesce(F.lower("provider"), urls.provider(F.col("link0")), urls.provider(F.col("link1"))).alias("provider_key"), "company_key", "title_key", F.array_distinct(F.filter(F.transform("locations", text.identity_ascii), lambda x: x != "")).alias("places"),
        (F.col("agg0") | F.col("agg1")).alias("aggregator"), F.col("agg0").alias("posting_aggregator"), F.col("agg1").alias("application_aggregator"),
    )


def keys() -> Column:
    """``url:``, ``provider-job:`` and ``role-location:`` keys of a described listing; the last needs a place."""
    full = lambda *cs: F.forall(F.array(*[F.col(c) for c in cs]), lambda x: x.isNotNull() & (x != ""))
    jobs = F.when(full("provider_key", "company_key"), F.transform("ids", lambda i: F.concat(F.lit("provider-job:"), F.concat_ws("|", "provider_key", "company_key", i))))
    role = F.when(full("company_key", "title_key") & (F.size("places") > 0), F.array(F.concat(F.lit("role-location:"), F.concat_ws("|", "company_key", "title_key", F.array_join(F.array_sort("places"), ";")))))
    none = F.array().cast("array<string>")
    return F.concat(F.transform("urls", lambda u: F.concat(F.lit("url:"), u)), F.coalesce(jobs, none), F.coalesce(role, none))


def action_keys() -> Column:
    """Every identity under which an action on a described listing is remembered."""
    none = F.array().cast("array<string>")
    role = lambda kind, place: F.concat(F.lit(f"{kind}:"), F.concat_ws("|", "company_key", "title_key", place))
    own = F.when(F.col("job_id").isNotNull(), F.array(F.concat(F.lit("job:"), F.concat_ws("|", "company_key", F.lower("job_id")))))
    embedded = F.transform("url_ids", lambda i: F.concat(F.lit("embedded:"), F.concat_ws("|", "company_key", i)))
    jobs = F.transform("ids", lambda i: F.concat(F.lit("provider-job:"), F.concat_ws("|", "provider_key", "company_key", i)))
    urls_ = F.transform("urls", lambda u: F.concat(F.lit("url:"), u))
    where = F.concat(F.array(role("role", F.array_join(F.array_sort("places"), ";"))), F.transform("places", lambda p: role("role-location", p)), F.transform("places", lambda p: role("role-city", p)))
    return F.array_distinct(F.concat(where, urls_, jobs, F.coalesce(own, none), embedded))


def buckets() -> Column:
    """Every alias by which two described listings can match."""
    company, title, none = F.col("company_key"), F.col("title_key"), F.array().cast("array<string>")
    ids = F.when(company != "", F.transform("ids", lambda i: F.concat_ws("|", F.lit("id"), "company_key", i)))
    roles = F.when((company != "") & (title != ""), F.transform("places", lambda p: F.concat_ws("|", F.lit("role"), "company_key", "title_key", p)))
    return F.concat(F.transform("urls", lambda u: F.concat(F.lit("url|"), u)), F.coalesce(ids, none), F.coalesce(roles, none))


def same(a: str, b: str) -> Column:
    """The rules on two described records (aliases): a shared link; or a shared requisition of one company and provider (or role and place);
    else different direct requisitions part them, and one company, role and place join them."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    eq = lambda c: x(c).isNotNull() & (x(c) != "") & (x(c) == y(c))
    meet = lambda c: F.coalesce(F.arrays_overlap(x(c), y(c)), F.lit(False))
    role = eq("title_key") & meet("places")
    apart = (F.size(x("direct")) > 0) & (F.size(y("direct")) > 0) & ~meet("direct")
    return F.coalesce(meet("urls") | (meet("ids") & eq("company_key") & (eq("provider_key") | role)) | (~apart & eq("company_key") & role), F.lit(False))


_DESCRIPTOR = ["id", "urls", "ids", "direct", "provider_key", "company_key", "title_key", "places"]


def matches(records: DataFrame) -> DataFrame:
    """(id, other) of the matching pairs of described records, found by shared buckets."""
    keyed = records.select(*_DESCRIPTOR, F.explode(buckets()).alias("key"))
    left, right = keyed.alias("a"), keyed.alias("b")
    return left.join(right, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & same("a", "b")).select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).distinct()


def store_matches(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, old, kind): which stored records (``old``, with ``first_seen``) each new one may be: by link, by a provider's requisition, or by role.

    By role only between an aggregator's copy and a direct record, or two aggregators' copies in one place; those in one place
    win, else a single candidate is taken.
    """
    n, o = new.alias("n"), old.alias("o")
    pair = lambda j, kind: j.select(F.col("n.id").alias("id"), F.col("o.id").alias("old"), F.lit(kind).alias("kind"))
    keyed = lambda df, c: df.select("id", F.explode(c).alias("key"))
    by = lambda c, kind: pair(keyed(new, c).alias("n").join(keyed(old, c).alias("o"), F.col("n.key") == F.col("o.key")), kind).distinct()
    jobs = F.filter(keys(), lambda k: F.startswith(k, F.lit("provider-job:")))
    role = n.join(o, (F.col("n.company_key") == F.col("o.company_key")) & (F.col("n.title_key") == F.col("o.title_key")))
    near = F.coalesce(F.arrays_overlap("n.places", "o.places"), F.lit(False))
    role = role.filter((F.col("n.application_aggregator") != F.col("o.application_aggregator")) | (F.col("n.application_aggregator") & near)).select(F.col("n.id").alias("id"), F.col("o.id").alias("old"), near.alias("near"))
    count = role.groupBy("id").agg(F.bool_or("near").alias("any"), F.count("*").alias("count"))
    role = role.join(count, "id").filter(F.when(F.col("any"), F.col("near")).otherwise(F.col("count") == 1)).select("id", "old", F.lit("role").alias("kind"))
    return by(F.col("urls"), "url").unionByName(by(jobs, "provider")).unionByName(role)


#: What ``store_matches`` and ``existing`` read of a described record.
STORE = ["id", "urls", "ids", "direct", "provider_key", "company_key", "title_key", "places", "application_aggregator", "job_id", "first_seen"]


def existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, old): the stored record that each new one is, if any: by link, else the oldest of its store matches, else by requisition of the
    company, else company, role and all places, else company, role and a common place; the last two unless requisitions conflict."""
    found = store_matches(new, old).join(old.select(F.col("id").alias("old"), "first_seen"), "old")
    ranked = found.select("id", "old", F.when(F.col("kind") == "url", 0).otherwise(1).alias("rank"), F.when(F.col("kind") == "url", F.lit(None).cast("timestamp_ntz")).otherwise(F.col("first_seen")).alias("seen"))
    n, o = new.alias("n"), old.alias("o")
    pair = lambda j, rank: j.select(F.col("n.id").alias("id"), F.col("o.id").alias("old"), rank.alias("rank"), F.lit(None).cast("timestamp_ntz").alias("seen"))
    job = pair(n.join(o, (F.col("n.job_id") == F.col("o.job_id")) & (F.col("n.company_key") == F.col("o.company_key"))), F.lit(2))
    apart = (F.size("n.direct") > 0) & (F.size("o.direct") > 0) & ~F.coalesce(F.arrays_overlap("n.direct", "o.direct"), F.lit(False))
    role = n.join(o, (F.col("n.company_key") == F.col("o.company_key")) & (F.col("n.title_key") == F.col("o.title_key")) & ~apart & F.arrays_overlap("n.places", "o.places"))
    role = pair(role, F.when(F.array_sort("n.places") == F.array_sort("o.places"), 3).otherwise(4))
    return ranked.unionByName(job).unionByName(role).groupBy("id").agg(F.min_by("old", F.struct("rank", "seen", "old")).alias("old"))


def link_quality(posting: Column, application: Column) -> Column:
    """What a record's links say of its quality: a form at an applicant system, a posting and a form that are no aggregator's, a form of its own."""
    aggregator = lambda u: F.coalesce(urls.host_class(u) == "aggregator", F.lit(False))
    return (
        F.when(urls.host_class(application) == "ats", 40).otherwise(0) + F.when(~aggregator(posting), 30).otherwise(0) - F.when(aggregator(application), 35).otherwise(0)
        + F.when(~application.eqNullSafe(posting), 15).otherwise(0)
    )


def quality(posting: Column, application: Column, description: Column, requirements: Column) -> Column:
    """What makes one record of a listing better than another: its links, its text, and how many requirements it names."""
    return link_quality(posting, application) + F.least(F.lit(25), F.floor(F.coalesce(F.length(description), F.lit(0)) / 500).cast("int")) + requirements


def merged_fields(primary: Column, secondary: Column) -> dict[str, Column]:
    """The merge of two listings (structs with ``PAYLOAD``, ``company``, ``job_id``, ``locations``, ``posting_aggregator``), the first the better one.

    The fields' rules are in ``PAYLOAD``. A description under 100 characters gives way to a longer one; the greater relevance keeps its reason; first
    discovery, last verification. The company comes from the direct record. Sponsorship may change: it is the direct record's, among equals that of the
    later verification. Evidence of either stays where its value is still the field's.
    """
    p, q = primary, secondary
    full = lambda c: F.coalesce(c, F.array())
    union = lambda c: text.unique_items(F.concat(full(p[c]), full(q[c])))
    prefer = F.when(p["posting_aggregator"] != q["posting_aggregator"], ~p["posting_aggregator"]).otherwise(q["verified"].isNull() | F.coalesce(p["verified"] >= q["verified"], F.lit(False)))
    short = lambda c: F.coalesce(F.length(c["description"]), F.lit(0)) < 100
    of_company = p["posting_aggregator"] & ~q["posting_aggregator"]
    out = {"company": F.when(of_company, q["company"]).otherwise(p["company"]), "job_id": F.coalesce(p["job_id"], q["job_id"]), "locations": union("locations")}
    rules = {
        "description": lambda c: F.when(short(p) & ~short(q), q[c]).otherwise(p[c]), "joined": union, "first": lambda c: F.coalesce(p[c], q[c]),
        "known": lambda c: F.coalesce(F.nullif(p[c], F.lit("unknown")), q[c], p[c]), "longer": lambda c: F.when(F.size(full(p[c])) >= F.size(full(q[c])), p[c]).otherwise(q[c]),
        "policy": lambda c: F.when(prefer, p[c]).otherwise(q[c]), "relevance": lambda c: F.when(F.coalesce(p["relevance"] >= q["relevance"], q["relevance"].isNull()), p[c]).otherwise(q[c]),
        "earliest": lambda c: F.least(p[c], q[c]), "latest": lambda c: F.greatest(p[c], q[c]),
    }
    out |= {c: rules[rule](c) for c, (_, rule) in PAYLOAD.items() if rule != "evidence"}
    told = F.concat(F.coalesce(p["provenance"], F.array().cast(PAYLOAD["provenance"][0])), F.coalesce(q["provenance"], F.array().cast(PAYLOAD["provenance"][0])))
    holds = lambda e: F.coalesce(*[F.when(e["field"] == c, e["value"].eqNullSafe(v)) for c, v in out.items() if PAYLOAD.get(c, (_LIST if c == "locations" else _TEXT,))[0] == _TEXT], *[F.when(e["field"] == c, F.array_contains(F.transform(v, F.lower), F.lower(e["value"]))) for c, v in out.items() if c == "locations" or c in LISTS], F.lit(False))
    return out | {"provenance": F.array_distinct(F.filter(told, lambda e: F.coalesce(holds(e), F.lit(False))))}


@dataclass
class Record:
    """A listing, or what several have become."""

    v: dict
    members: list = field(default_factory=list)

    def _keys(self, asks: bool) -> list[tuple]:
        """The keys a record is found by or asks for: each is all that one rule needs. In a role a record with direct requisitions is found by each of them, and
        by any record without; so it asks for its own requisitions and for records without."""
        v = self.v
        out = [("url", u) for u in v["urls"]]
        company, title = v["company_key"], v["title_key"]
        if company:
            if v["provider_key"]:
                out += [("provider", company, v["provider_key"], i) for i in v["ids"]]
            if title:
                for p in v["places"]:
                    out += [("id", company, title, p, i) for i in v["ids"]]
                    role = ("role", company, title, p)
                    if asks:
                        out += [(*role, i) for i in v["direct"]] + [(*role, None)] if v["direct"] else [role]
                    else:
                        out += [role, *((*role, i) for i in v["direct"] or (None,))]
        return out

    def found_by(self) -> list[tuple]:
        return self._keys(False)

    def asks_for(self) -> list[tuple]:
        return self._keys(True)

    def takes(self, other: Record) -> bool:
        a, b = self.v, other.v
        if not a["urls"].isdisjoint(b["urls"]):
            return True
        company = bool(a["company_key"]) and a["company_key"] == b["company_key"]
        role = company and bool(a["title_key"]) and a["title_key"] == b["title_key"] and not a["places"].isdisjoint(b["places"])
        if company and not a["ids"].isdisjoint(b["ids"]) and (role or a["provider_key"] and a["provider_key"] == b["provider_key"]):
            return True
        return role and not (a["direct"] and b["direct"] and a["direct"].isdisjoint(b["direct"]))


def _key(x: str) -> str:
    return x.lower().rstrip(".!;:")


def _joined(a: list | None, b: list | None) -> list:
    out: dict[str, str] = {}
    for x in [*(a or ()), *(b or ())]:
        out.setdefault(_key(x), x)
    return list(out.values())


def _quality(v: dict) -> int:
    return v["base_quality"] + min(25, len(v["description"] or "") // 500) + len(v["required"] or ()) + len(v["preferred"] or ())


def merge(a: Record, b: Record) -> None:
    """``a`` becomes the merge of both: the better one is primary (``a`` if they are equal). As ``merged_fields``, with the identity of the result."""
    p, q = (b.v, a.v) if b.v["quality"] > a.v["quality"] else (a.v, b.v)
    v = dict(p)
    direct = p["posting_aggregator"] and not q["posting_aggregator"]
    v["company"], v["company_key"] = (q if direct else p)["company"], (q if direct else p)["company_key"]
    v["job_id"] = p["job_id"] if p["job_id"] is not None else q["job_id"]
    v["locations"], v["places"] = _joined(p["locations"], q["locations"]), p["places"] | q["places"]
    job = {v["job_id"].lower()} if v["job_id"] else set()
    v["ids"], v["direct"] = p["url_ids"] | job, p["direct_url_ids"] | (set() if p["aggregator"] else job)
    if p["posting_aggregator"] != q["posting_aggregator"]:
        keep = not p["posting_aggregator"]
    else:
        keep = q["verified"] is None or (p["verified"] is not None and p["verified"] >= q["verified"])
    more = q["relevance"] is None or (p["relevance"] is not None and p["relevance"] >= q["relevance"])
    some = lambda c: [x[c] for x in (p, q) if x[c] is not None]
    for c, (_, rule) in PAYLOAD.items():
        x, y = p[c], q[c]
        if rule == "joined":
            v[c] = _joined(x, y)
        elif rule == "description":
            v[c] = y if len(x or "") < 100 <= len(y or "") else x
        elif rule == "first":
            v[c] = x if x is not None else y
        elif rule == "known":
            v[c] = x if x not in (None, "unknown") else y if y is not None else x
        elif rule == "longer":
            v[c] = x if len(x or ()) >= len(y or ()) else y
        elif rule == "policy":
            v[c] = x if keep else y
        elif rule == "relevance":
            v[c] = x if more else y
        elif rule == "earliest":
            v[c] = min(some(c), default=None)
        elif rule == "latest":
            v[c] = max(some(c), default=None)
    v["provenance"] = [e for e in dict.fromkeys([*(p["provenance"] or ()), *(q["provenance"] or ())]) if _holds(v, *e[:2])]
    v["quality"] = _quality(v)
    a.v = v
    a.members += b.members


def _holds(v: dict, field_: str, value: str | None) -> bool:
    """Whether a piece of evidence still gives the field's value."""
    own = v.get(field_) if field_ in ("company", "job_id", "locations") or field_ in PAYLOAD else None
    if isinstance(own, list):
        return value is not None and value.lower() in {x.lower() for x in own if isinstance(x, str)}
    return field_ in ("company", "job_id") or PAYLOAD.get(field_, ("",))[0] == _TEXT if own == value else False


def fold(rows: Iterator[dict]) -> list[Record]:
    """Listings in order: each goes to the earliest record that takes it, which is merged and indexed anew, or begins one.

    What the index finds may have changed since, so it is asked; the least record of each key comes first, the next one only if it refuses.
    """
    out: list[Record] = []
    index: dict[tuple, list[int]] = {}
    for v in rows:
        r = Record(v, [v["id"]])
        heads = [(held[0], 0, held) for held in (index.get(k) for k in set(r.asks_for())) if held]
        heapq.heapify(heads)
        home, asked = None, -1
        while heads and home is None:
            n, at, held = heads[0]
            if n != asked and out[n].takes(r):
                home = n
            asked = n
            if at + 1 < len(held):
                heapq.heapreplace(heads, (held[at + 1], at + 1, held))
            else:
                heapq.heappop(heads)
        if home is None:
            home = len(out)
            out.append(r)
        else:
            merge(out[home], r)
        for k in out[home].found_by():
            held = index.setdefault(k, [])
            at = bisect.bisect_left(held, home)
            if at == len(held) or held[at] != home:
                held.insert(at, home)
    return out


def merge_blocks(records: DataFrame) -> DataFrame:
    """(id, block): blocks of described records that the ordered merge cannot leave.

    A merge takes links and title from one record and may take the company from the other, so companies that share a link are one family; within
    a family only a common title or requisition, and anywhere a common link, lead from one record to another. An employer's roles are blocks of their own, dealt over tasks.
    """
    named = records.filter("company_key <> ''")
    shared = named.select("company_key", F.explode("urls").alias("value"))
    family = components(shared, "company_key", "value").withColumnRenamed("block", "family")
    known = records.select("id", "urls", "ids", "title_key", "company_key").join(family, "company_key", "left")
    of = F.nullif(F.coalesce("family", "company_key"), F.lit(""))
    role = F.when(F.col("title_key") != "", F.concat_ws("|", F.lit("role"), of, "title_key"))
    values = F.concat(F.transform("urls", lambda u: F.concat(F.lit("url|"), u)), F.array(F.when(of.isNotNull(), role), F.concat(F.lit("="), F.col("id").cast("string"))), F.transform("ids", lambda i: F.when(of.isNotNull(), F.concat_ws("|", F.lit("id"), of, i))))
    return components(known.select("id", F.explode(F.array_compact(values)).alias("value")), "id", "value")


SETS = ("urls", "ids", "direct", "url_ids", "direct_url_ids", "places")
_KEPT = {"company": "string", "title": "string", "posting_url": "string", "job_id": "string", "locations": "array<string>", **{c: t for c, (t, _) in PAYLOAD.items()}}


def _plain_values(a: pa.Array) -> list:
    """A column's values; structs as tuples, moments as whole numbers. Lists are cut from their flat values, which costs a fraction of ``to_pylist``."""
    if pa.types.is_list(a.type):
        ends = a.offsets.to_numpy()
        flat, first = _plain_values(a.values[ends[0] : ends[-1]]), ends[0]
        places = (ends - first).tolist()
        full = [True] * len(a) if a.null_count == 0 else a.is_valid().to_pylist()
        return [flat[i:j] if some else None for i, j, some in zip(places[:-1], places[1:], full, strict=True)]
    if pa.types.is_struct(a.type):
        return list(zip(*map(_plain_values, a.flatten()), strict=True))
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.int64())
    quick = pa.types.is_string(a.type) or (pa.types.is_primitive(a.type) and a.null_count == 0)
    return a.to_numpy(zero_copy_only=False).tolist() if quick else a.to_pylist()


def deduplicated(records: DataFrame, block: str) -> DataFrame:
    """(merged_id, members, and the merged record's fields) by the ordered fold inside each block of described ``records``.

    ``block`` is a column that merging cannot leave; ``base_quality`` a record's quality but for its description and requirements.
    """

    columns = [*dict.fromkeys(["id", "base_quality", *SETS, "provider_key", "company_key", "title_key", "aggregator", "posting_aggregator", *_KEPT])]
    out_names = ["merged_id", "members", *_KEPT]
    schema = StructType.fromDDL("merged_id bigint, members array<bigint>, " + ", ".join(f"{c} {t}" for c, t in _KEPT.items()))
    kinds = to_arrow_schema(schema)

    def folded(rows: list[dict]) -> list[Record]:
        for v in rows:
            for c in SETS:
                v[c] = set(v[c])
            v["locations"] = v["locations"] or []
            v["quality"] = _quality(v)
        return fold(rows)

    def batch(found: list[Record]) -> pa.RecordBatch:
        for r in found:
            r.v["provenance"] = [dict(zip(("field", "value", "page"), e, strict=True)) for e in r.v["provenance"] or ()]
        data = {"merged_id": [r.members[0] for r in found], "members": [r.members for r in found]} | {c: [r.v[c] for r in found] for c in _KEPT}
        kind = lambda c: kinds.field(c).type
        return pa.RecordBatch.from_arrays([pa.array(data[c], pa.int64()).cast(kind(c)) if pa.types.is_timestamp(kind(c)) else pa.array(data[c], kind(c)) for c in out_names], names=out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and id: one block is held at a time, and the records of small blocks until a batch of them goes out."""
        now, held, found = None, [], []
        for b in filter(len, batches):
            names = b.schema.names
            for row in zip(*map(_plain_values, b.columns), strict=True):
                v = dict(zip(names, row, strict=True))
                if v["block"] != now and held:
                    found += folded(held)
                    held = []
                    if len(found) >= 2000:
                        yield batch(found)
                        found = []
                now = v["block"]
                held.append(v)
        if held:
            found += folded(held)
        if found:
            yield batch(found)

    clean = {c: text.unique_items(F.col(c)) for c in ("locations", *LISTS)}
    rows = records.withColumns(clean).select(F.col(block).alias("block"), *columns)
    return rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, schema)
