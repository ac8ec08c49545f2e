"""Link functions: parts, canonical form, requisition ids, kinds of hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that track, that identify a requisition, and that carry credentials.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src", "source", "ref", "referrer", "tracking", "trk", "visit", "fbclid", "gclid", "embed", "mc_cid", "mc_eid", "oly_enc_id", "oly_anon_id", "vero_id", "yclid", "msclkid", "_ga", "_gl"]
IDENTIFYING = ["jobid", "job_id", "gh_jid", "reqid", "requisitionid", "requisition_id", "positionid", "position_id", "postingid", "posting_id", "externaljobid", "external_job_id"]
SENSITIVE = ["token", "access_token", "auth", "authorization", "key", "api_key", "apikey", "mcp_token", "session", "session_id", "secret", "signature", "credential"]
#: Keys that hold a requisition's id, in the order in which they are asked.
ID_KEYS = ["jobid", "job_id", "gh_jid", "reqid", "req_id", "requisitionid", "requisition_id", "positionid", "position_id", "postingid", "posting_id", "externaljobid", "external_job_id"]
#: Hosts of applicant systems and of boards that gather listings, and the providers' names.
ATS_HOSTS = ["greenhouse.io", "lever.co", "myworkdayjobs.com", "ashbyhq.com", "smartrecruiters.com", "jobvite.com", "icims.com", "taleo.net", "eightfold.ai", "ripplematch.com"]
AGGREGATOR_HOSTS = ["applybolt.app", "dreamworkhq.com", "hiringcafe.com", "interninsider.me", "intern-list.com", "jobright.ai", "simplify.jobs", "useno.app", "wellfound.com"]
PROVIDERS = {"greenhouse.io": "greenhouse", "lever.co": "lever", "myworkdayjobs.com": "workday", "ashbyhq.com": "ashby", "smartrecruiters.com": "smartrecruiters", "jobvite.com": "jobvite", "icims.com": "icims", "taleo.net": "taleo", "eightfold.ai": "eightfold", "github.com": "github", "raw.githubusercontent.com": "github"}
_URL = r"^(?i:(https?)://)([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: An address that is canonical as it stands: most are.
_CANONICAL = r"^https?://[a-z0-9._-]+/(?:[^?#]*[^?#/])?\z"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, group)


def host(url: Column) -> Column:
    """Lower-case host name, empty if it is no web address."""
    return F.lower(part(url, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return part(url, 4)


def is_under(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.regexp_like(name, F.lit(r"(^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"))


def canonical(url: Column) -> Column:
    """Without fragment, tracking and secret parameters, default port and slash at the end; parameters sorted. Null if it is no
    web address. The key ``ref`` selects a branch on code hosts, where it stays."""
    name = host(url)
    scheme, port = F.lower(part(url, 1)), part(url, 3)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    code = is_under(name, ["github.com", "raw.githubusercontent.com"])
    drops = lambda p: (key(p).isin(TRACKING) & ~key(p).isin(IDENTIFYING) & ~(code & (key(p) == "ref"))) | key(p).isin(SENSITIVE)

    def query(text: Column) -> Column:
        pairs = F.filter(F.split(text, "&"), lambda p: (p != "") & ~drops(p))
        kept = F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
        shown = F.array_join(kept, "&")
        return F.get(F.transform(F.array(shown), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))), F.lit(0))

    way = F.when(F.length(path(url)) > 1, F.regexp_replace(path(url), r"/+$", "")).otherwise(F.lit("/"))
    shown = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    asked = F.when(F.contains(url, F.lit("?")), query(part(url, 5))).otherwise(F.lit(""))
    return F.when(F.regexp_like(url, F.lit(_CANONICAL)), url).when(name != "", F.concat(scheme, F.lit("://"), name, shown, way, asked))


def job_url(url: Column) -> Column:
    """The canonical link of the posting itself: no ``/apply`` or ``/application`` at the end of its path."""
    return without_form(canonical(url))


def without_form(link: Column) -> Column:
    """A canonical link without the application form's part."""
    return F.regexp_replace(link, r"/(?i:apply|application)/?(?=\?|$)", "")


def job_id(url: Column) -> Column:
    """The requisition's id: a known parameter, else what the path's last parts show; null if none."""
    asked = F.array(*map(F.lit, ID_KEYS))
    # the least by key, then by place, of the parameters that name an id
    pairs = F.transform(F.split(part(url, 5), "&"), lambda p, i: F.struct(F.array_position(asked, F.lower(F.substring_index(p, "=", 1))).alias("rank"), i.alias("i"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    named = F.array_min(F.filter(pairs, lambda p: (p["rank"] > 0) & (p["v"] != "")))["v"]
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    def shown(way: Column) -> Column:
        last = F.try_element_at(F.filter(F.split(way, "/"), lambda s: s != ""), F.lit(-1))
        return F.coalesce(
            found(F.coalesce(last, F.lit("")), r"(?:^|[_-])((?i:jr|req|rq|r)[-_]?[A-Za-z0-9]+(?:_[A-Za-z0-9]+)?)(?:[-_]\d+)?$"),
            found(way, r"/(?i:jobs?|positions?|requisitions?|postings?)/(?:[^/]+/)?([A-Za-z]?[0-9]{3,})/?$"),
            found(way, r"/(?i:jobs?|positions?|requisitions?)/(?:[^/]+/)?([A-Za-z0-9_-]{3,})/?$"),
            found(way, r"/(?i:job)/[^/]+/([A-Za-z0-9_-]{3,})/?$"),
            found(way, r"/([JRjr]?[0-9]{4,})/?$"),
        )

    return F.coalesce(F.when(part(url, 5) != "", named), F.get(F.transform(F.array(path(url)), shown), F.lit(0)))


def host_class(url: Column) -> Column:
    """ats, aggregator, linkedin, github or other; null if it is no web address."""
    name = host(url)
    return (
        F.when(name == "", None).when(is_under(name, ATS_HOSTS), "ats").when(is_under(name, AGGREGATOR_HOSTS), "aggregator")
        .when(is_under(name, ["linkedin.com"]) & F.regexp_like(path(url), F.lit(r"(?i)/jobs(-guest)?(/|$)")), "linkedin").when(is_under(name, ["github.com"]), "github").otherwise("other")
    )


def is_landing(url: Column) -> Column:
    """An employer's page on a board, which many requisitions share."""
    return is_under(bare_host(url), ["dreamworkhq.com"]) & F.regexp_like(path(url), F.lit(r"(?i)^/c/[^/]+/?$"))


def provider(url: Column) -> Column:
    """The applicant system's name, else the bare host."""
    out = None
    for domain, name in PROVIDERS.items():
        test = F.endswith(bare_host(url), F.lit(domain))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(bare_host(url))


def organization(url: Column) -> Column:
    """The employer's token: subdomain or first part of the path on applicant systems, else the second-level domain."""
    name, first = bare_host(url), F.regexp_extract(path(url), r"^/+([^/]+)", 1)
    token = (
        F.when(F.endswith(name, F.lit("myworkdayjobs.com")), F.regexp_extract(name, r"^(.*?)(?:\.wd\d*\.|$)", 1))
        .when(F.regexp_like(name, F.lit(r"(?:greenhouse\.(?:io|com)|lever\.co|ashbyhq\.com)$")), first)
        .when(F.endswith(name, F.lit("applytojob.com")), F.substring_index(name, ".", 1))
        .otherwise(F.regexp_extract(name, r"([^.]+)(?:\.[^.]+)?$", 1))
    )
    return F.regexp_replace(F.lower(token), r"[^a-z0-9]+", "")


def same_site(a: Column, b: Column) -> Column:
    x, y = bare_host(a), bare_host(b)
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)))


# Tokens of links that stand for a company's own name.
COMPANY_NAMES = {
    "axontalentcommunity": "Axon", "caicambiumassessmentinc": "Cambium Assessment", "cambiumassessment": "Cambium Assessment", "geocomply2": "GeoComply", "globalhr": "RTX", "joinbytedance": "ByteDance", "ibmsoftware": "IBM",
    "object": "Object Tech, Inc.", "objecttechinc": "Object Tech, Inc.", "wd": "Western Digital",
}


def company_of(url: Column) -> Column:
    """A company's name guessed from its link: the first part of the path or the tenant on applicant systems, else the second-level
    domain, its words with capitals; null if it is no web address."""
    name, slug = bare_host(url), F.regexp_extract(path(url), r"^/+([^/]+)", 1)
    tenant = F.substring_index(name, ".", 1)
    token = F.when(F.regexp_like(name, F.lit(r"(?:greenhouse\.io|lever\.co|ashbyhq\.com)$")) & (slug != ""), slug)
    token = token.when(F.endswith(name, F.lit("myworkdayjobs.com")) & ~F.regexp_like(tenant, F.lit(r"^wd\d+$")) & (tenant != "myworkdayjobs"), tenant).otherwise(F.regexp_extract(name, r"([^.]+)(?:\.[^.]+)?$", 1))
    names = F.create_map(*[F.lit(x) for pair in COMPANY_NAMES.items() for x in pair])
    return F.when(name != "", F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(token), "[^a-z0-9]+", "")), F.initcap(F.trim(F.regexp_replace(token, "[-_]+", " ")))))


def is_public(url: Column) -> Column:
    """Whether a link may be fetched: a web address whose host is neither a local name nor a literal private, loopback, link-local,
    shared, documentation or multicast address. Names are not resolved."""
    name = host(url)
    octet = lambda k: F.try_element_at(F.split(name, r"\."), F.lit(k)).try_cast("int")
    a, b = octet(1), octet(2)
    literal = F.regexp_like(name, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19, 51)) | ((a == 203) & (b == 0))
    local = F.regexp_like(name, F.lit(r"(^|\.)(localhost|local|internal|home\.arpa)$")) | ~F.contains(name, F.lit("."))
    return (name != "") & ~local & ~(literal & F.coalesce(closed, F.lit(False)))
