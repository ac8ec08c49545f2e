"""Rules that classify listings, compiled to Column expressions when the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pattern_of
from .urls import ATS_HOSTS, host, is_under

# The patterns of placements, titles and responsibilities.
PLACEMENT_TITLE = r"\b(?:intern(?:s|ship(?:s)?)?|co[ -]?ops?|cooperative education|students?|undergrad(?:uate)?s?|graduates?|university|college|campus|placement|work[- ]?term|summer (?:analyst|associate|program)|industrial placement)\b"
EXPLICIT_PLACEMENT_TITLE = r"\b(?:intern(?:s|ship(?:s)?)?|co[ -]?ops?|cooperative education|student(?:s)?[ -](?:program|role|position|placement|opportunity)|undergrad(?:uate)?[s ]+(?:program|role|position|placement|opportunity)|graduate[s ]+(?:program|role|position|placement|opportunity)|summer (?:analyst|associate|program)|industrial placement|work[- ]?term)\b"
DIRECT_PLACEMENT = r"\b(?:intern(?:s|ship(?:s)?)?|co[ -]?ops?|cooperative education)\b"
RELATED_PLACEMENT = r"\b(?:for|open\s+to|available\s+to|intended\s+for)\s+(?:current\s+)?(?:students?|undergrad(?:uate)?s?|graduates?)\b|\b(?:university|college|campus)\s+(?:program|placement|recruiting|role|position|opportunity)\b|\b(?:work[- ]?term|placement\s+year|summer\s+(?:analyst|associate|program)|industrial\s+placement)\b"
STUDY_CONTEXT = r"\b(?:currently\s+)?(?:enrolled|studying|attending|pursuing)\b[^.\n]{0,80}\b(?:student|degree|undergrad(?:uate)?|graduate|university|college|school|program)\b|\b(?:student|undergrad(?:uate)?|graduate)\s+(?:role|position|program|placement|opportunity|term)\b|\b(?:return(?:ing)?|back)\s+to\s+(?:school|university|college)\b|\b(?:academic|school|university|college)\s+(?:term|year|schedule)\b"
PERMANENT_TITLE = r"\b(?:senior|staff|principal|lead|manager|director|permanent|full[ -]?time)\b"
TARGET_TERM = r"\b(?:summer(?:\s+of)?\s+2027|2027\s+summer)\b"
SOFTWARE_TITLE = r"\b(?:software|developer|front[ -]?end|back[ -]?end|full[ -]?stack|mobile|ios|android|sdet|test automation|automation engineer|qa engineer|devops|site reliability|sre|platform engineer|cloud engineer|infrastructure engineer|data engineer|machine learning|ml engineer|ai engineer|computer vision|nlp|embedded software|firmware|security engineer|cybersecurity|quantitative developer|research engineer|robotics software)\b"
TECHNICAL_TITLE = r"\b(?:technology|technical|systems?|data|automation|platform|research|quantitative|robotics|security|engineering)\b"
OTHER_TITLE = r"\b(?:sales|marketing|human resources|recruit(?:er|ing)|accounting|product manager|business analyst|financial analyst|investment banking|mechanical|civil|chemical|help desk|desktop support|customer support)\b"
ACTIONS = [
    r"\b(?:write|writing|develop|developing|build|building|implement|implementing|maintain|maintaining|debug|debugging) (?:[\w -]+ )?(?:code|software|applications?|services?|systems?|features?|apis?|algorithms?|pipelines?)\b",
    r"\bsoftware (?:development|engineering|testing)\b",
    r"\b(?:design|develop|consume|test) (?:rest(?:ful)? |web )?apis?\b",
    r"\b(?:test automation|automated testing|unit tests?|integration tests?|ci\s*\/\s*cd)\b",
    r"\b(?:data pipelines?|distributed systems?|machine learning models?|computer vision|natural language processing)\b",
    r"\bprogramming (?:language|experience|skills?)\b",
]
OTHER_CONTEXT = r"\b(?:cold call|lead generation|social media campaign|accounts payable|financial reporting|talent acquisition|recruiting pipeline|customer tickets?|hardware assembly|mechanical design)\b"
SOFTWARE_STUDIES = r"\b(?:computer science|software engineering|computer engineering|data structures|algorithms|programming)\b"
CATEGORIES = {
    "frontend": r"\b(?:front[ -]?end|react|angular|vue|user interface|web ui)\b",
    "backend": r"\b(?:back[ -]?end|server[ -]?side|api development|microservices?|distributed systems?)\b",
    "fullstack": r"\bfull[ -]?stack\b",
    "mobile": r"\b(?:mobile|ios|android|swift|kotlin)\b",
    "qa": r"\b(?:qa|quality assurance|sdet|test automation|software test)\b",
    "devops": r"\b(?:devops|site reliability|sre|ci\s*\/\s*cd|release engineering)\b",
    "cloud": r"\b(?:cloud engineering|aws|azure|gcp|kubernetes|infrastructure as code)\b",
    "data": r"\b(?:data engineer|data science|data pipeline|etl|analytics engineering|sql)\b",
    "ml": r"\b(?:machine learning|deep learning|tensorflow|pytorch|ml engineer)\b",
    "ai": r"\b(?:artificial intelligence|applied ai|ai engineer|computer vision|natural language processing|\bnlp\b|large language model|\bllm)\b",
    "security": r"\b(?:cybersecurity|security engineer|application security|penetration test|security automation)\b",
    "embedded": r"\b(?:embedded|firmware|microcontroller|real[ -]?time operating|robotics software)\b",
    "quant": r"\b(?:quantitative developer|quant developer|algorithmic trading|quantitative research)\b",
    "research": r"\b(?:research engineer|research intern|applied scientist|technical research)\b",
    "swe": r"\b(?:software engineer(?:ing)?|software developer|software development|developer intern|programmer)\b",
}
TECHNOLOGIES = {
    "Python": r"\bpython\b", "Java": r"\bjava(?!script)\b", "C++": r"\bc\+\+|\bcpp\b", "C#": r"\bc#|\bc sharp\b", "C": r"\bprogramming (?:in|with) c\b|\bc language\b|\bc\/c\+\+",
    "JavaScript": r"\b(?:javascript|js)\b", "TypeScript": r"\btypescript\b", "React": r"\breact(?:\.js|js)?\b", "Node.js": r"\bnode(?:\.js|js)\b", "Go": r"\b(?:golang|go programming)\b",
    "Rust": r"\brust\b", "Swift": r"\bswift\b", "Kotlin": r"\bkotlin\b", "Ruby": r"\bruby\b", "PHP": r"\bphp\b", "Scala": r"\bscala\b", "R": r"\br programming\b",
    "SQL": r"\b(?:sql|postgres(?:ql)?|mysql|sqlite)\b", "NoSQL": r"\b(?:nosql|mongodb|dynamodb|cassandra)\b", "Git": r"\b(?:git|github|gitlab|bitbucket)\b",
    "AWS": r"\b(?:aws|amazon web services)\b", "Azure": r"\b(?:azure|microsoft cloud)\b", "GCP": r"\b(?:gcp|google cloud)\b", "Docker": r"\bdocker\b", "Kubernetes": r"\b(?:kubernetes|k8s)\b",
    "Terraform": r"\bterraform\b", "Linux": r"\blinux\b", "TensorFlow": r"\btensorflow\b", "PyTorch": r"\bpytorch\b", "scikit-learn": r"\b(?:scikit-learn|sklearn)\b", "Pandas": r"\bpandas\b",
    "Spark": r"\b(?:apache )?spark\b", "Hadoop": r"\bhadoop\b", "Kafka": r"\b(?:apache )?kafka\b", "Airflow": r"\b(?:apache )?airflow\b", "Snowflake": r"\bsnowflake\b", "Databricks": r"\bdatabricks\b",
    "GraphQL": r"\bgraphql\b", "REST APIs": r"\b(?:rest(?:ful)? api|rest apis)\b", "CI/CD": r"\b(?:ci\s*\/\s*cd|continuous integration|continuous delivery)\b", "Selenium": r"\bselenium\b",
    "Playwright": r"\bplaywright\b", "Cypress": r"\bcypress\b", "Unity": r"\bunity\b", "CUDA": r"\bcuda\b", "ROS": r"\b(?:ros|robot operating system)\b",
}
# Keywords of which a listing needs one of each kind.
TECHNICAL_KEYWORDS = [
    "software", "developer", "development", "frontend", "front end", "front-end", "backend", "back end", "back-end", "full stack", "full-stack", "fullstack", "web", "mobile",
    "ios", "android", "data", "analytics", "machine learning", "ml", "artificial intelligence", "ai", "ai/ml", "genai", "generative ai", "computer vision", "nlp",
    "natural language processing", "robotics", "autonomy", "autonomous", "perception", "computer science", "computer engineering", "quality assurance", "qa", "test", "testing",
    "automation", "sdet", "cloud", "devops", "devsecops", "site reliability", "sre", "platform", "infrastructure", "systems", "network", "networking", "database", "algorithm",
    "algorithmic", "graphics", "blockchain", "scientific computing", "information technology", "it", "technology", "technical", "programming", "programmer",
]
PLACEMENT_KEYWORDS = r"intern(?:ship)?s?|co[\s\-–—‑]?ops?|students?|trainees?|placements?|work[\s\-–—‑]+terms?|pey"
# Weights of terms by field, and the bounds of each field's sum.
WEIGHTS = {
    "title_positive": {"software engineer": 72, "software engineering": 72, "software developer": 72, "software development": 64, "frontend": 68, "front-end": 68, "backend": 68, "back-end": 68, "full stack": 68, "full-stack": 68, "developer": 64, "programmer": 60, "qa automation": 64, "test automation": 64, "sdet": 64, "data engineer": 66, "data science": 66, "machine learning": 68, "ml engineer": 68, "artificial intelligence": 66, "ai engineer": 66, "cybersecurity": 64, "security engineer": 64, "embedded software": 66, "firmware": 62, "devops": 62, "site reliability": 62, "sre": 58, "cloud engineer": 62, "platform engineer": 58, "automation engineer": 58, "robotics software": 62, "quantitative developer": 62, "research engineer": 58},
    "title_ambiguous": {"technology": 30, "technical": 30, "engineering": 28, "systems": 27, "platform": 26, "automation": 26, "data": 25, "research": 24, "robotics": 30, "security": 30, "quantitative": 26},
    "title_negative": {"marketing": 78, "human resources": 82, "hr": 78, "recruiting": 82, "recruiter": 82, "legal": 82, "attorney": 82, "accounting": 78, "accountant": 78, "sales": 78, "business development": 70, "communications": 76, "public relations": 76, "customer support": 74, "help desk": 74},
    "department_positive": {"software": 26, "engineering": 22, "developer": 26, "development": 22, "data science": 24, "machine learning": 25, "artificial intelligence": 25, "cybersecurity": 24, "platform": 20, "infrastructure": 22, "qa": 22},
    "department_negative": {"marketing": 42, "human resources": 45, "legal": 45, "accounting": 42, "sales": 42, "communications": 42},
    "snippet_positive": {"write code": 14, "develop software": 14, "programming": 12, "software development": 12, "api": 10, "automated testing": 11, "data pipeline": 12, "machine learning": 12, "cloud": 9, "python": 8, "typescript": 8, "java": 8, "c++": 8, "sql": 7},
    "snippet_negative": {"cold calling": 28, "social media campaign": 26, "accounts payable": 26, "talent acquisition": 28, "customer tickets": 24, "financial reporting": 24},
}
BOUNDS = {"title_ambiguous": 34, "title_negative": 100, "department_positive": 34, "department_negative": 50, "snippet_positive": 28, "snippet_negative": 36}
# What pages say that are not found or closed, in the order in which it is tried, and pages that ask for a login or a proof.
GONE = [
    ("not-found", "Page not found", r"\bthe page you(?: are|['’]re) (?:looking for|seeking) (?:doesn['’]?t|does not|cannot|can['’]?t) exist\b"),
    ("not-found", "Page not found", r"\bthe page you(?: are|['’]re) (?:looking for|seeking) (?:couldn['’]?t|could not|cannot|can['’]?t) be found\b"),
    ("not-found", "Page not found", r"\b(?:the )?(?:requested )?(?:page|resource) (?:doesn['’]?t|does not|cannot|can['’]?t) exist\b"),
    ("not-found", "Page not found", r"\b(?:page|resource) (?:not found|couldn['’]?t be found|could not be found|cannot be found|can['’]?t be found)\b"),
    ("not-found", "Page not found", r"\b(?:this|the) (?:page|resource) (?:is|has been|was) (?:removed|unavailable|not available)\b"),
    ("not-found", "Job not found", r"\b(?:this|the) (?:job|position|listing|opportunity|requisition) (?:doesn['’]?t|does not|cannot|can['’]?t) exist\b"),
    ("not-found", "Job not found", r"\b(?:this|the) (?:job|position|listing|opportunity|requisition) (?:couldn['’]?t|could not|cannot|can['’]?t) be found\b"),
    ("not-found", "Page not found", r"\b(?:we|our system) (?:couldn['’]?t|could not|cannot|can['’]?t) find (?:the |this |that )?(?:requested )?(?:page|resource|job|position|listing|opportunity|requisition)\b"),
    ("not-found", "Page not found", r"\bpage\s+not\s+found\b|\b404\s+not\s+found\b"),
    ("closed", "Job no longer available", r"\b(?:this|the) (?:job|position|listing|opportunity|requisition) (?:is|has been|was) no longer available\b"),
    ("closed", "Job expired", r"\b(?:this|the) (?:job|position|listing|opportunity|requisition) has expired\b"),
    ("closed", "Job posting removed or closed", r"\b(?:this|the) (?:job|position|listing|opportunity|requisition|posting) has been (?:removed|closed)\b"),
    ("closed", "No longer accepting applications", r"\bno longer accepting applications\b"),
]
FOOTER = r"\b(?:site|website|page)\s+footer\b"
ACCESS = r"(?:complete|solve) the captcha|captcha challenge|verify (?:that )?you are human|access denied|sign in to (?:continue|view)|log in to (?:continue|view)"
LOGIN_PATH = r"/(?:login|signin|signup)(?:[/?#]|$)"


def says(c: Column, pattern: str) -> Column:
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit(f"(?i){pattern}"))


def half_up(c: Column) -> Column:
    """Rounded to whole numbers, halves up, also below zero."""
    return F.floor(c + 0.5).cast("int")


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(half_up(c), F.lit(low)), F.lit(high))


def factor(points: Column | int) -> Column:
    """Three quarters of the points, halves up."""
    return half_up((points if isinstance(points, Column) else F.lit(points)) * 0.75)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def labels(c: Column, rules: dict[str, str]) -> Column:
    """The names of the rules that a text meets, in their order.

    One pass finds all places at which any rule matches; the single rules are then asked about what was found there.
    """
    joined = "|".join(rules.values())
    found = F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)(?=({joined}))"), F.lit(1))), "\n")
    each = lambda x: F.array_compact(F.array(*[F.when(says(x, p), F.lit(n)) for n, p in rules.items()]))
    return let(found, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(each(x)))


def technologies(c: Column) -> Column:
    return labels(c, TECHNOLOGIES)


def position_text(c: Column) -> Column:
    """A description without the sentence that speaks of a site's footer and all that follows."""
    head = F.regexp_extract(c, rf"(?is)^(.*?){FOOTER}", 1)
    return F.when(F.contains(F.lower(c), F.lit("footer")) & says(c, FOOTER), F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)).otherwise(c)


def _body_says(body: Column) -> Column:
    return says(body, DIRECT_PLACEMENT) | says(body, STUDY_CONTEXT) | says(body, RELATED_PLACEMENT)


def has_placement(title: Column, body: Column) -> Column:
    return says(F.trim(title), PLACEMENT_TITLE) | let(position_text(body), _body_says)


def is_placement(title: Column, body: Column) -> Column:
    """A placement by its title, unless that names a permanent job and no placement outright; else by its text."""
    return F.when(says(title, PLACEMENT_TITLE), ~says(title, PERMANENT_TITLE) | says(title, EXPLICIT_PLACEMENT_TITLE)).otherwise(let(position_text(body), _body_says))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def role_score(title: Column, description: Column, studies: Column | None = None) -> Column:
    """0 to 100: placement, term, title, responsibilities, technologies and studies, less what speaks against software."""
    studies = F.lit("") if studies is None else studies
    text = F.concat_ws("\n", title, description, studies)
    placed = says(F.trim(title), PLACEMENT_TITLE) | let(F.concat_ws("\n", position_text(description), position_text(studies)), _body_says)
    n_actions = _sum([says(description, p).cast("int") for p in ACTIONS])
    points = lambda test, n: F.when(test, factor(n)).otherwise(F.lit(0))
    by_place = let(placed, lambda p: points(p & says(text, TARGET_TERM), 35) - points(~p, 60))
    work = let(n_actions, lambda n: F.when(n > 0, F.least(factor(32), factor(n * 9 + 8))).otherwise(-points(says(description, OTHER_CONTEXT), 30)))
    tools = let(F.size(technologies(text)), lambda n: F.least(factor(22), factor(n * 4)))
    by_title = points(says(title, DIRECT_PLACEMENT), 45) + F.when(says(title, SOFTWARE_TITLE), factor(38)).when(says(title, TECHNICAL_TITLE), factor(16)).otherwise(F.lit(0)) - points(says(title, OTHER_TITLE), 55)
    return clamp(by_place + by_title + work + tools + points(says(studies, SOFTWARE_STUDIES), 10))


def categories(text: Column, score: Column) -> Column:
    """Category labels; ``other-code`` where there is none and the score is at least 45."""
    return let(labels(text, CATEGORIES), lambda found: F.when((F.size(found) == 0) & (score >= 45), F.array(F.lit("other-code"))).otherwise(found))


def keyword_gate(text: Column) -> Column:
    """At least one technical and one placement keyword, as whole words of any script."""
    import re

    technical = "|".join(r"[\s\-–—‑]+".join(map(re.escape, k.split())) for k in TECHNICAL_KEYWORDS)
    whole = lambda p: F.regexp_like(F.coalesce(text, F.lit("")), F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"))
    return whole(technical) & whole(PLACEMENT_KEYWORDS)


def excluded_title(title: Column) -> Column:
    """The label of the first rule that excludes a title, null if none does."""
    return (
        F.when(F.contains(title, F.lit("2026")) & ~F.contains(title, F.lit("2027")), "2026").when(says(title, r"\bnew[\s-]+grad(?:uate)?s?\b"), "new grad").when(says(title, r"\bph\.?\s*d\.?\b"), "PhD")
        .when(says(title, r"\b12\s*[-‐‑‒–—]?\s*months?\b") & ~says(title, r"\b4\b"), "12 months without a standalone 4")
    )


def _layers(terms: list[str]) -> list[list[str]]:
    """Terms in groups of which none begins with another, so that one place matches one term of a group."""
    out: list[list[str]] = []
    for t in sorted(terms, key=len):
        home = next((g for g in out if not any(t.startswith(x) for x in g)), None)
        if home is None:
            out.append([t])
        else:
            home.append(t)
    return out


def _found(table: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(table, key), F.lit(0))


@dataclass(frozen=True)
class Weighted:
    """Weighted terms of a deployment; the defaults are ``WEIGHTS``."""

    terms: dict[str, dict[str, int]]

    def total(self, c: Column, field: str) -> Column:
        """The weights of the field's terms that a text has, each once: a pass per group of terms, and a look-up of what it found."""
        weights = self.terms[field]
        out = F.lit(0)
        for group in _layers(list(weights)):
            pattern = pattern_of(group)
            found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)(?=({pattern.removeprefix('(?i)')}))"), F.lit(1))
            keys = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")))
            table = F.create_map(*[F.lit(v) for t in group for v in (" ".join(t.lower().split()), weights[t])])
            points = F.transform(keys, partial(_found, table))
            out = out + F.aggregate(points, F.lit(0), lambda n, x: n + x)
        return F.least(out, F.lit(BOUNDS[field])) if field in BOUNDS else out

    def score(self, title: Column, department: Column, snippet: Column) -> Column:
        head = F.least(F.lit(100), self.total(title, "title_positive") + self.total(title, "title_ambiguous") - self.total(title, "title_negative"))
        part = self.total(department, "department_positive") - self.total(department, "department_negative")
        return clamp(head + part + self.total(snippet, "snippet_positive") - self.total(snippet, "snippet_negative"))

    def rejects(self, title: Column, department: Column, snippet: Column) -> Column:
        """Nothing technical in any field, and something that speaks against it."""
        fields = {"title": title, "department": department, "snippet": snippet}
        any_of = lambda negative: reduce(or_, [F.regexp_like(F.coalesce(fields[f.split("_")[0]], F.lit("")), F.lit(pattern_of(list(t)))) for f, t in self.terms.items() if f.endswith("negative") == negative])
        return any_of(True) & ~any_of(False)


def relevance(title: Column, department: Column, snippet: Column, rules: dict[str, dict[str, int]] | None = None) -> Column:
    return Weighted(rules or WEIGHTS).score(title, department, snippet)


def page_content(body: Column) -> Column:
    """(state, reason) of a page that says it is not found or closed, null for any other; the first rule that fits."""
    out = None
    for state, reason, pattern in GONE:
        value = F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
        out = F.when(says(body, pattern), value) if out is None else out.when(says(body, pattern), value)
    return F.when(F.length(F.coalesce(body, F.lit(""))) > 0, out)


def closed_reason(status: Column, url: Column, body: Column) -> Column:
    """Why a landed page is closed, null if it is open: its status, a page that is not found, or, on a page of one posting, what it says."""
    detail = F.regexp_like(url, F.lit(r"(?i)^https?://[^/]+(?:/[^/?#]+)*/(?:jobs?|positions?|requisitions?|job-postings?)/[^/?#]+")) | (is_under(host(url), ATS_HOSTS) & F.regexp_like(url, F.lit(r"^https?://[^/]+/+[^/?#]+/+[^/?#]+")))
    reason = lambda c: F.when(c.isNotNull() & ((c["state"] == "not-found") | detail), c["reason"])
    return F.when(status == 404, "HTTP 404").when(status == 410, "HTTP 410 Gone").otherwise(let(page_content(body), reason))


def rejected(title: Column, company: Column, description: Column, score: Column, least: int, located: Column, dead: Column, unclassified: bool = False) -> Column:
    """Why a posting is not admitted, the first reason that holds: its title, an incomplete page (a description under 80 characters), no placement,
    the score, no category (unless ``unclassified`` postings are welcome), the location, a dead link. Null if it is."""
    none = F.lit(False) if unclassified else F.size(categories(F.concat_ws("\n", title, description, F.lit("")), score)) == 0
    return (
        F.when(excluded_title(title).isNotNull(), "title").when((F.coalesce(F.trim(title), F.lit("")) == "") | (F.coalesce(F.trim(company), F.lit("")) == "") | (F.length(F.coalesce(description, F.lit(""))) < 80), "incomplete")
        .when(~is_placement(title, description), "not a placement").when(score < least, "score").when(none, "no category").when(~located, "location").when(dead, "dead link")
    )


def link_state(status: Column, url: Column, body: Column) -> Column:
    """closed, access-controlled, reachable or failed: a page that says it is closed, then what keeps visitors out, then what is gone,
    then the status."""
    walled = status.isin(401, 403, 407, 429) | says(body, ACCESS) | says(url, LOGIN_PATH)
    found = lambda c: (
        F.when(c == "closed", "closed").when(walled, "access-controlled").when(status.isin(404, 410) | (c == "not-found"), "closed")
        .when((status >= 200) & (status < 400), "reachable").otherwise("failed")
    )
    return let(F.coalesce(page_content(body)["state"], F.lit("")), found)


_SENTENCE = r"(?<=[.!?])\s+|\n+"


def _about(c: Column, word: str) -> Column:
    """The sentences of a text if it has the word at all, else none."""
    return F.when(F.contains(F.lower(c), F.lit(word)), F.split(c, _SENTENCE)).otherwise(F.array().cast("array<string>"))


def needs_clearance(c: Column) -> Column:
    """A sentence asks for a security clearance and does not deny that it does."""
    return F.coalesce(F.exists(_about(c, "clearance"), lambda s: says(s, r"\b(?:security|secret|top[- ]secret|ts/sci)\s+clearance\b") & ~says(s, r"\b(?:no|not|without|isn't)\b[^.]{0,40}\bclearance\b|\bclearance\b[^.]{0,30}\bnot (?:required|needed|necessary)\b")), F.lit(False))


def requirement(c: Column, topic: str) -> Column:
    """required, preferred, not_required, conflict or unknown: what the sentences on a topic say."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), _SENTENCE), lambda s: says(s, topic))
    none = r"\b(?:not|no longer) (?:required|necessary|needed)\b|\bno\b[^.]{0,40}\brequire"
    said = F.transform(parts, lambda s: F.when(says(s, none), "no").when(says(s, r"\b(?:preferred|nice to have|a plus|asset|desired)\b"), "wish").when(says(s, r"\b(?:required|requires?|must|need(?:s|ed)? to)\b"), "yes").otherwise(""))
    has = lambda x, v: F.array_contains(x, v)
    return let(said, lambda x: F.when(has(x, "yes") & has(x, "no"), "conflict").when(has(x, "yes"), "required").when(has(x, "no"), "not_required").when(has(x, "wish"), "preferred").otherwise("unknown"))
