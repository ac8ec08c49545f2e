"""What a posting's sentences require: facts, graduation years, years of study, and states with conflicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import let, says

# Patterns of sentences on education, graduation and experience, and headings in front of them.
EDUCATION = r"\b(?:pursuing|enrolled|bachelor(?:'s|s)?|master(?:'s|s)?|ph\.?d\.?|computer science|computer engineering|university|college|(?:undergraduate|graduate) degree|degree (?:in|program|from))\b"
GRADUATION = r"\b(?:graduat(?:e|es|ed|ing|ion)|class of|return(?:ing)? to (?:school|university)|penultimate year|(?:first|second|third|sophomore|junior|senior) (?:year|standing|student)|entering (?:their )?[^.]{0,80}\byear)\b"
EXPERIENCE = r"\b(?:(?:\d+|one|two|three|four|five)\+? years?|prior|previous|hands-on) (?:of )?(?:professional |industry |work )?experience\b|\bexperience (?:with|in|using)\b"
HEADING = r"(?i)^(?:(?:(?:minimum|required|basic|preferred) qualifications?|required skills?|education)\s*:?\s*)+"
GRADUATION_SIGNAL = r"\b(?:graduat(?:e|es|ed|ing|ion)|class\s+of|expected\s+graduation|graduate\s+by|degree\s+completion)\b"
YEAR = r"\b(20\d{2})\b"
YEARS = r"(?i)\b(?:between\s+)?(20\d{2})\s*(?:-|–|—|to|through|and)\s*(20\d{2})\b"
# Words for the years of study, and for who may or must be in them.
STUDY_YEARS = {
    "first-year": r"\b(?:first[- ]year|freshman|freshmen|1st[- ]year|year\s*1)\b", "second-year": r"\b(?:second[- ]year|sophomore|sophomores|2nd[- ]year|year\s*2)\b", "third-year": r"\b(?:third[- ]year|junior|juniors|3rd[- ]year|year\s*3)\b",
    "fourth-year": r"\b(?:fourth[- ]year|senior|seniors|4th[- ]year|year\s*4)\b", "fifth-year": r"\b(?:fifth[- ]year|5th[- ]year)\b",
    "upper-year": r"\b(?:penultimate|upper[- ]year|upperclass(?:man|men)?|rising\s+(?:sophomore|sophomores|junior|juniors|senior|seniors))\b",
}
FIRST_YEAR_NO = r"\b(?:not|no|ineligible|exclude|excluding|cannot|can['’]?t|must be at least|second[- ]year or above|upper[- ]year)\b"
FIRST_YEAR_YES = r"\b(?:eligible|welcome|welcomed|open to|accept(?:s|ing)?|may apply|encouraged to apply)\b"
UPPER = [
    r"\b(?:second|third|fourth|fifth)[- ]year\s+or\s+(?:above|later)\b",
    r"\b(?:at\s+least|minimum\s+(?:of|is)|must\s+be)\s+(?:a\s+)?(?:sophomore|junior|senior|second[- ]year|third[- ]year|fourth[- ]year)\b",
    r"\b(?:only|preferred|nice to have|nice-to-have|ideal|plus|asset)\b",
]
UPPER_SOFT, UPPER_HARD = r"\b(?:preferred|welcome|encouraged|may be)\b", r"\b(?:must|required|need(?:s)?|at least)\b"
# Fixed values: (required, preferred, not required) by topic.
TOPICS = {
    "student": (
        r"\b(?:must|need(?:s)?|required to be|currently|active|pursuing|enrolled|registered|attending)\b[^.!?;\n]{0,100}\b(?:student|undergraduate|graduate student|degree|program)\b|\b(?:student|undergraduate|graduate student)s?\s+only\b",
        r"\b(?:student|undergraduate|graduate student|enrolled|pursuing)\b[^.!?;\n]{0,80}\b(?:preferred|nice to have|ideal|plus)\b|\b(?:preferred|nice to have|ideal|plus)\b[^.!?;\n]{0,80}\b(?:student|undergraduate|graduate student|enrolled|pursuing)\b",
        r"\b(?:no|not|without|does not|doesn['’]?t|do not|don['’]?t)\b[^.!?;\n]{0,80}\b(?:need to be|currently )?(?:a\s+)?(?:student|enrolled|registered|attending)\b|\b(?:students?|undergraduates?|graduates?)\s+and\s+(?:recent\s+)?graduates?\s+(?:are\s+)?(?:welcome|eligible|may apply)\b",
    ),
    "enrollment": (
        r"\b(?:must|need(?:s)?|required to be|currently|active)\b[^.!?;\n]{0,80}\b(?:enrolled|registered|attending|matriculated)\b|\b(?:enrolled|registered|attending|matriculated)\s+(?:in|at)\b",
        r"\b(?:enrolled|registered|attending|matriculated)\b[^.!?;\n]{0,80}\b(?:preferred|nice to have|ideal|plus)\b|\b(?:preferred|nice to have|ideal|plus)\b[^.!?;\n]{0,80}\b(?:enrolled|registered|attending|matriculated)\b",
        r"\b(?:no|not|without|does not|doesn['’]?t|do not|don['’]?t)\b[^.!?;\n]{0,80}\b(?:need to be|currently )?(?:enrolled|registered|attending|matriculated)\b|\b(?:recent\s+)?graduates?\s+(?:are\s+)?(?:welcome|eligible|may apply)\b",
    ),
    "returning": (
        r"\b(?:must|need(?:s)?|required to|will be expected to)\b[^.!?;\n]{0,100}\b(?:return(?:ing)?|re[- ]?enroll|go back)\s+(?:to|in)\s+(?:school|college|university|their program)\b",
        r"\b(?:return(?:ing)?|re[- ]?enroll|go back)\s+(?:to|in)\s+(?:school|college|university|their program)\b[^.!?;\n]{0,80}\b(?:preferred|nice to have|ideal|plus)\b|\b(?:preferred|nice to have|ideal|plus)\b[^.!?;\n]{0,80}\b(?:return(?:ing)?|re[- ]?enroll)\b",
        r"\b(?:no|not|without|does not|doesn['’]?t|do not|don['’]?t)\b[^.!?;\n]{0,80}\b(?:need to|have to|be expected to)\s+(?:return(?:ing)?|re[- ]?enroll|go back)\s+(?:to|in)\s+(?:school|college|university|their program)\b",
    ),
}


def facts(sentences: Column) -> Column:
    """(education, graduation, experience): the sentences that state each, without a heading in front."""
    units = F.filter(F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, HEADING, ""))), lambda s: s != "")
    on = lambda u, p: F.array_distinct(F.filter(u, lambda s: says(s, p)))
    return let(units, lambda u: F.struct(on(u, EDUCATION).alias("education"), on(u, GRADUATION).alias("graduation"), on(u, EXPERIENCE).alias("experience")))


def graduation(sentences: Column) -> Column:
    """(years, first, last): years of sentences on graduation, sorted, and their range: explicit ranges, else contiguous years, else none."""
    told = F.filter(sentences, lambda s: says(s, GRADUATION_SIGNAL))
    years = lambda ss: F.array_sort(F.array_distinct(F.flatten(F.transform(ss, lambda s: F.transform(F.regexp_extract_all(s, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))))
    ends = lambda ss, g: F.flatten(F.transform(ss, lambda s: F.transform(F.regexp_extract_all(s, F.lit(YEARS), F.lit(g)), lambda y: y.cast("int"))))

    def ranged(x: Column) -> Column:
        y, e = x["years"], x["ends"]
        contiguous = (F.size(y) > 0) & (F.array_max(y) - F.array_min(y) == F.size(y) - 1)
        bound = lambda f: F.when(F.size(e) > 0, f(e)).when(contiguous, f(y))
        return F.struct(y.alias("years"), bound(F.array_min).alias("first"), bound(F.array_max).alias("last"))

    return let(let(told, lambda ss: F.struct(years(ss).alias("years"), F.concat(ends(ss, 1), ends(ss, 2)).alias("ends"))), ranged)


def study_years(sentences: Column) -> Column:
    """(values, first_year, upper_year): years of study named, whether first years may apply (yes, no, unknown) and whether upper
    years are asked for."""
    named = lambda s: F.array_compact(F.array(*[F.when(says(s, p), F.lit(n)) for n, p in STUDY_YEARS.items()]))
    each = F.filter(F.transform(sentences, lambda s: F.struct(s.alias("s"), named(s).alias("v"))), lambda x: F.size(x["v"]) > 0)

    def made(xs: Column) -> Column:
        on_first = F.filter(xs, lambda x: F.array_contains(x["v"], "first-year"))
        first = F.when(F.exists(on_first, lambda x: says(x["s"], FIRST_YEAR_NO)), "no").when(F.exists(on_first, lambda x: says(x["s"], FIRST_YEAR_YES)), "yes").otherwise("unknown")
        upper = F.filter(xs, lambda x: F.array_contains(x["v"], "upper-year") | says(x["s"], "|".join(UPPER)))
        evidence = F.try_element_at(upper, F.lit(1))["s"]
        asked = F.when(F.size(upper) == 0, "unknown").when(says(evidence, UPPER_SOFT) & ~says(evidence, UPPER_HARD), "no").otherwise("yes")
        return F.struct(F.array_distinct(F.flatten(F.transform(xs, lambda x: x["v"]))).alias("values"), first.alias("first_year"), asked.alias("upper_year"))

    return let(each, made)


def state(sentences: Column, topic: str) -> Column:
    """required, preferred, not_required, conflict or unknown, of a topic of ``TOPICS``."""
    required, preferred, denied = TOPICS[topic]
    said = F.transform(sentences, lambda s: F.struct((says(s, required) & ~says(s, denied) & ~says(s, preferred)).alias("yes"), says(s, preferred).alias("wish"), says(s, denied).alias("no")))
    has = lambda xs, k: F.exists(xs, lambda x: x[k])
    return let(said, lambda xs: F.when(has(xs, "yes") & has(xs, "no"), "conflict").when(has(xs, "yes"), "required").when(has(xs, "no"), "not_required").when(has(xs, "wish"), "preferred").otherwise("unknown"))
