"""What a posting says of sponsorship and of the right to work, with the sentences that say it.

A text's sentences are cut into clauses at semicolons and contrasting words. A clause denies, or it offers; an offer counts only if nothing in its clause
negates it, if it is about work (not an event), and if the sentence is not a question, a condition, a rule for some other role or a statement about the past that the text itself takes
back. A text that denies and offers has a conflict, and then its state is unknown. Everything is a Column expression; a text
without the word is not cut at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .classify import let, says

# Words and patterns of statements on sponsorship.
NOT = r"(?:will not|won['’]?t|cannot|can not|can['’]?t|could not|unable to|not able to|does not|doesn['’]?t|do not|don['’]?t|is not|are not|isn['’]?t|aren['’]?t|never|no longer|not)"
KIND = r"(?:visa|employment|immigration|employer|work(?: permit)?|H-?1B)"
DENIALS = (
    rf"\b{NOT}\s+(?:be\s+|being\s+|currently\s+|able to\s+)*(?:provid|offer|support|pursu|consider|accept|guarantee work|fil|hir|intend)[a-z]*\b[^.!?;\n]{{0,80}}\bsponsor(?:ship)?\b",
    rf"\b{NOT}\s+(?:be\s+|currently\s+|able to\s+)*sponsor(?:ing)?\b",
    r"\bno\b(?:\s+[\w/-]+){0,3}\s+sponsorship\b(?!\s+(?:is\s+)?(?:required|needed|necessary))",
    r"\bsponsorship\b[^.!?;\n]{0,80}\b(?:not\s+(?:be\s+|currently\s+)*(?:available|offered|provided|supported|possible)|unavailable|cannot be (?:offered|provided|supported))\b",
    r"\bnot\s+(?:be\s+)?eligible\b[^.!?;\n]{0,60}\bsponsorship\b",
    r"\bsponsorship\b[^.!?;\n]{0,30}\b(?:are|is)\s+not\s+eligible\b",
    r"\b(?:must|authori[sz]ed|eligible|legally|able)\b[^.!?;\n]{0,120}\bwithout\b[^.!?;\n]{0,60}\bsponsorship\b",
    r"\bnot an? (?:position|role|job|opportunity)\b[^.!?;\n]{0,40}\bsponsorship\b",
    r"\b(?:must|should|may|can|do|will|shall)\s?not\b[^.!?;\n]{0,40}\brequire\b[^.!?;\n]{0,60}\bsponsorship\b",
    r"\bsponsorship\s*:\s*(?:no\b|none\b|not\b|unavailable)",
)
#: An offer whose words name what is sponsored, one that needs that from its surroundings, and a form's answer.
PLAIN_OFFERS = (rf"\b{KIND}\s+sponsorship\s*(?:(?:is|will be)\s+)?(?:available|provided|offered|supported)\b", rf"\b(?:provide|offer|support)(?:s|ed)?\s+{KIND}\s+sponsorship\b", rf"\b(?:providing|offering|supporting)\s+{KIND}\s+sponsorship\b", r"\bsponsor(?:s|ed|ing)?\s+(?:eligible\s+)?candidates?\b")
VAGUE_OFFERS = (r"\b(?:provide|offer|support)(?:s|ed)?\s+sponsorship\b", r"\b(?:providing|offering|supporting)\s+sponsorship\b", r"\bwill sponsor\b")
ANSWER = r"\bsponsorship\s*:\s*(?:yes|available|provided|offered)\b"
FOR_WORK = r"\b(?:visas?|immigration|employment|work(?: permit| authorization)?|H-?1B)\b|\b(?:for|to)\s+(?:(?:this|the|a|an|our|eligible|qualified)\s+)?(?:role|position|job|candidate|applicant|employee|worker|employment)s?\b"
EVENT = r"sponsorship\s+(?:of|for)\s+(?:[a-z]+\s+){0,4}(?:events?|programs?|hackathons?|conferences?|festivals?|arts?)\b"
QUESTION = r"\?\s*(?:\*|select\b|choose\b|please select\b|please choose\b)|^(?:will|would|do|does|are|is|have|has|can|could|may|might)\s+(?:you|the applicant|applicants?|candidates?)\b[^?]*\?"
CLEARANCE, OF_VISAS = r"\bclearance\s+sponsorship\b", r"\b(?:visa|immigration|employment|work permit|H-?1B)\s+sponsorship\b"
CONDITION = r"\b(?:may|might|could)\b[^.!?;\n]{0,50}\b(?:sponsor|provide|offer|support)\b|\bsponsorship\b[^.!?;\n]{0,40}\b(?:may|might|could)\b[^.!?;\n]{0,30}\b(?:available|provided|offered|supported)\b|\bdetermines?\s+whether\s+to\b[^.!?;\n]{0,60}\bsponsorship\b|\bsole discretion\b"
ELIGIBILITY = r"\bcan be filled by\b[^.!?;\n]{0,80}\bcandidates? requiring sponsorship\s*:\s*yes\b"
OTHER_ROLES, THIS_ROLE = r"\b(?:select|some|certain|qualifying|eligible)\s+(?:roles?|positions?|jobs?|openings?)\b", r"\b(?:this|the current)\s+(?:role|position|job|internship|opportunity|opening)\b|\bincluding\s+this\s+one\b"
HISTORY, DISCLAIMER = r"\b(?:track record|history)\b[^.!?;\n]{0,100}\b(?:offer|provid|sponsor)[a-z]*\b", rf"\b{NOT}\s+guarantee\b[^.!?;\n]{{0,100}}\bsponsorship\b[^.!?;\n]{{0,60}}\b(?:this|the)\s+(?:specific\s+)?role\b"
CONTRAST = r";|\b(?:but|however|although|yet)\b"
TAKEN_BACK = rf"\b{NOT}\b[^.!?;\n]{{0,50}}\b(?:(?:provide|offer|support|sponsor)\b[^.!?;\n]{{0,10}}\b(?:it|this|that|one)\b|(?:provided|offered|available)\b)"
REQUIRED = r"\b(?:must|need(?:s)?|required|required to be|eligible|legally)\b[^.\n]{0,100}\b(?:authori[sz](?:ed|ation)|work in|work authorization|right to work|employ(?:ment)? eligibility)\b|\b(?:authori[sz](?:ed|ation) to work|legally entitled to work|right to work)\b"
NOT_REQUIRED = r"\b(?:no|without|not required|does not require|doesn['’]?t require)\b[^.\n]{0,80}\b(?:work authorization|right to work|employment authorization|employment eligibility|legally authorized to work)\b"
SOFT, HARD = r"\b(?:preferred|nice to have|nice-to-have|desired|bonus|ideal|plus|asset)\b", r"\b(?:must|required|need(?:s)?|only|ineligible|not eligible|minimum|at least)\b"


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return says(c, "|".join(f"(?:{p})" for p in patterns))


def _sentences(body: Column) -> Column:
    """Sentences; the points of U.S. and U.K. end none."""
    return text.sentences(F.regexp_replace(body, r"\b(U|u)\.\s?([SsKk])\.", "$1$2"))


def _heard(s: Column) -> Column:
    """Whether a sentence is a statement on work at all."""
    return ~says(s, QUESTION) & ~(says(s, CLEARANCE) & ~says(s, OF_VISAS))


def _denies(s: Column) -> Column:
    clauses = F.split(s, f"(?i){CONTRAST}")
    offered = _any(s, (*PLAIN_OFFERS, *VAGUE_OFFERS))
    return F.exists(clauses, lambda c: _any(c, DENIALS)) | (offered & F.exists(F.slice(clauses, 2, 99), lambda c: says(c, TAKEN_BACK)))


def _offers(s: Column) -> Column:
    vague = lambda c: _any(c, VAGUE_OFFERS) & ~says(c, EVENT) & says(c, FOR_WORK)
    # what the offer's clause says before the offer must not negate it; "and" begins another statement here
    clauses = F.split(s, rf"(?i){CONTRAST}|\band\b")
    made = F.exists(clauses, lambda c: says(c, ANSWER) | ((_any(c, PLAIN_OFFERS) | vague(c)) & ~says(c, rf"\b(?:{NOT}|no|without)\b") & ~says(c, EVENT)))
    return made & ~says(s, CONDITION) & ~says(s, ELIGIBILITY) & ~(says(s, OTHER_ROLES) & ~says(s, THIS_ROLE))


def evidence(body: Column) -> Column:
    """(``available``, ``unavailable``): the sentences that offer and that deny sponsorship, in their order; none for a null text."""
    none = F.array().cast("array<string>")
    spoken = F.when(F.contains(F.lower(body), F.lit("sponsor")), F.filter(_sentences(body), lambda s: F.contains(F.lower(s), F.lit("sponsor")) & _heard(s))).otherwise(none)
    back = lambda x: F.exists(x, lambda s: says(s, DISCLAIMER))
    return let(F.coalesce(spoken, none), lambda x: F.struct(F.filter(x, lambda s: _offers(s) & ~(says(s, HISTORY) & back(x))).alias("available"), F.filter(x, _denies).alias("unavailable")))


def conflict(found: Column) -> Column:
    return (F.size(found["available"]) > 0) & (F.size(found["unavailable"]) > 0)


def state(body: Column) -> Column:
    """``available``, ``unavailable``, ``conflict`` or ``unknown``."""
    return let(evidence(body), lambda e: F.when(conflict(e), "conflict").when(F.size(e["unavailable"]) > 0, "unavailable").when(F.size(e["available"]) > 0, "available").otherwise("unknown"))


def work_authorization(body: Column) -> Column:
    """``required``, ``preferred``, ``not_required``, ``conflict`` or ``unknown``: what the sentences say of the right to work."""
    none = F.array().cast("array<string>")
    said = F.transform(_sentences(body), lambda s: F.when(says(s, NOT_REQUIRED) & ~says(s, r"\bsponsor"), "no").when(says(s, REQUIRED), F.when(says(s, SOFT) & ~says(s, HARD), "wish").otherwise("yes")).otherwise(""))
    has = F.array_contains
    return let(F.coalesce(said, none), lambda x: F.when(has(x, "yes") & has(x, "no"), "conflict").when(has(x, "yes"), "required").when(has(x, "no"), "not_required").when(has(x, "wish"), "preferred").otherwise("unknown"))
