"""Text functions as Column expressions; two that no built-in covers are Arrow UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The named references that are decoded; others stay as they are.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
#: Legal forms at the end of a company's name, and names that stand for one company.
LEGAL_FORMS = ["incorporated", "inc", "corporation", "corp", "company", "limited", "ltd", "llc", "lp", "plc"]
COMPANY_ALIASES = {
    "cmpa acpm": ["cmpaacpm", "carrierescmpaacpm", "careerscmpaacpm"], "jpmorgan chase": ["chase", "jpmorganchase", "jpmorganchaseandco"], "plus": ["plus", "plusai"],
    "tenstorrent": ["tenstorrent", "tenstorrentuniversity"], "western digital": ["wd", "westerndigital"],
}
#: Words that say nothing of a role's identity.
PLACEMENT_WORDS = r"\b(internship|intern|co-?op|student)\b"
#: Parts of query keys and prefixes of secrets that are redacted in free text.
SECRET_KEYS = r"(?i)((?:token|access_token|auth(?:orization)?|api[_-]?key|mcp_token|session(?:_id)?|secret|signature)=)[^&\s]+"
BEARER = r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+"


def replaced(c: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced one after another."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def white_space(c: Column) -> Column:
    """Blanks of a line as one, none round line ends, none at the ends."""
    return F.trim(replaced(c, (" ", " "), (r"[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"^\s+|\s+$", "")))


def one_line(c: Column) -> Column:
    return F.regexp_replace(white_space(c), r"\n+", " ")


def list_item(c: Column) -> Column:
    """Without bullets or a number in front, on one line."""
    return one_line(replaced(c, (r"^[\s•·▪◦*-]+", ""), (r"^\d+[.)]\s*", "")))


def ascii_fold(c: Column) -> Column:
    """A-Z lower-cased and nothing else, as a byte-wise case-blind order needs it."""
    return F.translate(c, UPPER, LOWER)


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters; what is cut ends in an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, max(0, most - 1))), F.lit("…")))


#: What ``list_item`` changes has one of these: a bullet, number or blank in front, a blank at the end, a blank that is none, or two.
_UNCLEAN = r"^[\s•·▪◦*\-\d]|[\t\n\u00a0]|  |\s$"


def unique_items(items: Column) -> Column:
    """Cleaned items, the first of those that differ only in case or in punctuation at the end, in order."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    clean = F.filter(F.transform(items, lambda x: F.when(F.regexp_like(x, F.lit(_UNCLEAN)), list_item(x)).otherwise(x)), lambda x: x != "")
    keys = lambda c: F.transform(c, lambda x: F.regexp_replace(F.lower(x), r"[.!;:]+$", ""))
    return once(clean, lambda c: once(keys(c), lambda ks: F.filter(c, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def lines(c: Column) -> Column:
    return unique_items(F.split(white_space(c), r"\n+"))


def sentences(c: Column) -> Column:
    """Lines, bullet items and sentences, without repetitions."""
    return unique_items(F.split(white_space(c), r"\n+|[•·▪◦]\s*|(?<=[.!?])\s+(?=[A-Z0-9])"))


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    named = re.compile(r"&(#(?:[xX][0-9a-fA-F]+|\d+)|[a-zA-Z]+);")

    def one(m: re.Match) -> str:
        token = m[1]
        if token[0] == "#":
            code = int(token[2:], 16) if token[1] in "xX" else int(token[1:])
            return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]
        return ENTITIES.get(token.lower(), m[0])

    return s.map(lambda x: named.sub(one, x) if isinstance(x, str) and "&" in x else x)


def decode_entities(c: Column) -> Column:
    """Numeric references and the six named ones; texts without ``&`` do not leave the JVM's column."""
    return F.when(F.contains(c, F.lit("&")), _decode(c)).otherwise(c)


@F.pandas_udf(StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch)) if isinstance(x, str) and not x.isascii() else x)


def without_diacritics(c: Column) -> Column:
    """Accents taken off letters; ASCII texts pass as they are."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_plain(c))


def identity(c: Column) -> Column:
    """What tells roles apart: lower-case letters and digits without placement words."""
    return identity_ascii(without_diacritics(one_line(c)))


def identity_ascii(c: Column) -> Column:
    """``identity`` of text that has no accents."""
    return F.trim(replaced(F.lower(c), (PLACEMENT_WORDS, ""), (r"[^a-z0-9]+", " ")))


def company_identity(c: Column) -> Column:
    """A company's name without legal form, mapped to the name that its aliases stand for."""
    return company_identity_ascii(without_diacritics(one_line(decode_entities(c))))


def company_identity_ascii(c: Column) -> Column:
    plain = F.trim(replaced(F.lower(c), ("&", "and"), (r"[^a-z0-9]+", " "), (rf"\b(?:{'|'.join(LEGAL_FORMS)})\b(?:\s+[a-z]{{1,4}})?\s*$", ""), (r"\s+", " ")))
    compact = F.replace(plain, F.lit(" "), F.lit(""))
    out = F.when(F.startswith(plain, F.lit("castleton commodities ")), F.lit("castleton commodities"))
    for name, aliases in COMPANY_ALIASES.items():
        out = out.when(compact.isin(aliases), F.lit(name))
    return out.otherwise(plain)


def role_identity(c: Column) -> Column:
    return F.trim(replaced(identity(decode_entities(c)), (r"\bengineering\b", "engineer"), (r"\bdevelopment\b", "developer"), (r"\s+", " ")))


def masked_email(c: Column) -> Column:
    """First letter of the name and the domain; null if it is no address."""
    return F.when(F.regexp_like(c, F.lit(r"^[^@\s]+@[^@\s]+$")), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1)))


def redacted(c: Column) -> Column:
    """Values of secret keys and bearer tokens blotted out."""
    return replaced(c, (SECRET_KEYS, "$1[REDACTED]"), (BEARER, "$1[REDACTED]"))


def listing_id(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the parts, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON; arrays and structs keep their order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def pattern_of(terms: list[str]) -> str:
    """One pattern for many keywords, made when the plan is built: any white space between words, whole words only."""
    each = [r"\s+".join(re.escape(w) for w in t.lower().split()) for t in terms]
    return r"(?i)" + "|".join((r"\b" if e[0].isalnum() else "") + e + (r"\b" if e[-1].isalnum() else "") for e in each)


def fragment_text(page: str | None) -> str:
    """The text of an HTML fragment: blocks as lines, scripts and styles left out."""
    page = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", page or "")
    page = re.sub(r"(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav))\b[^>]*>", "\n", page)
    page = html.unescape(re.sub(r"<[^>]*>", "", page)).replace(" ", " ")
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", page)).strip()


def content_hash(fields: list[Column]) -> Column:
    """The digest of named fields as JSON in their order; nulls stay in it."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
