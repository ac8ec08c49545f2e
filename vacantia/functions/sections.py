"""Sections of a posting's text: headings carry forward to the lines below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import list_item, white_space

#: Patterns of headings, by the section that begins with them.
HEADINGS = {
    "preferred": r"(?:preferred|bonus|nice to have|additional skills)\b.{0,40}|what sets you apart|preferences",
    "required": r"(?:minimum|basic|required|professional)?\s*(?:qualifications?|requirements?|skills)\b.{0,30}|what (?:you.?ll need|you need|we.?re looking for)|eligibility|education|your background",
    "responsibilities": r"(?:key |your )?responsibilities\b.{0,20}|what you(?:.?ll| will) (?:do|work on)|duties",
    "other": r"benefits|compensation|about .{1,40}|why .{1,40}|what we offer|equal (?:opportunity|employment).{0,30}|additional information|location|company overview",
}


def heading(line: Column) -> Column:
    """The section that a line opens, null if it is no heading."""
    clean = F.regexp_replace(list_item(line), r"\s*:$", "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS.items()):
        out = F.when((F.length(clean) <= 60) & F.regexp_like(clean, F.lit(f"(?i)^(?:{pattern})$")), F.lit(name)).otherwise(out)
    return out


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, place, line): lines of 3 to 600 characters under a heading that is not ``other``, each once."""
    lines = df.select(key, F.posexplode(F.split(white_space(F.col(text)), r"\n+")).alias("place", "raw"))
    marked = lines.select(key, "place", list_item(F.col("raw")).alias("line"), heading(F.col("raw")).alias("opens"))
    section = F.last("opens", ignorenulls=True).over(W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    kept = marked.select(key, "place", "line", "opens", section.alias("section")).filter("opens is null and section <> 'other' and length(line) between 3 and 600")
    return kept.groupBy(key, "section", F.lower("line").alias("folded")).agg(F.min("place").alias("place"), F.min_by("line", "place").alias("line")).drop("folded")


def evidence(df: DataFrame, key: str, text: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, value, start): where each extracted value stands in the text, from 0; values that do not are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in fields.items()])).alias("e")
    found = df.select(key, F.col(text).alias("__text"), pairs).select(key, "e.field", "e.value", (F.position(F.lower("e.value"), F.lower("__text")) - 1).alias("start"))
    return found.filter("value is not null and value <> '' and start >= 0")
