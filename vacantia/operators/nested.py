"""JSON of any shape by VARIANT: all nodes of values, texts, paths that rows bring along, and evidence that moves with its item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import stored

#: A path of names and numbers in brackets: ``a[2].b``.
STEP = r"[^.\[\]]+|\[\d+\]"


def kind(v: Column) -> Column:
    """object, array, string, other, or null for a JSON null."""
    s = F.schema_of_variant(v)
    return F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "string").when(s != "VOID", "other")


def nodes(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, ``path``, ``place``, ``kind``, ``value``) of every value inside the JSON texts, the outermost included; a malformed text has none.

    ``place`` orders the nodes of a text: an array's items by number, an object's fields by name, what contains before what it contains. One level is
    opened at a time, for all rows together, and stored; there are as many rounds as the deepest value has levels.
    """
    at = df.select(*keys, F.try_parse_json(json).alias("value")).filter("value is not null")
    level = stored(at.select(*keys, F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), kind(F.col("value")).alias("kind"), "value"))
    levels = [level]
    session = df.sparkSession
    while True:
        inner = level.filter("kind in ('object', 'array')")
        opened = inner.withColumnRenamed("value", "held").lateralJoin(session.tvf.variant_explode(F.col("held").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        level = stored(opened.select(*keys, F.concat("path", step).alias("path"), F.concat("place", F.array("pos")).alias("place"), kind(F.col("value")).alias("kind"), "value"))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def texts(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, ``text``): all strings inside a JSON text, a line each, in order; texts without strings are left out."""
    found = nodes(df, keys, json).filter("kind = 'string'").select(*keys, F.struct("place", F.variant_get("value", "$", "string").alias("text")).alias("t"))
    return found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t")).getField("text"), "\n").alias("text"))


def variant_path(path: Column) -> Column:
    """``a[2].b`` as the path that VARIANT functions take; names may hold blanks and signs other than points, brackets and quotes."""
    steps = F.regexp_extract_all(path, F.lit(STEP), F.lit(0))
    return F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.when(F.startswith(s, F.lit("[")), s).otherwise(F.concat(F.lit("['"), F.replace(s, F.lit("'"), F.lit("")), F.lit("']")))), ""))


def resolved(value: Column, path: Column) -> Column:
    """The text at a path that each row brings along: strings, numbers and truth values; null for containers, and where there is nothing."""
    at = F.try_variant_get(value, variant_path(path), "variant")
    return F.when(kind(at).isin("string", "other"), F.try_variant_get(at, F.lit("$"), "string"))


def comparable(c: Column) -> Column:
    """What is compared of evidence: lower-case letters and digits of one line."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def realigned(value: Column, path: Column, said: Column) -> Column:
    """The path at which ``said`` still stands, null if it stands nowhere.

    A path into a list moves to the first item that has the text; another stays if its value is the text, a range of ``min`` and ``max`` reading "min-max", and a
    description need only contain it.
    """
    wanted = comparable(said)
    last = r"^(.*)\[(\d+)\]([^\[\]]*)$"
    head, rest = F.regexp_extract(path, last, 1), F.regexp_replace(F.regexp_extract(path, last, 3), r"^\.", "")
    items = F.try_variant_get(value, variant_path(head), "array<variant>")
    own = lambda x: comparable(F.when(rest == "", F.when(kind(x).isin("string", "other"), F.try_variant_get(x, F.lit("$"), "string"))).otherwise(resolved(x, rest)))
    number = F.array_position(F.transform(items, own), wanted) - 1
    moved = F.when(number >= 0, F.concat(head, F.lit("["), number.cast("string"), F.lit("]"), F.regexp_extract(path, last, 3)))
    there = F.try_variant_get(value, variant_path(path), "variant")
    ends = [F.try_variant_get(there, F.lit(f"$.{e}"), "string") for e in ("min", "max")]
    plain = comparable(F.coalesce(resolved(value, path), F.concat_ws("-", F.when(ends[1].isNotNull(), ends[0]), F.when(ends[0].isNotNull(), ends[1]))))
    stays = (plain == wanted) | ((path == "description") & F.contains(plain, wanted))
    return F.when(wanted == "", None).when(F.regexp_like(path, F.lit(last)), moved).when(F.coalesce(stays, F.lit(False)), path)
