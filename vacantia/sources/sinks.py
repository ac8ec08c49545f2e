"""Sinks: rows as JSON and CSV files, and a report in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, kind: str) -> str:
    """Writes ``df`` as ``json`` or ``csv`` (arrays joined, so that a cell is text) and returns the path."""
    if kind == "csv":
        flat = [F.array_join(F.col(f"`{n}`").cast("array<string>"), "; ").alias(n) if t.startswith("array") else F.col(f"`{n}`") for n, t in df.dtypes]
        df.select(*flat).write.option("header", True).csv(path)
    elif kind == "json":
        df.write.json(path)
    else:
        raise ValueError(f"no sink of kind {kind}")
    return path


def bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit("- Not stated"))


def report_entry(number: Column, company: Column, title: Column, fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """A listing's entry of the report, rendered by the executors."""
    head = F.concat(F.lit("## "), number.cast("string"), F.lit(". "), company, F.lit(" — "), title)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(v.cast("string"), F.lit("Unknown"))) for n, v in fields.items()]
    blocks = [F.concat(F.lit(f"\n{n}:\n"), bullets(v)) for n, v in lists.items()]
    return F.concat_ws("\n", head, F.lit(""), *lines, *blocks)
