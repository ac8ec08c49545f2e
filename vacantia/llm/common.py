"""Helpers that the operators share."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import folder as shared_dir
from ..operators.stage import stored

__all__ = ["LOWER", "SPACE", "UPPER", "as_row", "ascii_lower", "others", "release", "shared_dir", "shuffled", "stored"]

#: The white space of all word and line rules: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Lets the driver's context cleaner drop the shuffle files of finished jobs now.

    What a job leaves is found by one collection and freed by the next.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shuffled(df: DataFrame) -> DataFrame:
    """For a join to a side that grows with the input: it is shuffled, whatever size Spark takes it for.

    A broadcast passes through the driver, and packed files of the threshold's size are many times that in its memory.
    """
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; texts without other characters take the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def others(df: DataFrame, made: list[str], row: str) -> list[Column]:
    """The input's columns out of the struct ``row``, without those that the operator makes itself."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in df.columns if c not in made]


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
