"""Ordered histories: newest rows, streaks, cooldowns and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, order: str, n: int, rank: str = "rn") -> DataFrame:
    """The ``n`` newest rows of each key with their rank from 1. Spark cuts groups to n rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col(rank) <= n)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    ranked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("rn"))
    return ranked.filter("rn = 1").select("row.*")


def streaks(df: DataFrame, key: str, order: str, stops: Column, counted: Column, name: str) -> DataFrame:
    """(key, name): the sum of ``counted`` over the newest rows of each key before the first that ``stops``."""
    stopped = F.max(stops.cast("int")).over(W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    marked = df.select(F.col(key).alias("k"), stopped.alias("stopped"), counted.alias("counted"))
    return marked.groupBy("k").agg(F.coalesce(F.sum(F.when(F.col("stopped") == 0, F.col("counted"))), F.lit(0)).alias(name)).withColumnRenamed("k", key)


def latest_where(condition: Column, order: str, value: str) -> Column:
    """The value in the newest row for which the condition holds."""
    return F.max_by(F.when(condition, F.col(value)), F.when(condition, F.col(order)))


def cooldown_ms(streak: Column, threshold: int = 3, base_ms: int = 900_000, most_ms: int = 86_400_000) -> Column:
    """0 below the threshold, else the base doubled for each failure beyond it, ``most_ms`` at most."""
    doubled = F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(streak - threshold, F.lit(40)))
    return F.when(streak < threshold, F.lit(0)).otherwise(F.least(doubled, F.lit(float(most_ms)))).cast("bigint")


def latest_and_rest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the newest value, and count, mean and median of the others."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))))
    rest = F.when(F.col("rn") > 1, F.col(value))
    return ranked.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"), F.count(rest).alias("samples"), F.avg(rest).alias("mean"), F.percentile(rest, 0.5).alias("median"))


def carried(c: Column, order: Column, *keys: str) -> Column:
    """The value, or the last one before it that is not null."""
    return F.last(c, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
