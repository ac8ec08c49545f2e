"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds, 0 if there are none."""
    return F.coalesce(F.count_if(condition), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """The quotient, null where the whole is 0 or null."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def median(c: Column) -> Column:
    """The middle value, or the mean of the two in the middle."""
    return F.percentile(c, 0.5)


def nearest_rank(c: Column, p: float) -> Column:
    """The smallest value with at least the share ``p`` of all at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {_name(c)})")


def _name(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def zero_filled_days(df: DataFrame, at: str, last: str, days: int) -> DataFrame:
    """(day, n): rows of each of ``days`` days that end with the day ``last``, also where there are none."""
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    counts = df.filter(F.col(at).isNotNull()).groupBy(F.col(at).cast("date").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, key: str, domain: list[str], total: str = "all") -> DataFrame:
    """(key, n) for each value of ``domain``, zero-filled, and the total of all rows under ``total``."""
    spark = df.sparkSession
    values = spark.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias(key))
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    filled = values.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return filled.union(df.agg(F.count("*").alias("n")).select(F.lit(total), "n"))


def per_tag(df: DataFrame, tags: Column, name: str = "tag") -> DataFrame:
    """Rows of each tag, a row counted under every tag it has."""
    return df.select(F.explode(tags).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def latency(c: Column) -> list[Column]:
    """Count, sum, least, largest and mean: the parts from which summaries can be merged."""
    return [F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean")]


def merge_latency(df: DataFrame, *keys: str) -> DataFrame:
    """Summaries of ``latency`` merged: the mean from the sums, not of means."""
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).withColumn("mean", ratio(F.col("total"), F.col("n")))


def running_mean(mean: Column, n: Column, value: Column) -> tuple[Column, Column]:
    """Mean and number after one more value."""
    return (F.coalesce(mean, F.lit(0.0)) * F.coalesce(n, F.lit(0)) + value) / (F.coalesce(n, F.lit(0)) + 1), F.coalesce(n, F.lit(0)) + 1


def compared(before: Column, after: Column) -> list[Column]:
    """Difference, and its per cent of what was before (null if that was 0)."""
    return [(after - before).alias("delta"), (ratio(after - before, before) * 100).alias("percent")]
