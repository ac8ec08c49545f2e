"""Results that are kept between the jobs of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share; a temporary folder only where that is unset and Spark
    runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vacantia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet into such a folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, key: str, value: str) -> DataFrame:
    """(key, block): components of keys that share a value, over (``key``, ``value``) rows; the block is its smallest key.

    Values are read once: a key is linked to the smallest key of each of its values, and from then on only such pairs of keys are shuffled, each once however
    many values give it. Labels spread over the pairs, and each round also jumps to the label of the label, so rounds grow with the logarithm
    of the longest chain. Minima are counted per value before they are joined; joins have plain exchanges, which AQE can split.
    """
    links = links.select(F.col(key).alias("id"), F.col(value).alias("value"))
    low = links.groupBy("value").agg(F.min("id").alias("low"))
    pairs = stored(links.join(low, "value", "left").select("id", F.coalesce("low", "id").alias("low")).distinct())
    hop = pairs.filter("id <> low")
    both = hop.union(hop.select(F.col("low").alias("id"), F.col("id").alias("low")))
    label = stored(pairs.groupBy("id").agg(F.min("low").alias("block")))
    while True:
        new = both.join(label.select(F.col("id").alias("low"), "block"), "low").groupBy("id").agg(F.min("block").alias("near"))
        spread = label.join(new, "id", "left").select("id", F.least("block", "near").alias("block"), F.col("block").alias("old"))
        jump = spread.select(F.col("id").alias("block"), F.col("block").alias("further"))
        nxt = stored(spread.join(jump, "block", "left").select("id", F.coalesce("further", "block").alias("block"), "old"))
        label = nxt.select("id", "block")
        if not nxt.filter("block <> old").limit(1).count():
            return label.withColumnRenamed("id", key)


def blocks(df: DataFrame, key: str, *shared: str) -> DataFrame:
    """``components`` of rows that share a value in any of the columns; rows that share nothing are blocks of their own."""
    values = F.array(F.concat(F.lit("="), F.col(key).cast("string")), *[F.concat(F.lit(f"{c}="), F.col(c)) for c in shared])
    return components(df.select(key, F.explode(F.array_compact(values)).alias("value")), key, "value")
