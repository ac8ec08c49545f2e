"""Joins, set operations, merges and orders that the plans are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import stored
from .windows import first_of

LIFECYCLE_RANK = {"REMOVED": 4, "NEW": 3, "UPDATED": 2}


def any_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(key, value) for each of several columns: an OR of equalities becomes one equi-join."""
    return df.select(value, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def all_in(links: DataFrame, key: str, member: str, known: DataFrame) -> DataFrame:
    """Keys whose members are all in ``known`` (one column ``member``, distinct)."""
    marked = links.select(F.col(key).alias("k"), F.col(member).alias("m")).join(known.select(F.col(member).alias("m"), F.lit(True).alias("in")), "m", "left")
    return marked.groupBy("k").agg(F.bool_and(F.col("in").isNotNull()).alias("all")).filter("all").select(F.col("k").alias(key))


def exactly_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with one distinct value."""
    ends = df.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("least"), F.max(value).alias("most")).filter("least = most")
    return ends.select(F.col("k").alias(key), F.col("least").alias(value))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of one page with the total, whether more follow, and the next offset (null at the end)."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def keyset(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows after a key."""
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def interleaved(df: DataFrame, batch: str, order: str) -> DataFrame:
    """Adds ``turn`` and orders one of each batch in turn."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(batch).orderBy(order))).orderBy("turn", batch)


def upsert(old: DataFrame, new: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Full merge of two tables by key. policy by column: new, old (first wins), coalesce (new unless null), max or min."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    rule = {
        "new": lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")), "old": lambda c: F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")),
        "coalesce": lambda c: F.coalesce(f"n.{c}", f"o.{c}"), "max": lambda c: F.greatest(f"n.{c}", f"o.{c}"), "min": lambda c: F.least(f"n.{c}", f"o.{c}"),
    }
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[rule[p](c).alias(c) for c, p in policy.items()])


def lifecycle(found: Column, same: Column, closed: Column) -> Column:
    """NEW without a match, UPDATED if its content changed or it was closed, else UNCHANGED."""
    return F.when(~found, "NEW").when(closed | ~same, "UPDATED").otherwise("UNCHANGED")


def strongest(status: Column) -> Column:
    """Aggregate: the strongest of statuses: removed, new, updated, else what there is."""
    rank = F.lit(0)
    for name, n in LIFECYCLE_RANK.items():
        rank = F.when(status == name, n).otherwise(rank)
    return F.max_by(status, F.struct(rank, status))


def aged(misses: Column, considered: Column, covered: Column, threshold: int = 2) -> tuple[Column, Column]:
    """Misses and whether it closes, of a listing not seen in a run: only where all its sources were covered."""
    count = F.when(considered & covered, misses + 1).otherwise(misses)
    return count, considered & covered & (count >= threshold)


def repointed(links: DataFrame, key: str, merged: DataFrame, member: str) -> DataFrame:
    """Links of merged keys (``key`` -> ``canonical``) moved to the canonical one: first and last sight joined."""
    moved = links.join(merged, key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")
    return moved.groupBy(key, member).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_of(df, [key], F.desc(order))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in an order of all rows, from 1, without a task that sees them all.

    The sort deals rows into ranges; each range numbers its own rows, and the sizes of the ranges before it (one small row a range) are added.
    """
    own = [f"`{c}`" for c in df.columns if c != name]
    rows = stored(df.orderBy(*order).select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("i")))
    rows = rows.select("row", F.shiftrightunsigned("i", 33).alias("range"), F.col("i").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    return rows.join(sizes, "range").select(*[F.col(f"row.{c}") for c in own], (F.col("before") + F.col("i") + 1).cast("int").alias(name))


def changes(old: DataFrame, new: DataFrame, key: str, values: list[str], revision: str) -> DataFrame:
    """(key, change, revision): rows that were inserted, updated or deleted between two states, with the revision that follows ``old``'s."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    gone, came = F.col(f"n.{key}").isNull(), F.col(f"o.{key}").isNull()
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    change = F.when(came, "insert").when(gone, "delete").when(differs, "update")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), (F.coalesce(f"o.{revision}", F.lit(0)) + 1).cast("bigint").alias("revision")).filter("change is not null")
