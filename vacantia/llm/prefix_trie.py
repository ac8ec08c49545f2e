"""A trie of conversation prefixes by preorder intervals.

A conversation's key is the list of its turns' digests. Distinct keys are put in lexicographic order, which is a preorder walk of
the trie: key r brings new nodes for the depths beyond its longest common prefix with key r - 1, and none of them stands apart. A node
is found again under all keys that pass it by the digest of its prefix; the first of these keys places it, the last one ends its
subtree. So a node is an interval of preorder places, and what a subtree holds is a difference of two prefix sums over
all nodes, which are added up range by range. Nothing walks the tree.

Copies of a conversation meet as one key, counted before the shuffle; the ids that end in one node are joined in pieces of up to
``PIECE`` ids by the tasks that sort them, and only these pieces meet for the digest.

Cases: null or empty roles and texts are empty. Turns are ordered by turn, nulls first, equal ones by their digest, so ties and
repeated rows have one order. Rows with a null ``conv_id`` belong to no conversation. A conversation without turns is a member of the root and
ends there; a table without conversations has no node. Digests are 128 bits of SHA-256 over role and text. A conversation's digests are one row (24
bytes a turn), which bounds it to some ten million turns. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .ranks import running

PIECE, GROUP, HEADS = 4096, 5, 9
STEP = "array<struct<digest:binary,bytes:bigint>>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(``conv_id``, ``n`` from 1, ``digest``, ``bytes`` of the text) of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    in_order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(in_order).alias("n"), "digest", "bytes")


def with_heads(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(``conv_id``, ``steps``): each conversation c with its first h turns replaced by those of conversation c - c % ``group``;
    h is the checksum of c modulo ``heads``."""
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    own = turns.filter(F.col("n") > F.crc32(F.col("conv_id").cast("string")) % heads)
    lent = turns.filter(F.col("n") < heads).withColumnRenamed("conv_id", "base").join(convs, "base").filter("n <= h").select("conv_id", "n", "digest", "bytes")
    steps = own.unionByName(lent).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "digest", "bytes"))).alias("t"))
    steps = steps.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"], x["bytes"])).cast(STEP).alias("steps"))
    return convs.select("conv_id").join(steps, "conv_id", "left").select("conv_id", F.coalesce("steps", F.array().cast(STEP)).alias("steps"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys -> one row for each of their nodes; a prefix's digest is that of the one before and the turn's."""
    names = ["r", "depth", "node", "parent", "size", "ends", "n_convs", "conv_id", "key"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    for b in batches:
        rows = []
        for r, steps, n, first, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            node, parent = b"", None
            for d, (turn, size) in enumerate([(None, 0), *((s["digest"], s["bytes"]) for s in steps)]):
                if d:
                    node, parent = hashlib.sha256(node + turn).digest()[:16], node
                rows.append((r, d, node, parent, size, d == len(steps), n, first, key if d == len(steps) else None))
                if len(rows) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) in order -> ids of a key, comma-joined, in pieces."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) >= PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> each key's digest of all its ids."""
    key, now = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([now.hexdigest()])], ["key", "ends_sha256"])
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if now is None or k != key:
                if now is not None:
                    yield row()
                key, now = k, hashlib.sha256(ids.encode())
            else:
                now.update(f",{ids}".encode())
    if now is not None:
        yield row()


def _common(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(same > 0, same - 1).otherwise(F.size(a)).cast("bigint")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the preorder interval
    ``place`` to ``subtree_end`` (exclusive), of every node over (``conv_id``, ``steps``) rows."""
    keyed = stored(conversations.select("conv_id", "steps", F.unhex(F.sha2(F.array_join(F.transform("steps", lambda x: F.hex(x["digest"])), ""), 256)).alias("key")))
    distinct = keyed.groupBy("key").agg(F.first("steps").alias("steps"), F.count("*").alias("n_convs"), F.min("conv_id").alias("first"))
    # keys in order, and how many first turns each has in common with the one before
    placed = stored(running(distinct, [F.transform("steps", lambda x: x["digest"])], {}, "r"))
    before = placed.select((F.col("r") + 1).alias("r"), F.transform("steps", lambda x: x["digest"]).alias("earlier"))
    fresh = placed.select("r", F.transform("steps", lambda x: x["digest"]).alias("digests")).join(before, "r", "left")
    fresh = fresh.select("r", F.when(F.col("earlier").isNull(), -1).otherwise(_common("digests", "earlier")).cast("bigint").alias("shared"), F.size("digests").cast("bigint").alias("length"))
    base = stored(running(fresh.withColumn("fresh", F.col("length") - F.col("shared")), [F.col("r")], {"base": "fresh"}, "n").select("r", "shared", "fresh", "base"))
    rows = placed.select("r", "steps", "n_convs", "first", "key").mapInArrow(_prefixes, "r bigint, depth bigint, node binary, parent binary, size bigint, ends boolean, n_convs bigint, conv_id bigint, key binary")
    nodes = rows.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("size").alias("size"), F.min("r").alias("low"), F.max("r").alias("high"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("key").alias("key")
    )
    starts = base.select(F.col("r").alias("low"), (F.col("base") - F.col("shared") - 1).alias("start"))
    ends = base.select(F.col("r").alias("high"), (F.col("base") + F.col("fresh")).alias("subtree_end"))
    nodes = nodes.join(starts, "low").withColumn("place", F.col("start") + F.col("depth")).join(ends, "high").drop("low", "high", "start")
    nodes = nodes.withColumn("leaf", (F.col("subtree_end") == F.col("place") + 1).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    # sums over all nodes before a place; behind the last place stand the totals
    sums = stored(running(nodes, [F.col("place")], {"leaves_before": "leaf", "saved_before": "saved"}, "n").drop("n"))
    upto = sums.select((F.col("place") + 1).alias("subtree_end"), (F.col("leaves_before") + F.col("leaf")).alias("leaves_to"), (F.col("saved_before") + F.col("saved")).alias("saved_to"))
    children = sums.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    pieces = keyed.select("key", "conv_id").orderBy("key", "conv_id").mapInArrow(_pieces, "key binary, first bigint, ids string")
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")
    out = sums.join(upto, "subtree_end").join(children, "node", "left").join(parents, "parent", "left").join(digests, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), (F.col("leaves_to") - F.col("leaves_before")).alias("n_leaves"),
        (F.col("saved_to") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "place", "subtree_end",
    )
