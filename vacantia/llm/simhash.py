"""SimHash near-duplicates by multi-index hashing.

A fingerprint takes one bit of 64 where it is set in over half the XXH64 values of the text's word shingles. For
links at up to three differing bits the fingerprint is cut into two segments of 32 bits: of two linked fingerprints one
segment differs in at most one bit. Every distinct fingerprint is in one table per segment; it probes each with the
Hamming ball of radius one round its segment, and the join keeps what has a complete distance in bounds.

Families of near copies have many fingerprints that differ in a few bits. Their links at distance one, at most 64 a
fingerprint, are found first (both share a segment then); the join next emits links between different components of those
only, so that its rows stay proportional to the fingerprints, not to the square of a family. Segments that more than ``CROWD``
fingerprints share are not joined at all: their fingerprints, and those one bit away, are written under every fingerprint that
differs from them in one bit or in two. A common one of which some are one bit away links all that have it, through its
least component, without a pair being formed.

All sides of joins that grow with the fingerprints are shuffled; none is broadcast through the driver.

Cases: a null or empty text has no words and fingerprint zero, linked like any other. A row with a null ``doc_id`` is
fingerprinted and given the component of its fingerprint (null if only such rows have it), but links nothing. Repeated rows
are one node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_row, shuffled, stored
from .components import components

SEED, CHUNK = 42, 1 << 16
#: Beyond so many fingerprints in a segment common neighbours take the place of pairs.
CROWD = 20_000
#: The bits of each byte value, lowest first, and the offset of each byte's counts.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(w) - words + 1
    if n < 2:
        return digest(b" ".join(w), SEED)
    seen = np.zeros(2048, np.int64)  # how often each value of each of the eight bytes occurs
    for k in range(0, n, CHUNK):
        part = w[k : k + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        h = np.fromiter(map(digest, shingles, repeat(SEED)), np.uint64, min(CHUNK, n - k))
        seen += np.bincount((h.view(np.uint8).reshape(-1, 8) + PLACE).ravel(), minlength=2048)
    total = (seen.reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(``doc_id``, ``fp`` as signed bigint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, words) for x in b.column(1).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(fp: Column, table: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if table else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _neighbours(crowd: DataFrame) -> DataFrame:
    """Links of up to three bits between the components of ``crowd`` (``fp``, ``component``), by common neighbours."""
    bits = crowd.select("fp", "component", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("b"))
    one = bits.select(F.when(F.col("b") < 0, F.col("fp")).otherwise(F.expr("fp ^ shiftleft(1L, b)")).alias("code"), "component", F.lit(True).alias("near"))
    two = bits.filter("b > 0").select("fp", "component", "b", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("c"))
    codes = one.union(two.select(F.expr("fp ^ shiftleft(1L, b) ^ shiftleft(1L, c)"), "component", F.lit(False)))
    least = codes.groupBy("code").agg(F.min("component").alias("v"), F.max("component").alias("most"), F.bool_or("near").alias("near")).filter("near and v < most").select("code", "v")
    return codes.join(shuffled(least), "code").filter("component <> v").select(F.col("component").alias("u"), "v").distinct()


def links(nodes: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """(``u``, ``v``) between the distinct fingerprints of ``nodes`` (``fp``, ``node``), enough for exact components."""
    if distance > 3:
        raise ValueError("two segments with balls of radius one find links of up to three bits")
    tables = [nodes.select(F.lit(t).alias("t"), _segment(F.col("fp"), t).alias("seg"), "fp", "node") for t in (0, 1)]
    table = tables[0].unionByName(tables[1])
    shared = stored(table.groupBy("t", "seg").agg(F.count("*").alias("n")).filter("n > 1"))
    family = stored(table.join(shuffled(shared.select("t", "seg")), ["t", "seg"]).select("fp", "node").distinct())
    flips = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    near = family.select(F.col("node").alias("u"), "fp", F.explode(flips).alias("bit")).filter(F.col("fp").bitwiseAND(F.col("bit")) == 0)
    near = near.select("u", F.col("fp").bitwiseOR(F.col("bit")).alias("fp")).join(shuffled(family), "fp").select("u", F.col("node").alias("v"))
    near = stored(near)
    group = components(near)
    nodes = stored(nodes.join(shuffled(group), "node", "left").select("node", "fp", F.coalesce("component", "node").alias("component")))
    # each pair once: the segment with a clear bit probes the one with it set; equal segments by order of fp
    tables = [nodes.select(F.lit(t).alias("t"), _segment(F.col("fp"), t).alias("seg"), "fp", "component") for t in (0, 1)]
    table = tables[0].unionByName(tables[1])
    ball = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(32)])
    crowded = shared.filter(F.col("n") > crowd).select("t", "seg")  # at most two for each ``crowd`` fingerprints
    if crowded.limit(1).count():
        round_ = stored(crowded.select("t", F.explode(ball).alias("bit"), "seg").select("t", F.col("seg").bitwiseXOR(F.col("bit")).alias("seg")).distinct())
        near = near.union(_neighbours(table.join(shuffled(round_), ["t", "seg"]).select("fp", "component").distinct()))
        pairs = table.join(crowded, ["t", "seg"], "left_anti")
    else:
        pairs = table
    probe = table.select("t", "seg", F.col("fp").alias("p_fp"), F.col("component").alias("u"), F.explode(ball).alias("bit"))
    probe = probe.filter(F.col("seg").bitwiseAND(F.col("bit")) == 0)
    probe = probe.select("t", F.col("seg").bitwiseOR(F.col("bit")).alias("seg"), (F.col("bit") == 0).alias("same"), "p_fp", "u")
    found = (
        probe.alias("p")
        .join(shuffled(pairs).alias("q"), (F.col("p.t") == F.col("q.t")) & (F.col("p.seg") == F.col("q.seg")) & (F.col("u") != F.col("component"))
              & (_distance("p_fp", "fp") <= distance) & (~F.col("same") | (F.col("p_fp") < F.col("fp"))))
        .select("u", F.col("component").alias("v"))
    )
    return near.union(found)


def near_duplicates(documents: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` reachable, of every row."""
    prints = stored(fingerprints(documents, words))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    group = components(links(nodes.filter("node is not null"), distance))
    known = stored(nodes.join(shuffled(group), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(shuffled(known), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, distance: int = 3) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, that of its smallest ``doc_id``; rows without id stay."""
    first = near_duplicates(documents, distance).filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("t"), as_row(documents).alias("row"))
    named = rows.filter("id is not null").join(shuffled(first), "id", "left_semi")
    named = named.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("t"))).filter("k = 1")
    return named.select("row").union(rows.filter("id is null").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
