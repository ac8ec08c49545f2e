"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

Batches of documents arrive from the largest ``doc_id`` down. A batch's line hashes, counted, are merged with the runs stored so
far: what no run has was never seen, so this batch holds the key's largest ``doc_id``, and the key enters the batch's run
with that keeper; for a key that a run has only the count is added. Runs are tables bucketed and sorted by the hash, with as
many buckets as a shuffle has partitions, so a batch is joined to them without moving any run. When a level has ``fanout``
runs they are compacted into one run of the next level. A key has its keeper in exactly one run; its documents are
the sum over all.

Batches are as many as the input's size asks for (one for each ``BATCH_BYTES`` of text, between ``MIN_BATCHES`` and
``MAX_BATCHES``). A line that very many documents share costs a batch one row after its partial counts.

Cases: a null or empty text is one empty line. A row whose ``doc_id`` is null is compared with nothing and keeps
all its lines. Rows that repeat a ``doc_id`` count as one document; each keeps or loses its lines as that document
does. Ties cannot occur, as the keeper is the largest ``doc_id``. Input columns named as a result are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_row, ascii_lower, others, shared_dir, stored

RESULTS = ["kept_text", "n_lines", "n_dropped"]
#: Bytes of text for each batch, least and greatest number of batches.
BATCH_BYTES, MIN_BATCHES, MAX_BATCHES = 16 << 30, 4, 64


@dataclass(frozen=True)
class Run:
    """A run in two readings: bucketed (to join a batch to) and as plain files (to merge runs)."""

    name: str
    table: DataFrame
    files: DataFrame


class LineRuns:
    """The levelled store: ``levels[k]`` lists the runs of level k, tables (``h``, ``keeper``, ``n``, ``known``).

    ``known`` rows hold counts of keys whose keeper is in an older run.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def all(self) -> DataFrame:
        """Every stored key once, with its keeper and the number of its documents."""
        return self._merged(self.runs()).select("h", "keeper", "n") if self.names else self.spark.createDataFrame([], "h binary, keeper bigint, n bigint")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the keys of ``batch`` (``h`` once each, ``keeper``, ``n``); returns those that no run had."""
        known = F.lit(False)
        for k, run in enumerate(self.runs()):
            batch = batch.join(run.table.filter("not known").select("h", F.lit(True).alias(f"in{k}")), "h", "left")
            known = known | F.coalesce(f"in{k}", F.lit(False))
        run = self._written(batch.select("h", "keeper", "n", known.alias("known")))
        self._place(run, 0)
        return run.files.filter("not known").select("h", "keeper")

    def drop(self) -> None:
        """Takes the runs' names out of the catalog; their files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _written(self, df: DataFrame) -> Run:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_dir(self.spark)
        df.write.partitionBy("known").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.names.append(name)
        return Run(name, self.spark.table(name), self.spark.read.schema("h binary, keeper bigint, n bigint, known boolean").parquet(path))

    def _merged(self, runs: list[Run]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [r.files for r in runs])
        return rows.groupBy("h").agg(F.max(F.when(~F.col("known"), F.col("keeper"))).alias("keeper"), F.sum("n").alias("n"), F.bool_and("known").alias("known"))

    def _place(self, run: Run, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._written(self._merged(self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without the positions ``gone`` (sorted): the slices between them, in one pass."""
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(lines))).alias("b"))
    return F.flatten(F.transform(edges, lambda e: F.slice(lines, e["a"] + 2, e["b"] - e["a"] - 1)))


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """Drops repeated lines: adds ``kept_text``, ``n_lines`` (before) and ``n_dropped`` to ``documents``.

    A line's key is the line stripped at both ends and A-Z lower-cased. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` documents hold lose all their lines but those in the largest ``doc_id`` holding them.
    ``batches`` follow from the size of the input if they are not given.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = min(MAX_BATCHES, max(MIN_BATCHES, -(-size // BATCH_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, F.lit(k)).otherwise(batch)
    path = shared_dir(spark)
    entries = (
        docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        .select("doc_id", F.xxhash64("text").alias("t"), batch.alias("batch"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select(F.unhex(F.md5("key")).alias("h"), "doc_id", "t", "pos", "batch")
    )
    entries.write.partitionBy("batch").parquet(path)
    entries = spark.read.schema(entries.schema).parquet(path)

    store = LineRuns(spark, fanout)
    for k in range(len(cuts) + 1):
        store.add(entries.filter(F.col("batch") == k).groupBy("h").agg(F.max("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n")))
    repeated = stored(store.all().filter(F.col("n") >= min_docs).select("h", "keeper"))
    store.drop()
    gone = (
        entries.join(repeated, "h")
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "t")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text")).alias("t"), as_row(documents).alias("row"))
    lines = lines_of(F.col("row.text"))
    n_gone = F.coalesce(F.size("gone"), F.lit(0))
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(without(lines, F.col("gone")), "\n"))
    made = rows.join(gone, ["doc_id", "t"], "left").select("row", kept.alias("kept_text"), F.size(lines).cast("bigint").alias("n_lines"), n_gone.cast("bigint").alias("n_dropped"))
    return made.select(*others(documents, RESULTS, "row"), *RESULTS)
