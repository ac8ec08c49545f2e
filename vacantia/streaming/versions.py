"""A state that micro-batches change: its rows in buckets by key, of which a batch rewrites those that it touches, and a log of what changed.

``folder/data/<batch>/bucket=<b>`` has the rows of a bucket as the batch left them, ``folder/manifest/<batch>`` names for every bucket the batch whose files are its
present ones, ``folder/log/revision=<batch>`` has the rows that were inserted, updated or deleted. The manifest is written last: a batch that fails before it has changed nothing that can be
read, and when it is repeated it writes the same folders again. A bucket's files that no later manifest names can be deleted by age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Versions:
    """``key`` identifies a row, ``schema`` is the rows' (with the key). ``writer`` tells streams apart: one state has one."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, writer: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.schema, self.writer, self.buckets = spark, folder, key, schema, writer, buckets

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def manifest(self, number: int) -> dict[int, int]:
        """For each bucket that has been written the batch of its present files."""
        if number < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch int, writer string").parquet(f"{self.folder}/manifest/{number}").collect()
        if any(r.writer != self.writer for r in rows):
            raise ValueError(f"batch {number} was written by another stream")
        return {r.bucket: r.batch for r in rows if r.bucket >= 0}

    def _files(self, named: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{n}/bucket={b}" for b, n in sorted(named.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def state(self, number: int) -> DataFrame:
        """All rows after a batch."""
        return self._files(self.manifest(number))

    def merge(self, batch: DataFrame, number: int, rule: Callable[[DataFrame, DataFrame], DataFrame], fail: Callable[[], None] = lambda: None) -> set[int]:
        """Replaces the buckets that ``batch`` (with the key) touches by ``rule(batch, old rows of these buckets)``; gives them. To be called for each micro-batch
        in turn. ``fail`` runs between files and manifest, for tests."""
        if self._has(number):
            self.manifest(number)  # a repeated batch is its own; another stream's is refused
        before = self.manifest(number - 1)
        batch = self._bucket(batch).persist()
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}  # at most as many as there are buckets
        old = self._files(before, touched)
        columns = old.columns
        new = rule(batch.drop("bucket"), old).select(columns)
        # a row of each bucket at least, so that one which has become empty is read as such
        self._bucket(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{number}")
        kept = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/data/{number}")
        filled = {r.bucket for r in kept.select("bucket").distinct().collect()}
        self._log(old, kept.select(columns)).write.mode("overwrite").parquet(f"{self.folder}/log/revision={number}")
        fail()
        now = {b: n for b, n in before.items() if b not in touched} | {b: number for b in filled}
        rows = [(b, n, self.writer) for b, n in now.items()] + [(-1, number, self.writer)]
        self.spark.createDataFrame(rows, "bucket int, batch int, writer string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")
        batch.unpersist()
        return touched

    def _has(self, number: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{number}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _log(self, old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = old.select(F.col(self.key).alias("k"), F.struct(*old.columns).alias("was")), new.select(F.col(self.key).alias("k"), F.struct(*new.columns).alias("now"))
        both = o.join(n, "k", "full_outer")
        change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
        return both.select(F.col("k").alias(self.key), change.alias("change"), F.col("now").alias("row")).filter("change is not null")

    def changes(self, after: int, upto: int) -> DataFrame:
        """(key, change, row, revision) of the batches after one up to another."""
        return self.spark.read.parquet(f"{self.folder}/log").filter(F.col("revision").between(after + 1, upto))

    def replayed(self, upto: int) -> DataFrame:
        """The state after a batch, from the log alone: of each key its last change."""
        last = self.changes(-1, upto).groupBy(self.key).agg(F.max_by(F.struct("change", "row"), "revision").alias("r"))
        return last.filter("r.change <> 'delete'").select("r.row.*")
