"""Incremental runs: sightings arrive as files, each micro-batch is merged into the listings' state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.windows import first_of


def changed(found: Column, same: Column, is_open: Column, retry: Column) -> Column:
    """new, retryable, unchanged (validators agree and it is open) or possibly_changed."""
    return F.when(~found, "new").when(retry, "retryable").when(same & is_open, "unchanged").otherwise("possibly_changed")


def validators_match(a: str, b: str, *names: str) -> Column:
    """Whether any validator is present on both sides and equal."""
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(f"{a}.{n}") == F.col(f"{b}.{n}"), F.lit(False))
    return out


def distinct_sightings(df: DataFrame) -> DataFrame:
    """The first sighting of each run, source and identity."""
    return first_of(df, ["run_id", "source_id", "identity"], F.col("seq"))


def sighting_changes(rows: DataFrame, known: DataFrame, delay: str) -> DataFrame:
    """(run_id, source_id, identity, at, change) over a stream of sightings (``run_id``, ``source_id``, ``identity``, ``at``, ``hash``): the first that arrives of
    each run, source and identity, against the stored listings ``known`` (``identity``, ``hash``, ``is_open``, ``retry``).

    What has been seen is forgotten once the watermark has passed it by ``delay``; later repetitions are then too late and dropped as well.
    """
    first = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "source_id", "identity"])
    n, o = first.alias("n"), known.alias("o")
    change = changed(F.col("o.identity").isNotNull(), validators_match("n", "o", "hash"), F.coalesce("o.is_open", F.lit(False)), F.coalesce("o.retry", F.lit(False)))
    return n.join(o, F.col("n.identity") == F.col("o.identity"), "left").select("n.run_id", "n.source_id", "n.identity", "n.at", change.alias("change"))


def tumbling(df: DataFrame, at: str, key: str, size: str = "15 minutes") -> DataFrame:
    """Rows of each key and window; works on batches and, with a watermark, on streams."""
    return df.groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start_ms"), key, "n")


def rate_limited(df: DataFrame, at: str, key: str, limit: int, size: str = "15 minutes") -> DataFrame:
    """Windows in which a key went over its limit, and by how much."""
    return tumbling(df, at, key, size).filter(F.col("n") > limit).withColumn("over", F.col("n") - limit)


def lifecycle_state(rows: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """Per listing id over a stream of (id, run_id, seen): first and last run seen and misses in a row.

    A row per id and micro-batch. State is one small tuple per id.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, misses = state.get if state.exists else (None, None, 0)
        events = pd.concat(list(parts)).sort_values("run_id")
        for r in events.itertuples(index=False):
            if r.seen:
                first, last, misses = first if first is not None else int(r.run_id), int(r.run_id), 0
            else:
                misses += 1
        state.update((first, last, misses))
        yield pd.DataFrame({"id": [key[0]], "first_run": [first], "last_run": [last], "misses": [misses]})

    return rows.groupBy("id").applyInPandasWithState(run, "id bigint, first_run bigint, last_run bigint, misses bigint", "first_run bigint, last_run bigint, misses bigint", "update", GroupStateTimeout.NoTimeout)


def merged_batches(spark: SparkSession, folder: str, schema: str, target: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str, files: int = 1) -> StreamingQuery:
    """Runs a merge for each micro-batch of files; versions are folders numbered by batch, so a repeated batch rewrites its own.

    Only the first batch of a checkpoint has no state before it. Where a later one cannot read the version before, for whatever
    reason, the batch fails and the query stops; started again it repeats that batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{target}/{number - 1}") if number else None
        merge(batch, old).write.mode("overwrite").parquet(f"{target}/{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lapsed(status: Column, heartbeat: Column, now: Column, minutes: int = 20) -> Column:
    """Runs that say they run but whose heartbeat is too old fail."""
    return F.when((status == "RUNNING") & (heartbeat < now - F.expr(f"INTERVAL {minutes} MINUTES")), "FAILED").otherwise(status)
