"""Streams: leases that timers end, restarts, stored states to begin with, late and repeated sightings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.operators.stage import folder
from vacantia.streaming import leases
from vacantia.streaming import sightings as stream

DAY = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
HOUR = 3_600_000
SEEN = "id bigint, at timestamp"


def ms(hours):
    return int(DAY.timestamp() * 1000) + int(hours * HOUR)


def land(spark, path, number, rows, schema=SEEN):
    rows = [tuple(DAY + dt.timedelta(hours=x) if isinstance(x, float) else x for x in r) for r in rows]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={number}")


def run(spark, path, out, log, final, stored=None, start=0):
    rows = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    with leases.timed_state(spark):
        leases.leased(rows, 10 * HOUR, final, "1 hour", stored).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return {r.id: (r.first_ms, r.last_ms, r.ended_ms, r.times) for r in leases.latest(spark.read.parquet(out)).collect()}


BATCHES = [[(1, 0.0), (2, 0.0), (3, 0.0), (1, 8.0)], [(1, 16.0), (3, 30.0)], [(3, 45.0), (9, 60.0)]]
# 1: ends after 26; 2: ends after 10; 3: ends at 10, again at 40, and by the timer at 55
LISTINGS = {1: (ms(0), ms(16), ms(26), 1), 2: (ms(0), ms(0), ms(10), 1), 3: (ms(0), ms(45), ms(55), 3), 9: (ms(60), ms(60), None, 0)}
RUNS = {1: LISTINGS[1], 2: LISTINGS[2], 3: (ms(0), ms(0), ms(10), 1), 9: LISTINGS[9]}


@pytest.mark.parametrize("final,want", [(False, LISTINGS), (True, RUNS)])
def test_timers_end_leases(spark, final, want):
    path, out, log = folder(spark), folder(spark), folder(spark)
    for k, rows in enumerate(BATCHES):
        land(spark, path, k, rows)
    assert run(spark, path, out, log, final) == want


def test_a_restart_in_the_middle_changes_nothing(spark):
    path, out, log = folder(spark), folder(spark), folder(spark)
    for k, rows in enumerate(BATCHES):
        land(spark, path, k, rows)
        got = run(spark, path, out, log, False)
    assert got == LISTINGS


def test_a_stored_state_to_begin_with(spark):
    path, out, log = folder(spark), folder(spark), folder(spark)
    for k, rows in enumerate(BATCHES):
        land(spark, path, k, rows)
    stored = spark.createDataFrame([(1, ms(-30), ms(-5), None, 2), (7, ms(-9), ms(-1), None, 0), (8, ms(-99), ms(-50), ms(-40), 4)], leases.STATE)
    got = run(spark, path, out, log, False, stored)
    assert got[1] == (ms(-30), ms(16), ms(26), 3) and got[7] == (ms(-9), ms(-1), ms(9), 1) and 8 not in got and got[3] == LISTINGS[3]


def test_late_and_repeated_sightings(spark):
    schema = "run_id bigint, source_id bigint, identity string, at timestamp, hash string"
    path, out, log = folder(spark), folder(spark), folder(spark)
    land(spark, path, 0, [(1, 1, "a", 0.0, "h"), (1, 1, "a", 0.5, "h"), (1, 2, "a", 0.0, "h"), (1, 1, "b", 1.0, "x")], schema)
    land(spark, path, 1, [(1, 1, "a", 2.0, "h"), (2, 1, "a", 2.0, "h"), (1, 1, "c", 9.0, "h")], schema)
    land(spark, path, 2, [(1, 3, "e", 9.0, None)], schema)
    land(spark, path, 3, [(1, 1, "c", 9.0, "h"), (1, 1, "d", 0.0, "h")], schema)  # d comes after the watermark has passed it
    known = spark.createDataFrame([("a", "h", True, False), ("b", "old", True, False), ("c", "h", False, False), ("e", None, True, True)], "identity string, hash string, is_open boolean, retry boolean")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    stream.sighting_changes(rows, known, "3 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.run_id, r.source_id, r.identity, r.change) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, "a", "unchanged"), (1, 1, "b", "possibly_changed"), (1, 1, "c", "possibly_changed"), (1, 2, "a", "unchanged"), (1, 3, "e", "retryable"), (2, 1, "a", "unchanged")]


def test_a_batch_of_the_same_keys(spark):
    df = spark.createDataFrame([(1, 1, "a", 2), (1, 1, "a", 1)], "run_id int, source_id int, identity string, seq int")
    assert [r.seq for r in stream.distinct_sightings(df).select(F.col("seq")).collect()] == [1]
