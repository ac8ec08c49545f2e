"""States in buckets: what batches touch, crashes, repeated and foreign batches, the log of changes."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators.stage import folder
from vacantia.streaming.versions import Versions

SCHEMA = "k bigint, v string"


def rule(batch, old):
    """The batch's value replaces the old one; a null value takes the row out."""
    return old.join(batch, "k", "left_anti").unionByName(batch).filter("v is not null")


def rows(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def state(spark):
    return Versions(spark, folder(spark), "k", SCHEMA, "one", buckets=16)


def test_merges_equal_a_plain_state_and_the_log_replays_it(spark, state):
    r, plain, kept = random.Random(1), {}, []
    for number in range(5):
        batch = {r.randrange(40): r.choice(["a", "b", None]) for _ in range(8)}
        touched = state.merge(spark.createDataFrame(list(batch.items()), SCHEMA), number, rule)
        assert len(touched) <= len(batch)
        plain = {k: v for k, v in (plain | batch).items() if v is not None}
        kept.append(dict(plain))
        assert rows(state.state(number)) == plain
    for number, want in enumerate(kept):
        assert rows(state.state(number)) == want == rows(state.replayed(number))
    assert {x.change for x in state.changes(-1, 4).collect()} == {"insert", "update", "delete"}
    last = {x.k: (x.change, x.row and x.row.v) for x in state.changes(3, 4).collect()}
    assert last == {k: ("insert" if k not in kept[3] else "delete" if k not in kept[4] else "update", kept[4].get(k)) for k in kept[3].keys() | kept[4].keys() if kept[3].get(k) != kept[4].get(k)}


def test_only_touched_buckets_are_written(spark, state):
    state.merge(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), 0, rule)
    touched = state.merge(spark.createDataFrame([(5, "y")], SCHEMA), 1, rule)
    written = spark.read.parquet(f"{state.folder}/data/1")
    assert len(touched) == 1 and {r.bucket for r in written.select("bucket").distinct().collect()} == touched and written.count() < 150
    assert rows(state.state(1)) == {k: "y" if k == 5 else "x" for k in range(1000)} and state.changes(0, 1).count() == 1


def test_a_crash_before_the_manifest_loses_nothing(spark, state):
    state.merge(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), 0, rule)
    batch = spark.createDataFrame([(1, "c"), (3, "d")], SCHEMA)

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        state.merge(batch, 1, rule, fail)
    assert rows(state.state(0)) == {1: "a", 2: "b"}
    state.merge(batch, 1, rule)
    state.merge(batch, 1, rule)  # a batch that is repeated
    assert rows(state.state(1)) == {1: "c", 2: "b", 3: "d"} == rows(state.replayed(1))


def test_another_stream_and_missing_batches_are_refused(spark, state):
    batch = spark.createDataFrame([(1, "a")], SCHEMA)
    state.merge(batch, 0, rule)
    other = Versions(spark, state.folder, "k", SCHEMA, "two", buckets=16)
    for number in (0, 1):
        with pytest.raises(ValueError):
            other.merge(batch, number, rule)
    with pytest.raises(Exception):  # noqa: B017
        state.merge(batch, 5, rule)


def test_an_emptied_state(spark, state):
    state.merge(spark.createDataFrame([(1, "a")], SCHEMA), 0, rule)
    state.merge(spark.createDataFrame([(1, None)], SCHEMA), 1, rule)
    assert rows(state.state(1)) == {} == rows(state.replayed(1))
    state.merge(spark.createDataFrame([], SCHEMA), 2, rule)
    assert rows(state.state(2)) == {}
