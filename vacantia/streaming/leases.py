"""Keys that live as long as they are heard of: a lease runs from each sighting, and a timer on event time ends it.

The same state serves listings, which close when no run has seen them for so long and open again when one does, and runs, which fail when
their heartbeat stops and stay failed. What is remembered of a key is two small named values; a stored table can be the state to begin with.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "id bigint, first_ms bigint, last_ms bigint, ended_ms bigint, times bigint"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state where timers can be kept; they copy the setting when they start."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Lease(StatefulProcessor):
    """``last_ms + lease_ms`` without a sighting ends a key's lease. ``final``: an ended key stays ended, later sightings are not counted.

    Sightings of a key in one micro-batch are taken by time, so a gap between two of them ends the lease as the timer would have. A late one that
    the watermark lets through may move the first sighting, and undoes no end.
    """

    def __init__(self, lease_ms: int, final: bool) -> None:
        self.lease_ms, self.final = lease_ms, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_ms bigint, last_ms bigint")
        self.ended = handle.getValueState("ended", "at_ms bigint, times bigint")

    def _load(self) -> tuple[int | None, int | None, int | None, int]:
        first, last = self.seen.get() if self.seen.exists() else (None, None)
        ended, times = self.ended.get() if self.ended.exists() else (None, 0)
        return first, last, ended, times

    def _keep(self, key: tuple, first: int, last: int, ended: int | None, times: int) -> pd.DataFrame:
        self.seen.update((first, last))
        self.ended.update((ended, times))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if ended is None:
            self.handle.registerTimer(last + self.lease_ms)
        return pd.DataFrame({"id": [key[0]], "first_ms": [first], "last_ms": [last], "ended_ms": pd.array([ended], "Int64"), "times": [times]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self._keep(key, int(row.first_ms), int(row.last_ms), None if pd.isna(row.ended_ms) else int(row.ended_ms), int(row.times))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, ended, times = self._load()
        for at in sorted(int(x) for part in rows for x in part["at_ms"]):
            first = at if first is None else min(first, at)
            if last is not None and ended is None and at - last > self.lease_ms:
                ended, times = last + self.lease_ms, times + 1
            if ended is not None and self.final:
                break
            if last is None or at > last:
                last, ended = at, None
        yield self._keep(key, first, last, ended, times)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, ended, times = self._load()
        if ended is None and last is not None and expiredTimerInfo.getExpiryTimeInMs() >= last + self.lease_ms:
            yield self._keep(key, first, last, last + self.lease_ms, times + 1)

    def close(self) -> None:
        pass


def leased(rows: DataFrame, lease_ms: int, final: bool, delay: str, stored: DataFrame | None = None) -> DataFrame:
    """A stream of (id, first_ms, last_ms, ended_ms, times) over a stream of sightings (``id``, ``at`` timestamp): a row for each key that a micro-batch
    or a timer changes. ``stored``, in that shape, is the state before the first batch. To be started inside ``timed_state``."""
    keyed = rows.withWatermark("at", delay).select("id", "at", F.unix_millis("at").alias("at_ms")).groupBy("id")
    return keyed.transformWithStateInPandas(Lease(lease_ms, final), STATE, "Update", "EventTime", initialState=None if stored is None else stored.groupBy("id"))


def latest(changes: DataFrame) -> DataFrame:
    """The last of the rows that a ``leased`` stream gave for each key (with the ``batch`` that gave it)."""
    order = F.struct("batch", "times", "last_ms", F.col("ended_ms").isNotNull())
    return changes.groupBy("id").agg(F.max_by(F.struct("first_ms", "last_ms", "ended_ms", "times"), order).alias("r")).select("id", "r.*")
