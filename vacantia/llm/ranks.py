"""Places and sums over an order of all rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored


def running(df: DataFrame, order: list[Column], sums: dict[str, str], place: str) -> DataFrame:
    """``df`` with the number of rows before each one in ``order`` (``place``, from 0), and under each name of ``sums`` the sum of
    that bigint column over these rows.

    The sort deals rows into ranges; each task adds up its own range as it streams by, and what the ranges before it hold (one small
    row a range) is added afterwards. ``order`` should tell rows apart, so that a range can end between any two of them.
    """
    made = [place, *sums]
    schema = StructType([*df.schema.fields, StructField("range", LongType()), *[StructField(c, LongType()) for c in made]])
    names = [f.name for f in schema.fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), np.zeros(len(made), np.int64)
        for b in batches:
            n = b.num_rows
            steps = np.stack([np.ones(n, np.int64), *[b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in sums.values()]])
            after = np.cumsum(steps, axis=1) + total[:, None]
            before = [pa.array(x) for x in after - steps]
            total = after[:, -1] if n else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int64)), *before], names)

    rows = stored(df.orderBy(*order).mapInArrow(add, schema))
    step = [F.lit(1).cast("bigint"), *[F.col(c) for c in sums.values()]]
    ranges = rows.groupBy("range").agg(*[F.sum(s).alias(f"_{c}") for c, s in zip(made, step, strict=True)])
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in made])
    return rows.join(ranges, "range").select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in made])
