"""Hard negatives by a two-dimensional block matrix multiply (SUMMA-style).

Rows are ordered by label and cut into blocks of ``ROWS``, the anchors among them into blocks of ``ANCHORS``; both are cut again
into chunks of ``DIMS`` dimensions. One step of the product takes a chunk of an anchor block and the same chunk of a row block and
makes a partial tile of int64 scores. The tiles of a pair of blocks meet in a shuffle and are added; the sum is reduced to the few
best of each anchor before anything leaves the task, and the few of all tiles are ranked once more.

There are two products, which share no pair that is wholly of one kind: anchors with the row blocks that hold their label, of which each tile gives the
nearest positives, then anchors with all other row blocks, of which each tile gives the best negatives within every window that a
positive's score opens. As rows are ordered by label, the blocks of a label are an interval, found by one small row a label. A label
that a third of all rows have is many blocks of the same size, and no task ever holds more than one tile of ``ANCHORS * ROWS`` scores besides one
Arrow batch of partial tiles, whose bytes Spark bounds.

Scores: a component x becomes floor(256 * x); scores are sums of products in 64-bit integers, which wrap beyond them.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part. A vector shorter than
another counts as zero beyond its end; an empty one scores zero with everything. Rows that repeat an id are one row, the least by (label, components). Equal
scores go by the smaller id. An anchor without another row of its label has no positive and no result; a positive whose window
holds no negative has none (the window of a negative score is empty). Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .ranks import running

ROWS, ANCHORS, DIMS = 2048, 32, 32
LEAST, MOST = 30, 90
PARTIAL = "i bigint, j bigint, k int, scores binary, ids array<bigint>, labels array<bigint>, row_ids array<bigint>, row_labels array<bigint>, windows array<array<struct<positive_id:bigint,positive_score:bigint>>>"
NONE = np.iinfo(np.int64).min


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The items of a list column, row by row, without Python objects."""
    values, ends = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _matrix(places: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Rows at their places in a block; what a row lacks is zero."""
    height, width = int(places.max()) + 1, int(sizes.max(initial=0))
    out = np.zeros((height, max(width, 1)), np.int64)
    row = np.repeat(places, sizes)
    out[row, np.arange(len(cells)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = cells
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64; in doubles where these hold every partial sum exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * width < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of one chunk -> partial tiles."""
    names = ["i", "j", "k", "scores", "ids", "labels", "row_ids", "row_labels", "windows"]
    for b in batches:
        column = dict(zip(b.schema.names, b.columns, strict=True))
        left = [_lists(column[c]) for c in ("a_places", "a_sizes", "a_cells")]
        right = [_lists(column[c]) for c in ("b_places", "b_sizes", "b_cells")]
        for r in range(b.num_rows):
            tile = _product(_matrix(*(x[r] for x in left)), _matrix(*(x[r] for x in right)))
            whole = [column[c].slice(r, 1) for c in ("ids", "labels", "row_ids", "row_labels", "windows")]
            head = [column[c].slice(r, 1) for c in ("i", "j", "k")]
            # a tile's shape: a chunk that the last rows of a block do not reach is shorter
            data = np.array(tile.shape, np.int64).tobytes() + tile.tobytes()
            yield pa.RecordBatch.from_arrays([*head, pa.array([data], pa.binary()), *whole], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict]]:
    """Partial tiles sorted by block pair and chunk -> (scores, the pair's ids, labels and windows), one tile in memory."""
    now, total, about = None, None, {}
    for b in batches:
        column = dict(zip(b.schema.names, b.columns, strict=True))
        for r in range(b.num_rows):
            key = (column["i"][r].as_py(), column["j"][r].as_py())
            if key != now:
                if now is not None:
                    yield total, about
                one = {c: column[c].slice(r, 1) for c in ("ids", "labels", "row_ids", "row_labels", "windows")}
                about = {c: np.asarray(one[c].flatten()) for c in ("ids", "labels", "row_ids", "row_labels")} | {"windows": one["windows"][0].as_py()}
                now, total = key, np.zeros((len(about["ids"]), len(about["row_ids"])), np.int64)
            data = np.frombuffer(column["scores"][r].as_buffer(), np.int64)
            part = data[2:].reshape(data[:2])
            total[: part.shape[0], : part.shape[1]] += part
    if now is not None:
        yield total, about


def _best(scores: np.ndarray, about: dict, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a tile by falling score and rising id, for each anchor, and their scores; unusable ones last."""
    by_id = np.argsort(about["row_ids"], kind="stable")
    keys = np.where(usable, scores, NONE)[:, by_id]
    order = np.argsort(~keys, axis=1, kind="stable")  # ~x falls as x rises, without overflow
    return by_id[order], np.take_along_axis(keys, order, 1)


def _nearest(most: int):
    """Tiles -> the ``most`` best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scores, about in _summed(batches):
            usable = (about["labels"][:, None] == about["row_labels"]) & (about["ids"][:, None] != about["row_ids"])
            order, found = _best(scores, about, usable)
            n = np.minimum(usable.sum(1), most)
            at = np.arange(order.shape[1]) < n[:, None]
            columns = [np.repeat(about["ids"], n), about["row_ids"][order[at]], found[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score"])

    return run


def _within(least: int, largest: int, most: int):
    """Tiles -> for each anchor and positive the ``most`` best rows of other labels whose score is in the positive's window."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scores, about in _summed(batches):
            usable = about["labels"][:, None] != about["row_labels"]
            order, found = _best(scores, about, usable)
            count, out = usable.sum(1), []
            for r, windows in enumerate(about["windows"]):
                falling = found[r, : count[r]]
                rising = falling[::-1]
                for w in windows or ():
                    p = w["positive_score"]
                    low, high = -(-least * p // 100), largest * p // 100
                    first = len(falling) - np.searchsorted(rising, high, "right")
                    last = min(first + most, len(falling) - np.searchsorted(rising, low, "left"))
                    out += [(about["ids"][r], w["positive_id"], p, about["row_ids"][order[r, x]], falling[x]) for x in range(first, last)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _blocks(rows: DataFrame, by: str, dims: int) -> DataFrame:
    """(``by``, ``k``, places, sizes, cells; ids and labels with the first chunk): a block's rows cut into chunks of dimensions."""
    parts = rows.select(by, "place", "id", "label", "cells", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("cells") / dims).cast("int") - 1))).alias("k"))
    parts = parts.select(by, "k", F.struct("place", "id", "label", F.slice("cells", F.col("k") * dims + 1, F.lit(dims)).alias("cells")).alias("row"))
    sorted_ = parts.groupBy(by, "k").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # as many as a block has
    first = lambda c: F.when(F.col("k") == 0, F.col(f"rows.{c}"))
    return sorted_.select(by, "k", F.col("rows.place").alias("places"), F.transform("rows.cells", F.size).alias("sizes"), F.flatten("rows.cells").alias("cells"), first("id").alias("ids"), first("label").alias("labels"))


def _tiles(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Partial tiles of the block pairs (``i``, ``j``), the parts of a tile together and in order."""
    left = anchors.select("i", "k", F.col("places").alias("a_places"), F.col("sizes").alias("a_sizes"), F.col("cells").alias("a_cells"), "ids", "labels")
    left = left.withColumn("windows", F.lit(None).cast("array<array<struct<positive_id:bigint,positive_score:bigint>>>")) if windows is None else left.join(windows, ["i", "k"], "left")
    right = rows.select("j", "k", F.col("places").alias("b_places"), F.col("sizes").alias("b_sizes"), F.col("cells").alias("b_cells"), F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"))
    met = pairs.join(left, "i").join(right, ["j", "k"])
    return met.mapInArrow(_multiply, PARTIAL).repartition("i", "j").sortWithinPartitions("i", "j", "k")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least: int = LEAST, largest: int = MOST, block: int = ROWS, anchors_block: int = ANCHORS, dims: int = DIMS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` over ``rows`` (``id``, ``label``, ``vector``).

    ``anchor`` says which rows are anchors. A negative is a row of another label whose score is between ``least`` and ``largest`` per cent of
    the positive's.
    """
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<double>").alias("vector"), anchor.alias("anchor"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    rows = rows.select("id", "label", F.transform("vector", lambda x: F.floor(x * 256).cast("bigint")).alias("cells"), "anchor")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "cells", "anchor")).alias("r")).select("id", "r.*")
    placed = running(rows.withColumn("one", F.coalesce(F.col("anchor"), F.lit(False)).cast("bigint")), [F.col("label"), F.col("id")], {"before": "one"}, "n")
    placed = stored(placed.withColumn("j", F.floor(F.col("n") / block)))
    anchors = placed.filter("one = 1").withColumn("i", F.floor(F.col("before") / anchors_block))
    of_rows = stored(_blocks(placed.withColumn("place", (F.col("n") % block).cast("int")), "j", dims))
    of_anchors = stored(_blocks(anchors.withColumn("place", (F.col("before") % anchors_block).cast("int")), "i", dims))
    spread = placed.groupBy("label").agg(F.min("j").alias("first"), F.max("j").alias("last"))
    near = anchors.select("i", "label").distinct().join(spread, "label").groupBy("i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("labels"))
    near = stored(near)
    own = near.select("i", F.explode(F.sequence("first", "last")).alias("j"))
    found = _tiles(own, of_anchors, of_rows).mapInArrow(_nearest(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    by_score = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = stored(found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= positives).drop("rank"))
    opened = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))
    opened = anchors.select("i", F.col("id").alias("anchor_id"), "before").join(opened, "anchor_id", "left")
    opened = opened.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("before", "windows"))).alias("w")).select("i", F.lit(0).alias("k"), F.col("w.windows").alias("windows"))
    size = placed.agg(F.max("j").alias("most"))
    # of an anchor block of one label, the blocks inside its label's interval have no other
    inner = (F.col("labels") == 1) & (F.col("j") > F.col("first")) & (F.col("j") < F.col("last"))
    rest = near.crossJoin(F.broadcast(size)).select("i", "first", "last", "labels", F.explode(F.sequence(F.lit(0).cast("bigint"), "most")).alias("j")).filter(~inner).select("i", "j")
    held = _tiles(rest, of_anchors, of_rows, opened).mapInArrow(_within(least, largest, negatives), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    falling = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return held.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
