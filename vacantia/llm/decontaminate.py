"""Benchmark decontamination with one FM-index per shard of the training documents.

A shard is a run of documents as the scan delivers them, cut into pieces of bounded length that overlap by one
word less than a window. Each piece's words are numbered and indexed: suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet matrix with rank counts, and every ``SAMPLE``-th suffix position. All windows of the
block are searched backward at once; occurrences are located by walking to sampled positions, and
their spans are merged in a difference array over the shard. Documents are never shuffled.

The benchmark travels to the executors in blocks of at most ``BLOCK_BYTES`` (or one item), read one after another. Each block is a
pass of its own over the documents: what the pass before found is written to the shared folder first, so the driver and a
task hold one block at a time, however large the benchmark is. Most benchmarks are one block, and one map-only pass.

The index numbers the words that the block's items have; a run of other words, which no occurrence can hold, is one number.

Cases: null and empty texts have no words. Rows with repeated or null ``doc_id`` are judged each for itself.
Repeated items are items of their own; items without words occur nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .terms import words_of

RESULTS = ("n_words", "n_hit", "spans", "items")
WINDOW, SAMPLE = 10, 8
#: Words of a piece, bytes of text of a shard, bytes of benchmark text that go along with a task.
PIECE_WORDS, SHARD_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20, 16 << 20


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The item's windows of ``size`` words; a shorter item that has words is one."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of ``t`` (small non-negative ints) in the order of the suffixes that begin there."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    width = max(1, int(t.max() + 1).bit_length())
    depth = max(1, 62 // width)
    key, padded = np.zeros(n, np.int64), np.concatenate((t.astype(np.int64) + 1, np.zeros(depth, np.int64)))
    for k in range(depth):
        key = key << width | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    size = np.diff(np.append(heads, n))
    at = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are still tied
    while len(at):
        who = order[at]
        later = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)] + 1, 0)
        pair = rank[who] << 32 | later
        by = np.argsort(pair, kind="stable")
        order[at], pair = who[by], pair[by]
        heads = np.flatnonzero(np.concatenate(([True], np.diff(pair) != 0)))
        size = np.diff(np.append(heads, len(at)))
        rank[order[at]] = np.repeat(at[heads], size)
        at = at[np.repeat(size > 1, size)]
        depth *= 2
    return order


class Wavelet:
    """Wavelet matrix over ints: ``rank(c, i)``, occurrences of c before place i, and ``access(i)`` with its rank."""

    def __init__(self, seq: np.ndarray):
        self.levels = max(1, int(seq.max()).bit_length()) if len(seq) else 1
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros(-(-(len(seq) + 1) // 64) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][i >> 6] + np.bitwise_count(self.bits[k][i >> 6] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, i = np.zeros_like(i), i.copy()
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i, and how often each occurs before its place."""
        c, start, i = np.zeros_like(i), np.zeros_like(i), i.copy()
        for k in range(self.levels):
            one = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
            c = c << 1 | one
        return c, i - start


class FMIndex:
    """Over ``t``, whose values are from 1 up; 0 ends the text."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        t = np.concatenate((t, [0])).astype(np.int64)
        order = suffix_array(t)
        self.n, self.sample = len(t), sample
        self.before = np.concatenate(([0], np.cumsum(np.bincount(t))))
        self.bwt = Wavelet(t[order - 1])
        marked = order % sample == 0
        self.marked, self.sampled = marked, order[marked]
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last row of each pattern (a row of ``patterns``, right-aligned, of that length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(1, patterns.shape[1] + 1):
            at = np.flatnonzero((length >= k) & (lo < hi))
            if not len(at):
                break
            c = patterns[at, -k]
            hi[at[c >= len(self.before) - 1]] = 0  # no such value in the text
            at, c = at[c < len(self.before) - 1], c[c < len(self.before) - 1]
            lo[at] = self.before[c] + self.bwt.rank(c, lo[at])
            hi[at] = self.before[c] + self.bwt.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the next sampled one."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows]
            out[todo[done]] = self.sampled[self.mark_rank[rows[done]]] + steps
            rows, todo = rows[~done], todo[~done]
            if len(todo):
                c, r = self.bwt.access(rows)
                rows = self.before[c] + r
            steps += 1
        return out


def _hits(stream: np.ndarray, patterns: np.ndarray, length: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pattern, position) of all occurrences in the stream, piece by piece."""
    most = int(length.max())
    step = max(1, piece - most + 1)
    for start in range(0, max(1, len(stream) - most + 1), step):
        index = FMIndex(stream[start : start + step + most - 1])
        lo, hi = index.search(patterns, length)
        n = np.maximum(hi - lo, 0)
        if n.sum():
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield np.repeat(np.arange(len(n)), n), index.locate(rows) + start


def _judge(shard: list[list[bytes]], earlier: list[list[int]], items: list[int], wins: list[tuple[int, tuple[bytes, ...]]], piece: int) -> list[tuple[list[int], list[int]]]:
    """Of each document of a shard: its removal spans (starts and ends in turn, merged with ``earlier``), the items found.

    The index has a number for each word of the block's windows. No occurrence holds another word, so a run of others,
    and what stands between documents, is one number 1; ``place`` leads back to the shard's words.
    """
    number = {w: k for k, w in enumerate(sorted({w for _, ws in wins for w in ws}), 2)}
    starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in shard])))
    words = np.ones(int(starts[-1]), np.int64)
    for d, s in zip(shard, starts[:-1], strict=True):
        words[s : s + len(d)] = np.fromiter(map(number.get, d, repeat(1)), np.int64, len(d))
    place = np.flatnonzero((words != 1) | np.concatenate(([True], words[:-1] != 1)))
    stream = words[place]
    cover, found = np.zeros(len(words) + 1, np.int64), [[] for _ in shard]
    for spans, s in zip(earlier, starts[:-1], strict=True):
        at = np.asarray(spans, np.int64) + s
        np.add.at(cover, at[::2], 1)
        np.add.at(cover, at[1::2], -1)
    if wins and len(stream):
        length = np.array([len(w) for _, w in wins])
        patterns = np.zeros((len(wins), length.max()), np.int64)
        for i, (_, w) in enumerate(wins):
            patterns[i, -len(w) :] = [number[x] for x in w]
        owner, pairs = np.array([i for i, _ in wins]), []
        for p, at in _hits(stream, patterns, length, piece):
            at = place[at]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length[p], -1)
            pairs.append(np.unique(np.stack((np.searchsorted(starts, at, side="right") - 1, owner[p]), 1), axis=0))
        for d, i in np.unique(np.concatenate(pairs), axis=0) if pairs else ():
            found[d].append(items[i])
    inside = np.cumsum(cover) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    of = np.searchsorted(starts, edges[::2], side="right") - 1  # spans end before the 0 between documents
    spans = [[] for _ in shard]
    for d, x, y in zip(of, edges[::2], edges[1::2], strict=True):
        spans[d] += [int(x - starts[d]), int(y - starts[d])]
    return list(zip(spans, found, strict=True))


def _scan(items: list[tuple[int, str | None]], shard_bytes: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [i for i, _ in items]
        wins = [(k, w) for k, (_, text) in enumerate(items) for w in set(windows_of(words_of(text)))]
        longs = pa.list_(pa.int64())
        for b in batches:
            start = 0
            while start < b.num_rows:
                shard, size, k = [], 0, start
                while k < b.num_rows and size < shard_bytes:
                    shard.append(words_of(x := b.column(1)[k].as_py()))
                    size, k = size + len(x or ""), k + 1
                part = b.slice(start, k - start)
                out = _judge(shard, part.column(3).to_pylist(), names, wins, piece)
                found = [old + new for old, (_, new) in zip(part.column(4).to_pylist(), out, strict=True)]
                n_words = pa.array([len(d) for d in shard], pa.int64())
                columns = [part.column(0), part.column(1), n_words, pa.array([s for s, _ in out], longs), pa.array(found, longs)]
                yield pa.RecordBatch.from_arrays(columns, ["r", "x", "n_words", "spans", "items"])
                start = k

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of at most ``most`` bytes of text (or one item), read one after another."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text", F.coalesce(F.octet_length("text"), F.lit(0))).toLocalIterator():
        if block and size + r[2] > most:
            yield block
            block, size = [], 0
        size += r[2]
        block.append((r[0], r[1]))
    yield block


def contaminated_words(documents: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, piece: int = PIECE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit`` (words inside occurrences of windows), ``spans`` and ``items`` to ``documents``.

    ``spans`` are the merged removal spans, as word numbers: starts and ends in turn. ``items`` are the ids of the items
    of which a window occurs. Input columns of these names are replaced.
    """
    own = [c for c in documents.columns if c not in ("text", *RESULTS)]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    out = documents.select(rest.alias("r"), F.col("text").cast("string").alias("x"), F.lit(0).cast("bigint").alias("n_words"), *[F.array().cast("array<bigint>").alias(c) for c in ("spans", "items")])
    for k, items in enumerate(_blocks(benchmark, block_bytes)):
        out = (stored(out) if k else out).mapInArrow(_scan(items, shard_bytes, piece), out.schema)
    spans = F.col("spans")
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    back = [F.col("x").alias("text") if c == "text" else F.col(f"r.c{own.index(c)}").alias(c) for c in documents.columns if c not in RESULTS]
    return out.select(*back, "n_words", n_hit.alias("n_hit"), "spans", F.array_distinct("items").alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark."""
    return contaminated_words(documents, benchmark).filter("n_hit = 0").select(*[f"`{c}`" for c in documents.columns if c not in RESULTS])
