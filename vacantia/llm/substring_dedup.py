"""Substring deduplication: repeated phrases located by automata.

A window is 13 consecutive words. Of a window all documents but that with the smallest ``doc_id`` lose the covered words.

1. Anchors. The anchor of a window is the smallest hash of the 5-word sequences in it, so equal windows have equal
   anchors, and a document has about one anchor for five words. Those that occur in two documents recur.
2. Confirm. Each block of documents (dealt by a hash of the id) gets its recurring anchors back; 128-bit digests of the
   windows that have one, once for each block, with their smallest document and the place of one occurrence, show which
   windows recur.
3. Automata. Each block is told the places of its confirmed phrases and reads their words there. They are compiled, in shards of
   at most ``SHARD_PHRASES``, into Aho-Corasick automata over word codes, and all documents of the block are streamed through
   every shard: matches alone give the removed words. No digest is computed in this phase.

Anchors are counted per block before they meet those of other blocks, so a passage that every document has costs a row
per block; blocks grow in number with the input, not in size. Exact copies (equal SHA-256) are found first: they are compared
with nothing else, as all their windows start in the first copy.

A trie node's children are searched one by one, so a word is two (or more) characters of small alphabets of their own, one for each
place in the code: nodes stay narrow, and a match cannot begin inside a code.

Cases: a null or empty text has no words. A row with a null ``doc_id`` is compared with nothing and loses nothing.
Rows that repeat a ``doc_id`` are one document: none of them counts as smaller than the others. Very long texts are
worked on whole, as a block of their own if they are longer than one. Input columns named as a result are replaced. The input
is read once in each phase and has to be the same each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RESULTS = ("kept_text", "n_words", "n_removed", "spans")
WINDOW, GRAM = 13, 5
#: Bytes of text of a block, least number of blocks, phrases of an automaton, bytes that are hashed at once (or one word).
BLOCK_BYTES, MIN_BLOCKS, SHARD_PHRASES, CHUNK = 4 << 20, 24, 60_000, 1 << 19
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: A random number for each byte, and the base of the polynomial of a word's bytes (odd, so that it has an inverse).
_BYTE, _BASE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64), 0x5851F42D4C957F2D


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _ODD[2]
    return h ^ (h >> np.uint64(30))


def _chain(h: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of each ``size`` consecutive values (hashes themselves)."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        out *= odd
        out += h[k : k + n]
    return _finish(out)


def _chain_at(h: np.ndarray, at: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """``_chain`` at some places only."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out *= odd
        out += h[at + k]
    return _finish(out)


class Hasher:
    """Hashes of all words of texts, from their bytes alone."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            down = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(b)), dtype=np.uint64))) for b in (_BASE, down))

    def _piece(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word; ``heads`` are places where a text begins."""
        n = len(data)
        self._powers(n)
        space = _SPACE[data]
        fresh = np.concatenate(([True], space[:-1]))
        fresh[heads[heads < n]] = True
        last = np.concatenate((fresh[1:] | space[1:], [True]))
        start, end = np.flatnonzero(fresh & ~space), np.flatnonzero(last & ~space) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:n], out=total[1:])
        return _finish((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of ``texts`` in a row, and where each text's begin (and the end)."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offset = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        hashes, counts, k = [], np.zeros(n + 1, np.int64), 0
        while k < n:
            j = max(k + 1, int(np.searchsorted(offset, offset[k] + CHUNK, side="right")) - 1)
            lo, hi = int(offset[k]), int(offset[j])
            if j == k + 1:  # one text, perhaps long: cut at white space
                while lo < hi:
                    cut = min(hi, lo + CHUNK)
                    while cut < hi and not _SPACE[data[cut - 1]]:
                        blank = np.flatnonzero(_SPACE[data[cut : cut + CHUNK]])
                        cut = min(hi, cut + (int(blank[0]) + 1 if len(blank) else CHUNK))
                    h, _ = self._piece(data[lo:cut], np.zeros(0, np.int64))
                    hashes.append(h)
                    counts[k + 1] += len(h)
                    lo = cut
            else:
                h, start = self._piece(data[lo:hi], offset[k:j] - lo)
                hashes.append(h)
                counts[k + 1 : j + 1] = np.diff(np.searchsorted(start, offset[k : j + 1] - lo))
            k = j
        return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.cumsum(counts)


def _first(start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of texts whose words begin at ``start``, and the text of each."""
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    n = max(0, len(text) - window + 1)
    first = np.flatnonzero(text[:n] == text[len(text) - n :])
    return first, text[first]


def anchors_of(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window."""
    g, size = _chain(h, gram, _ODD[0]), window - gram + 1
    n, have, least = len(g) - size + 1, 1, g
    if n <= 0:
        return np.zeros(0, np.uint64)
    while 2 * have <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:n], least[size - have : size - have + n])[first]


def _block(n: int, doc_id: Column, other: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, other)), F.lit(n)).cast("int")


def _no_null(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    texts = pc.fill_null(texts, "")
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            block, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _no_null(b.column(1))
            for k in range(0, b.num_rows, 500):
                h, start = hasher.words(texts.slice(k, 500))
                first, text = _first(start, window)
                a = anchors_of(h, first, window, gram)
                if not len(a):
                    continue
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))  # neighbours mostly share one
                a, text = a[new], text[new]
                blk = block[text + k]
                order = np.lexsort((text, blk, a))
                a, blk, text = a[order], blk[order], text[order]
                head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (blk[1:] != blk[:-1]))))
                several = text[np.append(head[1:], len(a)) - 1] > text[head]
                yield pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array((blk[head] * 2 + several).astype(np.int64))], ["a", "b"])

    return run


def _compared(rows: pa.Table, doc: np.ndarray, t: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block that are compared, in an order that both phases share, and which of all rows are copies.

    ``doc`` and ``t``: ids and text hashes of the block's copies.
    """
    key = lambda d, x: d.view(np.uint64) * _ODD[0] + x.view(np.uint64)
    ids = pc.fill_null(rows["doc_id"], 0).to_numpy()
    copy = np.isin(key(ids, rows["t"].to_numpy()), key(doc, t)) & rows["doc_id"].is_valid().to_numpy()
    rows = rows.append_column("place", pa.array(np.arange(len(rows))))
    rows = rows.filter(pa.array(~copy & rows["doc_id"].is_valid().to_numpy()))
    return rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("t", "ascending"), ("text", "ascending")])), copy


def _confirm(window: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("lo", pa.int64()), ("b", pa.int64())])
        told = right["t"].is_null().to_numpy()
        value = right["value"].to_numpy()
        anchors = np.sort(value[told].view(np.uint64))
        if not len(anchors):
            return schema.empty_table()
        rows, _ = _compared(left, value[~told], pc.fill_null(right["t"], 0).to_numpy()[~told])
        h, start = Hasher().words(_no_null(rows["text"]))
        first, text = _first(start, window)
        a = anchors_of(h, first, window, gram)
        at = first[anchors[np.minimum(np.searchsorted(anchors, a), len(anchors) - 1)] == a]
        if not len(at):
            return schema.empty_table()
        w1, w2 = _chain_at(h, at, window, _ODD[0]), _chain_at(h, at, window, _ODD[1])
        d = rows["doc_id"].to_numpy()[np.searchsorted(start, at, side="right") - 1]
        order = np.lexsort((at, w2, w1))  # places are in the order of ids
        w1, w2, d, at = w1[order], w2[order], d[order], at[order]
        head = np.flatnonzero(np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))))
        many = d[np.append(head[1:], len(d)) - 1] > d[head]
        return pa.Table.from_arrays([pa.array(x) for x in (w1[head].view(np.int64), w2[head].view(np.int64), d[head], at[head] * 2 + many)], schema=schema)

    return run


def compiled(phrases: list[list[bytes]], values: list[int], code: dict[bytes, str]) -> ahocorasick.Automaton:
    """An automaton over the codes of the phrases' words, with a value for each phrase."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
    for words, value in zip(phrases, values, strict=True):
        automaton.add_word("".join(map(code.__getitem__, words)), value)
    automaton.make_automaton()
    return automaton


def codes_of(words: set[bytes]) -> tuple[dict[bytes, str], str]:
    """A code for each word, all of one length, and one for any other word."""
    width = 2
    while 256**width < len(words):
        width += 1
    code = {w: "".join(chr(0x100 * (p + 1) + (k >> 8 * (width - 1 - p) & 255)) for p in range(width)) for k, w in enumerate(sorted(words))}
    return code, "\x01" * width


def occurrences(automaton: ahocorasick.Automaton, text: str, below: int) -> list[int]:
    """Where in a coded text the phrases end whose value is smaller."""
    return [end for end, value in automaton.iter(text) if value < below]


def located(texts: list[list[bytes]], doc: list[int], phrases: list[list[bytes]], values: list[int], window: int) -> list[np.ndarray | None]:
    """The removed words of each text as a mask, None where there are none: those in occurrences of phrases with a smaller value."""
    out: list[np.ndarray | None] = [None] * len(texts)
    if not phrases:
        return out
    code, other = codes_of({w for p in phrases for w in p})
    coded = ["".join(map(code.get, words, repeat(other))) for words in texts]
    edges: list[np.ndarray | None] = [None] * len(texts)
    for k in range(0, len(phrases), SHARD_PHRASES):
        automaton = compiled(phrases[k : k + SHARD_PHRASES], values[k : k + SHARD_PHRASES], code)
        for i, text in enumerate(coded):
            if ends := occurrences(automaton, text, doc[i]):
                if edges[i] is None:
                    edges[i] = np.zeros(len(texts[i]) + 1, np.int64)
                end = np.array(ends) // len(other) + 1
                edges[i][end - window] += 1  # a phrase ends once at a place
                edges[i][end] -= 1
    for i, e in enumerate(edges):
        if e is not None:
            out[i] = np.cumsum(e[:-1]) > 0
    return out


def _locate(window: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right["t"].is_null().to_numpy()
        value, at = right["value"].to_numpy(), pc.fill_null(right["at"], 0).to_numpy()[told]
        rows, copy = _compared(left.select(["doc_id", "text", "t"]), value[~told], pc.fill_null(right["t"], 0).to_numpy()[~told])
        split = lambda texts: [x.encode().split() if x else [] for x in texts.to_pylist()]
        words, place = split(rows["text"]), rows["place"].to_numpy()
        start = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        of = np.searchsorted(start, at, side="right") - 1
        phrases = [words[i][s : s + window] for i, s in zip(of.tolist(), (at - start[of]).tolist(), strict=True)]
        masks: list[np.ndarray | None] = [None] * len(left)
        every: list[list[bytes] | None] = [None] * len(left)
        for p, w, gone in zip(place.tolist(), words, located(words, rows["doc_id"].to_pylist(), phrases, value[told].tolist(), window), strict=True):
            every[p], masks[p] = w, gone
        out = []
        for p, w in enumerate(every):
            w = w if w is not None else split(left["text"].slice(p, 1))[0]
            gone = np.ones(len(w), bool) if copy[p] and len(w) >= window else masks[p]
            if gone is None:
                out.append((b" ".join(w).decode(), len(w), 0, []))
            else:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                kept = b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
                out.append((kept.decode(), len(w), int(gone.sum()), edges.tolist()))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        return pa.Table.from_arrays([left["r"].combine_chunks(), *columns], names)

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``kept_text`` (kept words joined by one space), ``n_words``, ``n_removed`` and ``spans`` to ``documents``.

    ``spans`` are the removed word ranges, starts and ends in turn.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    digests = stored(documents.select(doc_id.alias("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("size")))
    n_blocks = max(MIN_BLOCKS, -(-(digests.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    known = digests.filter("doc_id is not null and size > 0")
    several = known.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("sha", "least")
    copies = known.join(several, "sha").filter("doc_id > least").select("doc_id", "t").distinct()
    copies = stored(copies.select(_block(n_blocks, F.col("doc_id"), F.lit(0)).alias("blk"), F.lit(None).cast("bigint").alias("at"), F.col("doc_id").alias("value"), "t"))

    dealt = documents.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    dealt = dealt.withColumn("blk", _block(n_blocks, F.col("doc_id"), F.col("t")))
    anchors = dealt.filter("doc_id is not null and text is not null").select("blk", "text").mapInArrow(_anchor_rows(window, gram), "a bigint, b bigint")
    blk = F.shiftright("b", 1)
    anchors = anchors.groupBy("a", blk.alias("blk")).agg(((F.count("*") > 1) | (F.max(F.col("b") % 2) > 0)).alias("many"))
    by = W.partitionBy("a")
    anchors = anchors.select("a", "blk", F.count("*").over(by).alias("n"), F.max("many").over(by).alias("many")).filter("n > 1 or many")
    nothing = F.lit(None).cast("bigint")
    again = stored(anchors.select(F.col("blk").cast("int").alias("blk"), nothing.alias("at"), F.col("a").alias("value"), nothing.alias("t")))

    rows = dealt.groupBy("blk").cogroup(again.unionByName(copies).groupBy("blk")).applyInArrow(_confirm(window, gram), "w1 bigint, w2 bigint, lo bigint, b bigint")
    rows = rows.select("lo", "b", F.min("lo").over(W.partitionBy("w1", "w2")).alias("least"))  # at most a row per block in a window
    # the block of the smallest document has nothing to remove unless another of its documents has the window
    phrases = rows.filter("b % 2 = 1 or lo > least").select(_block(n_blocks, F.col("lo"), F.lit(0)).alias("blk"), F.shiftright("b", 1).alias("at"), F.col("least").alias("value"), nothing.alias("t"))
    phrases = stored(phrases)

    own = [c for c in documents.columns if c not in RESULTS]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own) if c != "text"])
    full = documents.select(rest.alias("r"), doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    full = full.withColumn("blk", _block(n_blocks, F.col("doc_id"), F.col("t")))
    kind = T.StructType([full.schema["r"], *T.StructType.fromDDL("kept_text string, n_words bigint, n_removed bigint, spans array<bigint>")])
    out = full.groupBy("blk").cogroup(phrases.unionByName(copies).groupBy("blk")).applyInArrow(_locate(window, ["r", *RESULTS]), kind)
    return out.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(own) if c != "text"], *RESULTS)
