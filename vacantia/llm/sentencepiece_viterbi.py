"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public model file, whose path is a parameter; nothing is trained. Where the file's scores are
not log probabilities (merge ranks), a piece of rank r gets ``-log(r + ZIPF)`` less the log of the sum, so that the best
segmentation is that of largest probability under Zipf's law. A character without a piece costs ``UNKNOWN`` below the least score
and becomes its bytes' pieces. A marker stands for a space: one is set before the text and taken away on decoding.
A literal marker character in a text is encoded as bytes, so every text comes back exactly.

No piece has a space after another character or a line feed beside one (checked on loading; else whole texts are the
segments), so the best path of a text is those of its segments ``spaces + word``, one after another. Distinct segments of a batch
are solved together: all trie walks at once, then the lattices position by position.

Cases: a null text has no ids and decodes to null; an empty one has no ids and decodes to an empty text. Rows are encoded one by
one, so repeated rows, ties in other columns and null ids need no rule; of two paths of equal score the one whose last piece is
longer is taken. Very long texts are encoded whole. Input columns named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF, UNKNOWN, MAX_MODEL = 2.7, 10.0, 64 << 20
#: Segments solved together; segments whose ids a worker remembers.
TOGETHER, REMEMBERED = 30_000, 300_000
MARKER = "▁"
RESULTS = ("ids", "n_tokens", "decoded")


@dataclass
class Vocabulary:
    """Bytes of each piece (the marker is a space), log scores, ids of the single bytes, and the trie."""

    pieces: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    whole: bool


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and the value that ends at each state (-1: none); state 0 is the root."""
    root: dict = {}
    for key, value in zip(keys, values, strict=True):
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0], low, todo = 0, 1, [(root, 0)]
    while todo:
        node, state = todo.pop()
        value[state] = node.get(-1, -1)
        edges = sorted(c for c in node if c >= 0)
        if not edges:
            continue
        while low < size and check[low] >= 0:
            low += 1
        reach = 512
        while True:
            free = np.flatnonzero(check[low : low + reach] < 0) + low - edges[0]
            free = free[(free > 0) & (free + edges[-1] < size)]
            for c in edges[1:]:
                free = free[check[free + c] < 0]
            if len(free):
                break
            if low + reach >= size:
                base, check, value = (np.concatenate((a, np.full(size, x, np.int32))) for a, x in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            reach *= 4
        at = int(free[0])
        base[state] = at
        for c in edges:
            check[at + c] = state
            todo.append((node[c], at + c))
    # so that a walk may look at any byte of any state
    return tuple(np.concatenate((a, np.full(256, x, np.int32))) for a, x in ((base, 0), (check, -1), (value, -1)))


_LOADED: dict[str, Vocabulary] = {}


def load(path: str = MODEL) -> Vocabulary:
    """The driver reads the file; the arrays travel with the tasks, so the file's size is checked."""
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read(MAX_MODEL + 1)
    if len(data) > MAX_MODEL:
        raise ValueError(f"{path} has more than {MAX_MODEL} bytes")
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        _LOADED[key] = build([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], [model.is_byte(i) for i in range(n)], [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
    return _LOADED[key]


def build(names: list[str], scores: list[float], is_byte: list[bool], is_special: list[bool]) -> Vocabulary:
    """A vocabulary from its pieces; ``scores`` are log probabilities, or ranks if they are whole numbers."""
    n = len(names)
    plain = [i for i in range(n) if not is_byte[i] and not is_special[i]]
    score = np.array(scores, np.float64)
    if all(float(scores[i]).is_integer() for i in plain):
        order = sorted(plain, key=lambda i: (-scores[i], i))
        score[order] = -np.log(np.arange(len(order)) + ZIPF)
        score[order] -= np.log(np.exp(score[order]).sum())
    pieces = [b"" if is_special[i] else bytes([int(names[i][1:-1], 16)]) if is_byte[i] else names[i].replace(MARKER, " ").encode() for i in range(n)]
    byte_id = np.full(256, -1, np.int32)
    for i in range(n):
        if is_byte[i]:
            byte_id[pieces[i][0]] = i
    base, check, piece = double_array([pieces[i] for i in plain], plain)
    whole = any(re.search(rb"[^ ] |[^\n]\n|\n[^\n]|\n\n", pieces[i]) for i in plain)
    return Vocabulary(pieces, score, byte_id, base, check, piece, whole)


_SEGMENT = re.compile(rb"\n| *[^ \n]+| +")


def viterbi(v: Vocabulary, segments: list[bytes]) -> list[bytes]:
    """The ids (int32, as bytes) of the best path of each segment."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64)
    n = len(text)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(segments)), sizes)
    end_of = offset[1:][owner]
    lead = np.flatnonzero((text & 0xC0) != 0x80)
    width = np.where(text[lead] < 0xC0, 1, np.where(text[lead] < 0xE0, 2, np.where(text[lead] < 0xF0, 3, 4)))
    single = np.zeros(n, bool)
    starts, ends, ids = [], [], []
    state, at, k = np.zeros(len(lead), np.int64), lead, 0
    char_end = lead + width
    begin, its_end = lead, char_end
    while len(at):
        to = v.base[state] + text[at]
        ok = v.check[to] == state
        # a state without children has base 0; the root's own children are told apart by their check
        ok &= to != 0
        state, begin, its_end, at = to[ok], begin[ok], its_end[ok], at[ok] + 1
        found = v.piece[state] >= 0
        starts.append(begin[found])
        ends.append(at[found])
        ids.append(v.piece[state[found]])
        single[begin[found & (at == its_end)]] = True
        k += 1
        more = at < end_of[begin]
        state, begin, its_end, at = state[more], begin[more], its_end[more], at[more]
    lost = ~single[lead]
    least = min((float(v.score[i]) for i in set(v.piece[v.piece >= 0].tolist())), default=0.0) if lost.any() else 0.0
    start = np.concatenate([*starts, lead[lost]])
    end = np.concatenate([*ends, char_end[lost]])
    id_ = np.concatenate([*ids, np.full(int(lost.sum()), -1)]).astype(np.int64)
    cost = np.where(id_ < 0, least - UNKNOWN, v.score[id_])
    place = start - offset[owner[start]]
    order = np.argsort(place, kind="stable")
    start, end, id_, cost, place = start[order], end[order], id_[order], cost[order], place[order]
    # node of a boundary: byte position plus the segment's number, so that segments share none
    a, b = start + owner[start], end + owner[start]
    best, back = np.full(n + len(segments), -np.inf), np.full(n + len(segments), -1, np.int64)
    best[offset[:-1] + np.arange(len(segments))] = 0
    cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        reach = best[a[i:j]] + cost[i:j]
        better = np.flatnonzero(reach > best[b[i:j]])
        to = b[i:j][better]
        best[to] = reach[better]
        back[to] = better + i
    live = np.flatnonzero(sizes > 0)
    node = offset[1:][live] + live
    path = []
    while len(live):
        edge = back[node]
        path.append(edge)
        node = a[edge]
        on = node > offset[:-1][live] + live
        live, node = live[on], node[on]
    edge = np.concatenate(path) if path else np.zeros(0, np.int64)
    edge = edge[np.argsort(start[edge], kind="stable")]
    count = np.where(id_[edge] < 0, end[edge] - start[edge], 1)
    first = np.repeat(np.cumsum(count) - count, count)
    which = np.repeat(edge, count)
    at = start[which] + np.arange(len(which)) - first
    tokens = np.where(id_[which] < 0, v.byte_id[text[at]] if len(at) else 0, id_[which]).astype(np.int32)
    per = np.bincount(owner[start[which]], minlength=len(segments)) if len(which) else np.zeros(len(segments), np.int64)
    edges = np.concatenate(([0], np.cumsum(per))) * 4
    raw = tokens.tobytes()
    return [raw[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts and remembers the ids of segments."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else [] if not t else [b" " + t.encode()] if self.v.whole else _SEGMENT.findall(b" " + t.encode()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({s for c in cut if c for s in c}.difference(self.known))
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            self.known.update(zip(part, viterbi(self.v, part), strict=True))
        get = self.known.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]


def decode(v: Vocabulary, ids: np.ndarray | None) -> str | None:
    return None if ids is None else b"".join(map(v.pieces.__getitem__, ids.tolist())).decode()[1:]


def encode_documents(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """``documents`` with ``ids``, their number ``n_tokens``, and ``decoded``, the text read back from the ids."""
    v = load(path)
    own = [c for c in documents.columns if c not in RESULTS]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own) if c != "text"])
    rows = documents.select(rest.alias("r"), F.col("text").cast("string").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = encoder.encode(part.column(1).to_pylist())
                sizes = np.array([0 if i is None else len(i) for i in ids], np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*(i is None for i in ids), False]))
                flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
                columns = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(sizes), pa.array([decode(v, i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["r", *RESULTS])

    out = rows.mapInArrow(run, f"r {rows.schema['r'].dataType.simpleString()}, ids array<int>, n_tokens bigint, decoded string")
    return out.select(*[F.col("decoded").alias("text") if c == "text" else F.col(f"r.c{i}").alias(c) for i, c in enumerate(own)], *RESULTS)
