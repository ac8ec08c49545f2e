"""Chat formatting at token level.

Each turn's text is escaped and encoded by itself with a byte-level tokenizer; reserved ids, which no text can encode
to, are spliced round it. A conversation's turns are laid out in chunks of whole turns; where each content begins in its
chunk comes from prefix sums of the segments' lengths, and the loss mask covers the assistants' contents.

Template: ``<<SYS>>`` text ``<</SYS>>``, ``[INST]`` text ``[/INST]``, ``<s>`` text ``</s>`` for system, user and assistant;
``<|role|>`` role ``<|text|>`` text ``<|end|>`` for any other role. A control string inside a text gets a mark after
its first character (one more where there are marks already), which reading takes away again.

Rows are encoded before the shuffle; a conversation is then streamed in order by one task that holds one chunk, so that a
conversation of very many turns needs no memory, and decoded again before its digests are streamed.

Cases: null or empty texts are turns with an empty text, a null role is an empty other role. Turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order. Rows with a null ``conv_id`` are one
conversation. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of that kind splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"]
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
MARK = "⁣"
CHUNK_TOKENS, MAX_VOCABULARY = 8192, 32 << 20
_TIGHT = re.compile("|".join(f"{re.escape(c[0])}{MARK}*{re.escape(c[1:])}" for c in CONTROLS))
_LOOSE = re.compile("|".join(f"{re.escape(c[0])}{MARK}+{re.escape(c[1:])}" for c in CONTROLS))
_READY: dict[bytes, tiktoken.Encoding] = {}


def escape(text: str) -> str:
    return _TIGHT.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _LOOSE.sub(lambda m: m[0][0] + m[0][2:], text)


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The file's bytes, read by the driver; they travel with the tasks, so their size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    return data


def _encoding(data: bytes) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The tokenizer, once for each worker, and the ids of the control strings: those after its last."""
    key = hashlib.sha256(data).digest()
    if key not in _READY:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        _READY[key] = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoding = _READY[key]
    return encoding, {c: encoding.max_token_value + 1 + k for k, c in enumerate(CONTROLS)}


def segments(role: str | None, text: str | None, encoding: tiktoken.Encoding, ids: dict[str, int]) -> tuple[list[int], list[int], list[int]]:
    """What opens a turn, its content, and what closes it."""
    content = encoding.encode_ordinary(escape(text or ""))
    if role in FRAMES:
        before, after = FRAMES[role]
        return [ids[before]], content, [ids[after]]
    return [ids["<|role|>"], *encoding.encode_ordinary(escape(role or "")), ids["<|text|>"]], content, [ids["<|end|>"]]


def _encode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ids = _encoding(data)
        for b in batches:
            parts = [segments(r, t, encoding, ids) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            tokens, opened, content = [x + y + z for x, y, z in parts], [len(x) for x, _, _ in parts], [len(y) for _, y, _ in parts]
            columns = [pa.array(tokens, pa.list_(pa.int32())), pa.array(opened, pa.int32()), pa.array(content, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["conv_id", "turn", "role", "text", "tokens", "opened", "content"])

    return run


def _assemble(most: int):
    """Rows sorted by conversation and turn -> chunks of whole turns with their loss spans."""
    names = ["conv_id", "chunk", "tokens", "loss"]

    def chunk(conv: int | None, k: int, turns: list[tuple[np.ndarray, int, int, bool]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t, _, _, _ in turns], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) + np.array([o for _, o, _, _ in turns], np.int64)
        ends = starts + np.array([c for _, _, c, _ in turns], np.int64)
        learn = np.array([x for _, _, _, x in turns], bool)
        loss = np.stack((starts[learn], ends[learn]), 1).ravel()
        tokens = np.concatenate([t for t, _, _, _ in turns])
        columns = [pa.array([conv], pa.int64()), pa.array([k], pa.int64()), pa.array([tokens], pa.list_(pa.int32())), pa.array([loss], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, held, size = (), 0, [], 0
        for b in batches:
            tokens = b.column(2)
            for i, (conv, learn, opened, content) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 3, 4)), strict=True)):
                if now != (conv,) or size >= most:
                    if held:
                        yield chunk(now[0], k, held)
                    k = k + 1 if now == (conv,) else 0
                    now, held, size = (conv,), [], 0
                t = np.asarray(tokens[i].values, np.int32)
                held.append((t, opened, content, learn))
                size += len(t)
        if held:
            yield chunk(now[0], k, held)

    return run


def format_conversations(conversations: DataFrame, path: str = VOCABULARY, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of formatted conversations: ``conv_id``, ``chunk``, ``tokens``, ``loss`` (starts and ends in turn)."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_encode(vocabulary(path)), "conv_id bigint, turn bigint, role string, text string, tokens array<int>, opened int, content int")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"), "tokens", "opened", "content")
    return rows.mapInArrow(_assemble(chunk_tokens), "conv_id bigint, chunk bigint, tokens array<int>, loss array<bigint>")


def turns_of(tokens: list[int], encoding: tiktoken.Encoding, ids: dict[str, int]) -> list[tuple[str, str]]:
    """(role, text) of the turns in a chunk's tokens."""
    roles = {ids[a]: (role, ids[b]) for role, (a, b) in FRAMES.items()}
    read = lambda a, b: unescape(encoding.decode_bytes(tokens[a:b]).decode())
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] in roles:
            role, close = roles[tokens[i]]
            start = i + 1
        else:
            start = tokens.index(ids["<|text|>"], i) + 1
            role, close = read(i + 1, start - 1), ids["<|end|>"]
        i = tokens.index(close, start)
        out.append((role, read(start, i)))
        i += 1
    return out


def _decode(data: bytes):
    names = ["conv_id", "chunk", "n", "turns", "loss", "loss_chars", "chars"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ids = _encoding(data)
        width = {k: len(c) for c, k in ids.items()}
        first = min(width)
        for b in batches:
            rows = []
            for conv, k, tokens, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = turns_of(tokens, encoding, ids)
                flat = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                learned = "".join(unescape(encoding.decode_bytes(tokens[s:e]).decode()) for s, e in zip(loss[::2], loss[1::2], strict=True))
                plain = encoding.decode_bytes([t for t in tokens if t < first]).decode()
                rows.append((conv, k, len(turns), flat, learned.encode(), len(learned), len(plain) + sum(width[t] for t in tokens if t >= first)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded chunks sorted by conversation and place -> one row for each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, out = None, []

    def made() -> tuple:
        conv, n, turns, loss_chars, loss, chars = now
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for conv, n, turns, loss, loss_chars, chars in zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4, 5, 6)), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(made())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1], now[3], now[5] = now[1] + n, now[3] + loss_chars, now[5] + chars
            now[2].update(turns)
            now[4].update(loss)
        if out:
            yield batch()
            out.clear()
    if now is not None:
        out.append(made())
        yield batch()


def read_back(formatted: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Of each conversation of ``format_conversations``, read from its tokens: counts and digests of turns and loss."""
    rows = formatted.mapInArrow(_decode(vocabulary(path)), "conv_id bigint, chunk bigint, n bigint, turns binary, loss binary, loss_chars bigint, chars bigint")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return rows.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def round_trip(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Formats, stores and reads back."""
    return read_back(stored(format_conversations(conversations, path)), path)
