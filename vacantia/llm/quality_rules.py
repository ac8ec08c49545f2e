"""Quality rules, lines first.

Each line with a word is judged by three rules: punctuation (symbols, or runs of them, in place of prose; shouting),
navigation (many short parts between separators) and boilerplate (a phrase of web pages, by language, in a short line, or words
said over and over). Lines that fail are
removed; a document that loses more than ``max_lost`` of the code points of its words is rejected, as is one that
fails the base rules.

Cases: a null or empty text has no words and fails the base rules. Rows are judged one by one, so repeated rows,
ties and null ids need no rule. Very long texts are read whole. Input columns named as a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_failed_lines")
TYPES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, clean_text string, n_failed_lines bigint"
SYMBOLS = b"#*$%&|<>"
#: A line fails with more symbols than this share of its bytes, or this share of words that end in two marks.
MAX_SYMBOLS, MAX_MARKED = 0.08, 0.3
#: A line of this many parts between separators, of at most so many words each, is navigation.
NAV_PARTS, NAV_WORDS = 4, 3
#: A document is rejected beyond this share of its words' code points in failed lines.
MAX_LOST = 0.5
#: Phrases by language that fail a line of at most ``BOILERPLATE_WORDS`` words.
PHRASES = {
    "any": r"lorem ipsum|(?:©|\(c\)) ?(?:19|20)\d\d",
    "en": r"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|enable javascript|click here to|sign up for our|subscribe to our|skip to (?:main )?content|powered by \w+|share (?:this )?on (?:facebook|twitter)|leave a (?:comment|reply)",
    "de": r"alle rechte vorbehalten|nutzungsbedingungen|datenschutz(?:erklärung|bestimmungen)|cookie-(?:richtlinie|einstellungen)|aktivieren sie javascript|klicken sie hier|newsletter abonnieren|zum inhalt springen|kommentar hinterlassen",
    "fr": r"tous droits réservés|conditions (?:générales )?d[’']utilisation|politique de confidentialité|mentions légales|gérer les cookies|activer javascript|cliquez ici pour|abonnez-vous à|aller au contenu|laisser un commentaire",
    "es": r"todos los derechos reservados|términos (?:de uso|y condiciones)|política de (?:privacidad|cookies)|aviso legal|activar javascript|haga clic aquí|suscríbete a|saltar al contenido|deja un comentario",
}
BOILERPLATE = re.compile("|".join(PHRASES.values()))
BOILERPLATE_WORDS = 25
#: A phrase has one of these pieces, which are looked for first.
_PIECES = tuple(x.encode() for x in ("lorem", "©", "(c)", "rights", "terms of", "policy", "cookie", "javascript", "click here", "sign up", "subscribe", "skip to", "powered", "share ", "leave a", "rechte", "nutzungs", "datenschutz", "klicken", "abonn", "springen", "hinterlassen", "droits", "conditions", "politique", "mentions", "cliquez", "contenu", "commentaire", "derechos", "rminos", "pol\u00edtica", "aviso", "haga clic", "suscr", "contenido", "comentario"))
#: Filler: a line of so many words fails if more than this share of them repeat the word before.
STUTTER_WORDS, MAX_STUTTER = 10, 0.3
#: Whole characters, in UTF-8: | > · • › and, in a line without «, ».
_SEPARATORS = (b"|", b">", b"\xc2\xb7", b"\xe2\x80\xa2", b"\xe2\x80\xba", b"\xc2\xbb")
_SEPARATOR = re.compile(rb"\||>|\xc2\xb7|\xe2\x80\xa2|\xe2\x80\xba|\xc2\xbb")
_NO_QUOTE = re.compile(rb"\||>|\xc2\xb7|\xe2\x80\xa2|\xe2\x80\xba")
_MARKED = re.compile(rb"[!?*#$%&|<>=~^]{2,}(?:[\s.,]|$)")


def line_fails(line: bytes) -> str | None:
    """The rule that a line with a word fails, or None."""
    n, words = len(line), line.count(b" ") + 1
    if any(s in line for s in _SEPARATORS):
        parts = [p for p in (_NO_QUOTE if b"\xc2\xab" in line else _SEPARATOR).split(line) if p.strip()]
        if len(parts) >= NAV_PARTS and words <= NAV_WORDS * len(parts):
            return "navigation"
    if n - len(line.translate(None, SYMBOLS)) > MAX_SYMBOLS * n:
        return "punctuation"
    if (b"!!" in line or b"??" in line or b"==" in line or b"~~" in line) and len(_MARKED.findall(line)) > MAX_MARKED * words:
        return "punctuation"
    if words <= BOILERPLATE_WORDS:
        low = line.lower() if line.isascii() else line.decode().lower().encode()
        if any(p in low for p in _PIECES) and BOILERPLATE.search(low.decode()):
            return "boilerplate"
    if words >= STUTTER_WORDS:
        each = line.split()
        if sum(map(eq, each, each[1:])) > MAX_STUTTER * len(each):
            return "boilerplate"
    return None


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    if len(number) + size > len(words):  # too few repeated words for two equal windows
        return 0
    width = max(1, len(number).bit_length())
    if width * size <= 64:
        key = ids[:n].copy()
        for k in range(1, size):
            key = key << np.uint64(width) | ids[k : k + n]
    else:  # pairs of windows are numbered exactly, then joined
        key = ids[:n].copy()
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | ids[k : k + n]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str, int]:
    """The values of ``RESULTS`` for one text."""
    text = text or ""
    b = text.encode()
    words = b.split()
    word_chars = len(text) - (len(b) - sum(map(len, words)))
    lines = b.split(b"\n")
    full = [x for x in lines if x.strip()]
    repeated = repeat_words(words)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    bad = {x for x in set(full) if line_fails(x.strip())}
    clean, lost, n_bad = text, 0, 0
    if bad:
        gone = [x for x in full if x in bad]
        n_bad = len(gone)
        lost = sum(len(b"".join(x.split()).decode()) for x in gone)
        clean = b"\n".join(x for x in lines if x not in bad).decode()
    kept = not failed and lost <= MAX_LOST * word_chars
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    return len(words), word_chars, symbols, len(full) - len(set(full)), repeated, failed, kept, clean, n_bad


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string(), pa.int64())
    for b in batches:
        if not b.num_rows:
            continue
        out = zip(*map(judge, b.column(1).to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["r", *RESULTS])


def quality(documents: DataFrame) -> DataFrame:
    """``documents`` without ``text`` but with ``RESULTS``; ``clean_text`` is the text without its failed lines."""
    own = [c for c in documents.columns if c not in ("text", *RESULTS)]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    rows = documents.select(rest.alias("r"), F.col("text").cast("string").alias("x"))
    out = rows.mapInArrow(_run, f"r {rows.schema['r'].dataType.simpleString()}, {TYPES}")
    return out.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(own)], *RESULTS)
