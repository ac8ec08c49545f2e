"""Personal data by a semi-Markov conditional random field over whole spans.

Plain rules find e-mail addresses, public addresses, card numbers and phone numbers that are written as expected; these spans stay. The
model adds what the rules lose: numbers that run into each other (a card behind a phone number), other separators, phone numbers
without a country's prefix, cards of 13 to 15 digits, addresses written with spelled signs.

A region is a stretch of digits and separators, or what stands round a sign or word for "at"; outside of regions no segment can be
an entity, so the rest of a text needs no scoring. A region's candidates are spans of up to ``MOST`` tokens with a type; each is scored as a
whole (number of digits, sizes of groups, separators, check digit, the word before, what it would cut apart), and against the type of the entity
before it in the region. Dynamic programming over the tokens picks the boundaries and types of largest sum together;
tokens of no entity score zero; tokens of the rules' spans are taken already.

Weights are fitted by gradient steps on the conditional likelihood of ``EXAMPLES`` made sentences, from a fixed seed: the bound of the sample is that parameter.

Cases: a null text is empty; rows are judged one by one, so repeated rows have equal results; a null ``doc_id`` stays null. Only ASCII digits and
letters count. Extra columns are ignored. A text is scanned in time proportional to its length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST, EXAMPLES, EPOCHS = 24, 700, 8
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Numbers that stand together: groups of digits with up to three separators between them.
NUMBERS = re.compile(r"(?:\+ ?)?\(?(?<![0-9])[0-9]++(?:[\x20\xa0.()/+-]{1,3}[0-9]++)*+")
MARK = re.compile(r"@|(?<![A-Za-z0-9])(?:at|arroba)(?![A-Za-z0-9])", re.I)
_DOT = r"(?:\s{0,2}[\[({<]\s?(?:dot|\.|punkt|punto)\s?[\])}>]\s{0,2}|\s{1,2}(?:dot|punkt|punto)\s{1,2}|\.)"
AT = re.compile(r"\s{0,2}(?:[\[({<]\s?(?:at|@|arroba)\s?[\])}>]|at|arroba|@)\s{0,2}", re.I)
HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,64}}{_DOT}){{0,3}}[A-Za-z0-9_%+-]{{1,64}}\Z", re.I)
DOT = re.compile(_DOT, re.I)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.S)
WORD_BEFORE = re.compile(r"([A-Za-zÀ-ÿ#$€£-]+)[^A-Za-zÀ-ÿ0-9#$€£]{0,4}\Z")

#: Words that speak of what follows, by what they speak for.
CUES = {
    "phone": "tel telefon telephone telefono teléfono téléphone phone phones call mobile mobil cell fax handy whatsapp anruf appeler llamar móvil ruf dial number",
    "card": "card visa mastercard amex karte kreditkarte carte tarjeta credit debit maestro payment",
    "ip": "ip host server address addr ping client from gateway dns",
    "email": "mail email e-mail contact write courriel correo kontakt reach address",
    "other": "order invoice isbn version release build ref reference id no nr page serial lot date article item ticket case account v ver tracking part # $ € £ section figure chapter",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_TLD = frozenset("com org net edu gov io de fr es it uk eu info ch at nl be co us ca mx br".split())

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind as listed, then place."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for kind, pattern, low, high in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for m in pattern.finditer(text):
            d = digits_of(m[0])
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(start, end, addresses) of the stretches that may hold an entity, in order; an address is where its local part, sign, host and end are."""
    found = [(*m.span(), []) for m in NUMBERS.finditer(text) if m.end() - m.start() >= 7 and sum(map(str.isdigit, m[0])) >= 7]
    for m in MARK.finditer(text):
        first = m.start()
        while first > max(0, m.start() - 4) and text[first - 1] in " \t\n[({<":
            first -= 1
        sign = next((s for k in range(first, m.start() + 1) if (s := AT.match(text, k)) and s.end() > m.start()), None)
        host = sign and HOST.match(text, sign.end())
        # a bare word needs space on both sides
        if not host or m[0] != "@" and not (sign[0][0].isspace() and sign[0][-1].isspace() or sign[0].strip()[0] in "[({<"):
            continue
        low = max(0, sign.start() - 200)
        local = BEFORE.search(text[low : sign.start()])
        if local:
            found.append((low + local.start(), host.end(), [(low + local.start(), sign.start(), sign.end(), host.end())]))
    out: list = []
    for s, e, a in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2] + a)
        else:
            out.append((s, e, a))
    return out


def _shape(y: str, text: str, s: int, e: int) -> list[str]:
    """Features of a span of digits as a ``y``."""
    body = text[s:e]
    groups, between = re.findall("[0-9]+", body), re.split("[0-9]+", body)
    inner = between[1:-1]
    digits = "".join(groups)
    n, before, after = len(digits), text[max(0, s - 24) : s], text[e : e + 3]
    signs = {c for x in inner for c in x}
    style = "none" if not inner else "".join(sorted(signs)) if len(signs) < 3 else "many"
    word = WORD_BEFORE.search(before)
    cue = _CUE.get(word[1].lower(), "word") if word else "none"
    f = [f"digits={n}", f"groups={min(len(groups), 7)}", f"style={style}", f"open={between[0]}", f"cue={cue}", f"sizes={'-'.join(str(len(g)) for g in groups)}" if len(groups) < 7 else "sizes=many"]
    if before[-1:].isalnum() or before[-1:] == "_" or after[:1].isalnum() or after[:1] == "_":
        f.append("glued")
    if before[-1:] in tuple("#$€£=%") or after[:1] in tuple("%€£$°"):
        f.append("unit")
    if re.search(r"[0-9][-./]\Z", before) or re.match(r"[-./][0-9]", after):
        f.append("cuts")
    if re.search(r"\+ ?\(?\Z", before):
        f.append("leaves plus")
    if "(" in body and body.count("(") != body.count(")"):
        f.append("unbalanced")
    if len({len(x) for x in inner}) > 1 and y != "phone":
        f.append("uneven")
    if any(len(x) > 1 and x not in (") ", ")-", " (", "-(") for x in inner):
        f.append("wide")
    if y == "card":
        f += [f"luhn={luhn(digits)},{'long' if n > 15 else 'short' if n > 12 else 'no'}", f"first={digits[0]}"]
    elif y == "ip":
        f.append(f"zeros={any(len(g) > 1 and g[0] == '0' for g in groups)}")
    else:
        f += [f"zero={digits[:2] if digits[0] == '0' else 'no'}", f"plus={between[0][:1] == '+'}", f"date={bool(re.fullmatch('(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2}.*', body))}", f"luhn16={n > 15 and luhn(digits)}"]
    return f


def _address(text: str, s: int, sign: int, host: int, e: int, whole: tuple[int, int, int, int]) -> list[str]:
    """Features of a span as an address written in some way."""
    at, left, right = text[sign:host].strip(), text[s:sign], text[host:e]
    dots, labels = DOT.findall(right), DOT.split(right)
    spelled = {"." if d == "." else "spelled" for d in dots}
    word = WORD_BEFORE.search(text[max(0, s - 24) : s])
    return [
        f"at={'sign' if at == '@' else 'bare' if at.isalpha() else 'framed'},{'+'.join(sorted(spelled))}", f"top={'known' if labels[-1].lower() in _TLD else 'short' if labels[-1].isalpha() and len(labels[-1]) < 5 else 'other'}",
        f"labels={min(len(labels), 5)}", f"local={'mixed' if re.search('[0-9_.]', left) or DOT.search(left) else 'plain'}", f"cue={_CUE.get(word[1].lower(), 'word') if word else 'none'}",
        f"cuts left={s > whole[0]}", f"cuts right={e < whole[3]}", f"spaced={at == '@' and host - sign > 1}", f"numbers={all(x.isdigit() for x in labels)}", f"one={len(left) < 2}",
    ]


def candidates(text: str, region: tuple, taken: list[Span]) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """A region's token boundaries, and its candidates (first and last boundary, type, features); ``taken`` are the rules' spans in it."""
    low, high, addresses = region
    edges = [low, *(m.end() for m in TOKEN.finditer(text, low, high))]
    place, out = {x: k for k, x in enumerate(edges)}, []
    used = [0] * len(edges)  # before each boundary, how many tokens belong to the rules' spans
    spans, k = sorted((a, b) for _, a, b in taken), 0
    ends = list(itertools.accumulate((b for _, b in spans), max))
    for j in range(1, len(edges)):
        while k < len(spans) and spans[k][0] < edges[j]:
            k += 1
        used[j] = used[j - 1] + (k > 0 and ends[k - 1] > edges[j - 1])
    tokens = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    number = [t[0] in "0123456789" for t in tokens]
    for i, c in enumerate(tokens):
        if not number[i] and (c not in "+(" or not re.match(r"\+? ?\(?[0-9]", text[edges[i] : edges[i] + 4])):
            continue
        n, sizes, dots, gap = 0, [], True, 0
        for j in range(i, min(i + MOST, len(tokens))):
            t = tokens[j]
            if not number[j]:
                gap += 1
                if t not in " \xa0.()/+-" or gap > 3:
                    break
                dots = dots and t == "."
                continue
            n, gap = n + len(t), 0
            sizes.append(len(t))
            # a number has at most two groups of one digit, a card one, and an address four small ones between points
            if n > 19 or len(sizes) > 7 or sizes.count(1) > (4 if dots and len(sizes) <= 4 else 2):
                break
            kinds = (
                (len(sizes) == 4 and dots and number[i] and all(map(small, tokens[i : j + 1 : 2])), "ip"),
                (n >= 13 and number[i] and sizes.count(1) < 2 and len(sizes) <= 6, "card"),
                (7 <= n <= 15 and sizes.count(1) < 3, "phone"),
            )
            for fits, y in kinds:
                if fits and used[j + 1] == used[i]:
                    out.append((i, j + 1, y, _shape(y, text, edges[i], edges[j + 1])))
    for whole in addresses:
        first, sign, host, end = whole
        starts = [first, *(first + m.end() for m in DOT.finditer(text[first:sign]))]
        ends = [*(host + m.start() for m in DOT.finditer(text[host:end])), end][1:]
        for s in starts:
            for e in ends:
                if s in place and e in place and place[e] - place[s] <= MOST and used[place[e]] == used[place[s]]:
                    out.append((place[s], place[e], "email", _address(text, s, sign, host, e, whole)))
    return edges, sorted(out, key=lambda c: (c[1], c[0], c[2]))


def _keys(y: str, features: list[str]) -> list[str]:
    return [y, *[f"{y}|{f}" for f in features]]


def best_spans(edges: list[int], options: list, weights: dict[str, float], held: dict[int, str]) -> list[Span]:
    """Viterbi over the boundaries. State: the type of the last entity; ``held``: types of the rules' spans by the boundary at which they end."""
    states: list[dict[str, tuple[float, tuple | None]]] = [{"": (0.0, None)}] + [{} for _ in edges[1:]]
    by_end: dict[int, list] = {}
    for c in options:
        by_end.setdefault(c[1], []).append((c[0], c[2], sum(weights.get(k, 0.0) for k in _keys(c[2], c[3]))))
    for j in range(1, len(edges)):
        now = {}
        for y, v in states[j - 1].items():
            y = held.get(j, y)
            if y not in now or v[0] > now[y][0]:
                now[y] = v
        for i, y, score in by_end.get(j, ()):
            for before, (total, path) in states[i].items():
                new = total + score + weights.get(f"{before}>{y}", 0.0)
                if y not in now or new > now[y][0]:
                    now[y] = (new, (path, (y, edges[i], edges[j])))
        states[j] = now
    path, out = max(states[-1].values(), key=lambda v: v[0])[1], []
    while path:
        path, span = path
        out.append(span)
    return out[::-1]


def _held(edges: list[int], taken: list[Span]) -> dict[int, str]:
    return {min(bisect.bisect_left(edges, e), len(edges) - 1): y for y, _, e in taken}


def all_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and these with the model's, by kind as listed, then place."""
    text = text or ""
    base = base_spans(text)
    by_start, added, k = sorted(base, key=lambda x: x[1]), [], 0
    longest = max((e - s for _, s, e in base), default=0)
    for region in regions(text):
        while k < len(by_start) and by_start[k][1] + longest <= region[0]:
            k += 1
        taken, i = [], k
        while i < len(by_start) and by_start[i][1] < region[1]:
            if by_start[i][2] > region[0]:
                taken.append(by_start[i])
            i += 1
        edges, options = candidates(text, region, taken)
        if options:
            added += best_spans(edges, options, weights, _held(edges, taken))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


# --- sentences to fit and to test the model by ---


def _number(r: random.Random, kind: str) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "card":
        n = r.choice([16, 16, 16, 16, 16, 15, 13, 19])
        body = r.choice("3" if n == 15 else "456") + d(n - 2)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-", ".", "", " "])
        cuts = [4, 6, 5] if n == 15 else [4] * (n // 4) + ([n % 4] if n % 4 else [])
        parts, k = [], 0
        for c in cuts:
            parts.append(whole[k : k + c])
            k += c
        return sep.join(parts)
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    style = r.randrange(9)
    national = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(6)}"]
    if r.random() < 0.5:
        return national[style]
    return r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{r.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"+{r.randint(1, 99)}/{d(3)}/{d(6)}"])


def _spelled(r: random.Random) -> str:
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))
    at = r.choice([" at ", " (at) ", "(at)", " [at] ", "[at]", " {at} ", " @ ", " AT ", "[@]", " arroba "])
    dot = r.choice([" dot ", " [dot] ", "(dot)", " DOT ", ".", "[.]", " punto "]) if at.strip() not in ("at", "AT", "arroba") else r.choice([" dot ", " DOT ", "[dot]", " punto ", "."])
    local = r.choice([word(), f"{word()}.{word()}", f"{word()}{r.randint(1, 99)}", f"{word()}_{word()}"] + [f"{word()}{dot}{word()}"] * (dot != "."))
    if dot == "." and at.strip().lower() in ("at", "arroba"):
        local = r.choice([f"{word()}.{word()}", f"{word()}{r.randint(1, 99)}", f"{word()}_{word()}"])
    host = dot.join([word(), *([word()] if r.random() < 0.3 else []), r.choice(["com", "org", "de", "fr", "es", "net", "example", "io"])])
    return f"{local}{at}{host}"


def _other(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    bad = d(15)
    number = r.choice("456") + bad
    number = number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)
    four = " ".join(number[k : k + 4] for k in range(0, 16, 4))
    return r.choice([
        number, four, f"order {d(8)}", f"invoice {d(10)}", f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"version {r.randint(1, 20)}.{r.randint(0, 40)}.{d(3)}.{d(4)}", f"version 2.{d(2)}.{d(3)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}:{d(2)}", f"1{d(1)}.0{r.randint(1, 9)}.20{d(2)}",
        f"pages {d(3)}-{d(3)}, {d(3)}-{d(3)}", f"{d(3)} {d(3)} {d(3)} inhabitants", f"$ {d(3)}.{d(3)}.{d(3)}", f"20{d(2)} 20{d(2)} 20{d(2)} 20{d(2)}", f"ticket {d(12)}", f"serial {d(6)}-{d(6)}", f"{d(9)}", f"{d(12)}", f"{d(10)}", f"3{d(2)}.{d(3)}.{r.randint(300, 999)}.{d(2)}",
        "look at the house. then go", "meet at noon. dot the line", "arrive at example.com today", "he is at home.de now", "three @ 5.50 each", "x @ y.z", f"lot {d(4)}-{d(4)}-{d(4)}", f"{d(7)}", f"{d(2)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"ref {d(4)} {d(4)} {d(4)}", f"1.{d(6)}", f"{d(5)}-{d(5)}", f"token {d(9)}",
    ])


def example(r: random.Random) -> tuple[str, list[Span]]:
    """A sentence and what is personal in it."""
    words = "the of and we said morning über mañana où garden river letter window please note that here was".split()
    text, spans = "", []
    for _ in range(r.randint(1, 4)):
        text += " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
        text += " " if text and r.random() < 0.95 else ""
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            kind = r.choice(["card", "ip", "phone", "phone", "email", "other", "other", "other"])
            value = _other(r) if kind == "other" else _spelled(r) if kind == "email" else _number(r, kind)
            if kind != "other" and r.random() < 0.3:
                text += r.choice(CUES[kind].split()) + r.choice([" ", ": ", ". "])
            if kind != "other":
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice([" ", " ", " ", ", ", ". "])
    return text, spans


def _lattice(edges: list[int], options: list, held: dict[int, str], weights: dict[str, float], bonus: set | None = None) -> tuple[float, dict[str, float]]:
    """The logarithm of the sum over all segmentations (only those of ``bonus``, if given), and the expected count of each feature."""
    used = [c for c in options if bonus is None or (c[0], c[1], c[2]) in bonus]
    must = len(bonus) if bonus is not None else 0
    alpha: list[dict] = [{("", 0): 0.0}] + [{} for _ in edges[1:]]
    arcs: list[list] = [[] for _ in edges]
    add = lambda into, key, v: into.__setitem__(key, v if key not in into else max(into[key], v) + math.log1p(math.exp(-abs(into[key] - v))))
    by_end: dict[int, list] = {}
    for c in used:
        keys = _keys(c[2], c[3])
        by_end.setdefault(c[1], []).append((c[0], c[2], keys, sum(weights.get(k, 0.0) for k in keys)))
    for j in range(1, len(edges)):
        for (y, n), v in alpha[j - 1].items():
            new = (held.get(j, y), n)
            add(alpha[j], new, v)
            arcs[j].append((j - 1, (y, n), new, None, 0.0))
        for i, y, keys, score in by_end.get(j, ()):
            for (before, n), v in alpha[i].items():
                turn = f"{before}>{y}"
                new, gain = (y, n + (bonus is not None)), score + weights.get(turn, 0.0)
                add(alpha[j], new, v + gain)
                arcs[j].append((i, (before, n), new, [*keys, turn], gain))
    last = {k: v for k, v in alpha[-1].items() if k[1] == must}
    if not last:
        return -math.inf, {}
    top = max(last.values())
    total = top + math.log(sum(math.exp(v - top) for v in last.values()))
    beta: list[dict] = [{} for _ in edges]
    beta[-1] = dict.fromkeys(last, 0.0)
    counts: dict[str, float] = {}
    for j in range(len(edges) - 1, 0, -1):
        for i, old, new, keys, gain in arcs[j]:
            if new in beta[j]:
                add(beta[i], old, beta[j][new] + gain)
                if keys:
                    p = math.exp(alpha[i][old] + gain + beta[j][new] - total)
                    for k in keys:
                        counts[k] = counts.get(k, 0.0) + p
    return total, counts


@functools.cache
def fitted(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.35, decay: float = 2e-4) -> dict[str, float]:
    """Weights by adaptive gradient steps on the conditional likelihood of made sentences."""
    r, weights, seen, lattices = random.Random(seed), {}, {}, []
    for _ in range(examples):
        text, gold = example(r)
        base = base_spans(text)
        for region in regions(text):
            taken = [x for x in base if x[1] < region[1] and x[2] > region[0]]
            edges, options = candidates(text, region, taken)
            place = {x: k for k, x in enumerate(edges)}
            want = {(place[s], place[e], y) for y, s, e in gold if s in place and e in place}
            want &= {(i, j, y) for i, j, y, _ in options}
            if options:
                lattices.append((edges, options, _held(edges, taken), want))
    for _ in range(epochs):
        r.shuffle(lattices)
        for edges, options, held, want in lattices:
            expected = _lattice(edges, options, held, weights)[1]
            observed = _lattice(edges, options, held, weights, want)[1]
            for k in expected.keys() | observed.keys():
                g = observed.get(k, 0.0) - expected.get(k, 0.0) - decay * weights.get(k, 0.0)
                seen[k] = seen.get(k, 1e-8) + g * g
                weights[k] = weights.get(k, 0.0) + rate * g / math.sqrt(seen[k])
    return {k: round(v, 4) for k, v in weights.items() if abs(v) > 1e-3}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(weights: dict[str, float]):
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, every = all_spans(text.as_py(), weights)
                rows.append((i, *[sum(x[0] == k for x in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def find_personal_data(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Of every row of ``documents`` (``doc_id``, ``text``): how many spans the rules find of each kind (``n_email``, ``n_ip``, ``n_card``, ``n_phone``), their digest
    (``base_sha256``), and all ``spans`` with the model's (``kind:start:end`` in code points, end exclusive)."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(fitted() if weights is None else weights), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
