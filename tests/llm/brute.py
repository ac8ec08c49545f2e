"""Plain versions of the operators' contracts, for small tables of (id, text) rows."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, chars=40, docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders[key(x)]) < docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    twice = [False] * len(words)
    for k in range(len(words) - 4):
        if grams[tuple(words[k : k + 5])] > 1:
            twice[k : k + 5] = [True] * 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = sum(twice)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(words) < 10 or 100 * n > 20 * len(words)


PHRASES = """lorem ipsum;all rights reserved;terms of use;terms of service;privacy policy;cookie policy;cookie settings;enable javascript;click here to;sign up for our;subscribe to our;skip to content;skip to main content;
leave a comment;leave a reply;alle rechte vorbehalten;nutzungsbedingungen;datenschutzerklärung;datenschutzbestimmungen;zum inhalt springen;tous droits réservés;mentions légales;politique de confidentialité;todos los derechos reservados;
aviso legal;política de privacidad"""


def line_fails(line):
    """Plain reading of the line rules for a stripped line, over code points."""
    size, words = len(line.encode()), line.count(" ") + 1
    marks = "|>·•›" + ("" if "«" in line else "»")
    for c in marks:
        line_ = line.replace(c, "\0") if c == marks[0] else line_.replace(c, "\0")
    parts = [p for p in line_.split("\0") if p.strip(" \t\r\x0b\x0c")]
    if len(parts) > 1 and len(parts) >= 4 and words <= 3 * len(parts):
        return True
    if sum(c in "#*$%&|<>" for c in line) > 0.08 * size:
        return True
    marked = sum(len(w := x.rstrip(".,")) > 1 and all(c in "!?*#$%&|<>=~^" for c in w[-2:]) for x in re.split("[ \t]+", line))
    if any(x in line for x in ("!!", "??", "==", "~~")) and marked > 0.3 * words:
        return True
    if words <= 25 and any(p.strip() in line.lower() for p in PHRASES.split(";")):
        return True
    each = WORD.findall(line)
    return words >= 10 and sum(a == b for a, b in zip(each, each[1:])) > 0.3 * len(each)


def quality_kept(text):
    text = text or ""
    lost = sum(len("".join(WORD.findall(x))) for x in text.split("\n") if WORD.search(x) and line_fails(x.strip(" \t\n\x0b\x0c\r")))
    base = quality_base(text)
    return not base[5] and lost <= 0.5 * base[1]


def contamination(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w = TERM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return out


def substring_dedup(rows, size=13):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(prints, distance=3):
    """{(id, fingerprint)} -> {fingerprint: smallest id of its component}, of rows with an id."""
    known = sorted({p for _, p in prints})
    root = {p: p for p in known}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in known:
        for b in known:
            if a < b and (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {p: least.get(find(p)) for p in known}


def licenses(rows, templates, share=0.8, size=5):
    """Every template at every offset of every text, by sets of shingles: {(id, license, share, first, last, alternatives)}."""
    def grams(text):
        w = TERM.findall((text or "").translate(LOWER))
        return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []

    def placed(g, t, length):
        """Disjoint runs, the fullest first: as long as the template, then of the class's size."""
        block = 1
        while block < 1.25 * length:
            block *= 2
        g, out, known = list(g), [], -1
        while len(out) > known:
            known = len(out)
            for width in (length, block + 1):
                full = [(-len(t & set(g[k : k + width])), k) for k in range(len(g)) if g[k] in t]
                taken = []
                for n, k in sorted(full):
                    if -n >= share * len(t) - 1e-9 and all(abs(k - b) >= width for b in taken):
                        taken.append(k)
                        last = max(q for q in range(k, min(k + width, len(g))) if g[q] in t and g[q] not in g[k:q])
                        out.append((-n, k, last))
                for _, k, last in out[known:]:
                    g[k : last + 1] = [None] * (last + 1 - k)
        return out

    result = []
    for i, text in rows:
        g, found = grams(text), []
        for name, template in templates.items():
            t = grams(template)
            for n, first, last in placed(g, set(t), len(t)) if t else ():
                found.append((-n, -n / len(set(t)), first, name, last))
        kept, owner = [], {}
        for _, x, first, name, last in sorted(found):
            held = [owner[q] for q in range(first, last + 1) if q in owner]
            if 2 * len(held) >= last + 1 - first:
                kept[max(set(held), key=held.count)][-1].add(name)
            else:
                owner.update({q: len(kept) for q in range(first, last + 1) if q not in owner})
                kept.append((i, name, -x, first, min(last + size, len(TERM.findall((text or "").translate(LOWER)))) - 1, set()))
        result += kept
    return result
