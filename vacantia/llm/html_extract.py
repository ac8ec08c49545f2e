"""Main text of web pages by minimum cut.

A page is read once from front to back into elements and blocks (text between block-level tags). The graph of the cut has a
node for each block; tags, roles and names of the elements round it mark it as the article's or as boilerplate.

* Terminal capacities: a block's are the log-odds that a linear classifier gives its text (share of links, words, sentence end,
  kind of tag, notice of rights), at most ``MOST`` either way, and those of the marked elements round it: ``ARTICLE`` for an article, less ``STRONG`` or
  ``SOFT`` for the worst sign of boilerplate, and only ``WEAK`` for a name inside an article that might as well be its subject. An element that holds
  most of the text cannot well be boilerplate, so its cost shrinks with the fourth power of its share (not where the tag itself says what it is).
* Smoothness edges: adjacency between blocks in page order, and DOM proximity between blocks whose elements are siblings or cousins.

All are costs of one size, and none is a tie: text outweighs a weak name, a strong name outweighs text, and neighbours decide where these are close.

The cut of least cost comes from a maximum flow on every page; blocks on the side of the content are joined in page order.

The classifier starts from ``PRIOR``; its weights of the text (not of tags, which go along with marks) are fitted to blocks of
a sample of pages whose marks tell their label: the ``SAMPLE_PAGES`` pages of least hash, at most ``SAMPLE_BLOCKS`` blocks of
each, weighing as ``SAMPLE_WEIGHT`` blocks together.

Names. Of a class or id like ``content-sidebar-wrap`` the last word that is not generic counts; ``has-comments``, ``no-ads`` or
``wp-share-enabled`` say nothing of the element itself. An article's own header is part of it; a page's header goes, with a heading in it.

Cases: a null or empty html gives an empty text. Malformed markup (missing end tags, stray ``<``, unclosed quotes, comments or
scripts) is read as far as it goes; a tag that never ends is text. Very long pages are read whole, in linear time. Rows are
extracted one by one, so repeated rows, ties and null ids need no rule; copies count once in the sample. Input
columns named as a result are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("main_text",)
#: Bounds of the sample that the classifier is fitted to, and how many blocks it weighs as.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_WEIGHT = 400, 50, 200
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TELLING = re.compile(r"(?i)class|\bid\b|role|itemprop|hidden|style")
#: Elements of which nothing is text, and those of them whose content is not markup.
SILENT = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "option", "canvas", "audio", "video", "button", "datalist"}
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Open elements that a start tag ends; others end a paragraph.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_PARAGRAPH = {"p"}
HEADINGS, PARAGRAPHS, ITEMS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre"}, {"li", "dt", "dd", "td", "th"}
#: Tags and roles that mark an element. ``SOFT`` marks give way where the element holds the article.
ARTICLE_TAGS, HARD_TAGS, SOFT_TAGS = {"article", "main"}, {"nav", "footer", "aside", "menu"}, {"form", "dialog", "fieldset", "header"}
HARD_ROLES, SOFT_ROLES = {"navigation", "contentinfo", "complementary"}, {"banner", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
ARTICLE_NAMES = {"article", "articlebody", "articles", "content", "entry", "main", "post", "story", "maincontent", "bodytext"}
COMMENT_NAMES = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "responses"}
BOILERPLATE_NAMES = COMMENT_NAMES | {
    "ad", "ads", "adbox", "adsense", "adslot", "adunit", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "dropdown", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "outbrain", "overlay", "pager", "pagination",
    "paywall", "popup", "promo", "promotion", "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar",
    "topbar", "trending", "widget", "widgets",
}
#: These words tell wherever they stand in a name; those of ``STATES`` make a name say nothing of its element.
TELLING_NAMES = {"cookie", "cookies", "gdpr", "advert", "adverts", "advertisement", "sponsored", "related", "recommended", "newsletter", "disqus", "taboola", "outbrain", "paywall"}
#: Names that are strong signs inside an article too.
STRONG_NAMES = COMMENT_NAMES | {
    "ad", "ads", "adbox", "adsense", "adslot", "adunit", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disqus", "gdpr", "modal", "nav", "navbar", "newsletter", "outbrain", "pager", "pagination",
    "paywall", "popup", "share", "sharing", "sidebar", "signup", "social", "sponsored", "subscribe", "subscription", "taboola",
}
STATES = {"has", "with", "no", "without", "is", "not", "js", "enabled", "disabled", "hide", "show", "supports", "wp"}
GENERIC = {"wrap", "wrapper", "container", "inner", "outer", "area", "box", "block", "section", "list", "item", "items", "row", "col", "left", "right", "top", "bottom", "text", "body", "content", "links", "buttons", "button", "bar", "unit", "slot", "panel", "zone", "region", "site", "page", "global", "primary", "secondary", "desktop", "mobile", "v", "x"}
_SMALL_END = re.compile(r"(?:footer|sidebar|navbar|menu|advert|adverts|comments|newsletter|cookies)$")
#: A notice of rights.
_RIGHTS = re.compile(r"(?i)^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b")
_STOPS = tuple(".!?:\"'”»…。！？")
#: Weights of a block's features before the fit (one, share of links, log of words, sentence end, rights, heading, paragraph, item), and how many are fitted.
PRIOR, FITTED = (-0.4, -4.0, 0.6, 1.0, -4.0, 0.6, 0.9, -0.6), 5
MOST, NEXT_EDGE, SIBLING_EDGE, COUSIN_EDGE = 3.0, 0.4, 0.4, 0.2
ARTICLE, STRONG, SOFT, WEAK = 3.0, 8.0, 4.5, 1.5


@lru_cache(8192)
def _named(names: str) -> tuple[bool, bool, bool]:
    """Whether a class or id (as written) names an article, boilerplate, and that strongly."""
    good = bad = strong = False
    for name in names.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not words or STATES & set(words):
            continue
        plain = [w for w in words if w not in GENERIC]
        head = plain[-1] if plain else words[-1]
        small = _SMALL_END.search(head)
        kind = small[0] if small else head
        if TELLING_NAMES & set(words) or kind in BOILERPLATE_NAMES:
            if not (kind == "header" and ARTICLE_NAMES & set(words)):  # an entry's own header
                bad = True
                strong = strong or kind in STRONG_NAMES or bool(STRONG_NAMES & TELLING_NAMES & set(words))
        elif kind in ARTICLE_NAMES:
            good = True
    return good, bad, strong


def _mark(tag: str, attributes: str, inside: bool) -> tuple[float, float, bool]:
    """What an element's tag, roles and names say for the article, what against it, and whether its tag alone says that. inside: it is in an article."""
    good, bad, named = tag in ARTICLE_TAGS, STRONG if tag in HARD_TAGS or tag in ("form", "dialog") else SOFT if tag in SOFT_TAGS and not (inside and tag == "header") else 0.0, 0.0
    if attributes and tag not in ("html", "body") and _TELLING.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                article, boilerplate, strong = _named(value)
                good = good or article and not strong
                if boilerplate and (strong or not article):
                    named = max(named, STRONG if strong else SOFT)
            elif name == "itemprop" and value.lower() == "articlebody":
                good = True
            elif name == "role":
                value = value.lower()
                good, bad = good or value in ("main", "article"), max(bad, STRONG if value in HARD_ROLES else SOFT if value in SOFT_ROLES else 0.0)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none", value):
                bad = STRONG
    if tag in ARTICLE_TAGS:
        named = named if named == STRONG else 0.0
    elif inside and named == SOFT:
        named = WEAK
    return float(good) * ARTICLE, max(bad, named), tag in HARD_TAGS


class Page:
    """Elements (tag, parent, what marks them) and blocks (element, text parts, linked code points) of a page."""

    def __init__(self, page: str):
        self.tag, self.parent, self.good, self.bad, self.firm = [""], [0], [0.0], [0.0], [False]
        self.at: list[int] = []
        self.parts: list[list[str]] = []
        self.linked: list[int] = []
        self._read(page)

    def _read(self, page: str) -> None:
        open_, count = [0], Counter()  # block-level elements that are open, and how many of each tag
        link, silent, inside, new = 0, 0, 0, True  # link: depth at which a link was opened
        pos, size, at, parts, linked = 0, len(page), self.at, self.parts, self.linked

        def text(raw: str) -> None:
            nonlocal new
            if silent or not raw:
                return
            if "&" in raw:
                raw = entities.unescape(raw)
            if new:
                if raw.isspace():
                    return
                at.append(open_[-1])
                parts.append([])
                linked.append(0)
                new = False
            parts[-1].append(raw)
            if link:
                linked[-1] += len(raw)

        def close() -> None:
            nonlocal link, silent, inside, new
            e = open_.pop()
            tag = self.tag[e]
            count[tag] -= 1
            if tag in SILENT:
                silent -= 1
            else:
                new = True
            inside -= tag in ARTICLE_TAGS
            link = 0 if link > len(open_) else link

        while pos < size:
            begin = page.find("<", pos)
            if begin < 0:
                break
            if begin > pos:
                text(page[pos:begin])
            sign = page[begin + 1 : begin + 2]
            if sign in ("!", "?") and sign:
                if page.startswith("<!--", begin):
                    end = page.find("-->", begin + 4)
                    pos = end + 3 if end >= 0 else size
                elif page.startswith("<![CDATA[", begin):
                    end = page.find("]]>", begin)
                    text(page[begin + 9 : end if end >= 0 else size])
                    pos = end + 3 if end >= 0 else size
                else:
                    end = page.find(">", begin)
                    pos = end + 1 if end >= 0 else size
                continue
            m = _NAME.match(page, begin + 1)
            if not m:
                text("<")
                pos = begin + 1
                continue
            end = _tag_end(page, m.end())
            if end < 0:
                text(page[begin:])
                pos = size
                break
            attributes, pos = page[m.end() : end], end + 1
            tag = m[0].lower()
            if tag[0] == "/":
                tag = tag[1:]
                if tag == "a":
                    link = 0
                elif tag not in INLINE and count[tag] > 0:
                    while self.tag[open_[-1]] != tag:
                        close()
                    close()
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in VOID:
                new = new or tag == "hr"
                continue
            if tag == "a":
                link = len(open_)
                continue
            if tag in INLINE:
                continue
            if tag in RAW:
                end = RAW[tag].search(page, pos)
                close_at = page.find(">", end.end()) if end else -1
                pos = close_at + 1 if close_at >= 0 else size
                continue
            if attributes.endswith("/") and tag in SILENT:
                continue
            if tag not in SILENT:
                closes = _CLOSES.get(tag, _PARAGRAPH)
                while self.tag[open_[-1]] in closes:
                    close()
                new = True
            good, bad, firm = _mark(tag, attributes, inside > 0)
            self.parent.append(open_[-1])
            open_.append(len(self.tag))
            self.tag.append(tag)
            self.good.append(good)
            self.bad.append(bad)
            self.firm.append(firm)
            count[tag] += 1
            silent += tag in SILENT
            inside += tag in ARTICLE_TAGS
        else:
            return
        if pos < size:
            text(page[pos:])

    def texts(self) -> list[str]:
        """The text of each block; blocks without any are dropped."""
        out, keep = [], []
        for k, p in enumerate(self.parts):
            plain = " ".join("".join(p).split())
            if plain:
                out.append(plain)
                keep.append(k)
        self.shares = [self.linked[k] / max(1, sum(map(len, self.parts[k]))) for k in keep]
        self.at = [self.at[k] for k in keep]
        return out

    def costs(self, texts: list[str]) -> list[float]:
        """For each element what the marks round it (and its own) say, positive for the article."""
        n, parent = len(self.tag), self.parent
        if not any(self.good) and not any(self.bad):
            return [0.0] * n
        plus, bad = [False] * n, [False] * n
        for e in range(1, n):
            p = parent[e]
            bad[e] = bad[p] or self.bad[e] > WEAK
            plus[e] = plus[p] or self.good[e] > 0
        total = [0] * n
        # shares are of the article's text; of all text where no article is marked outside boilerplate
        marked = any(plus[e] and not bad[e] for e in self.at)
        for e, t in zip(self.at, texts, strict=True):
            total[e] += len(t) * (plus[e] or not marked)
        for e in range(n - 1, 0, -1):
            total[parent[e]] += total[e]
        out, worst = [0.0] * n, [0.0] * n
        for e in range(1, n):
            worst[e] = worst[parent[e]]
            if self.bad[e]:
                worst[e] = max(worst[e], self.bad[e] * (1 if self.firm[e] else 1 - (total[e] / max(1, total[0])) ** 4))
            out[e] = ARTICLE * plus[e] - worst[e]
        return out

    def features(self, k: int, text: str) -> tuple[float, ...]:
        tag = self.tag[self.at[k]]
        words = text.count(" ") + 1
        return 1.0, self.shares[k], min(6.0, math.log2(1 + words)), float(text.endswith(_STOPS)), float(bool(_RIGHTS.search(text))), float(tag in HEADINGS), float(tag in PARAGRAPHS), float(tag in ITEMS)


def _tag_end(page: str, at: int) -> int:
    """Where the ``>`` of a tag is, -1 if nowhere. Quotes count after ``=``; one that never closes is an ordinary sign."""
    pos = at
    while m := _END.search(page, pos):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        pos = close + 1 if close >= 0 else m.end()
    return page.find(">", at)


def graph_of(page: Page, texts: list[str], weights: tuple[float, ...]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities of the blocks (positive: content), and edges between them."""
    costs, parent = page.costs(texts), page.parent
    scores = [max(-MOST, min(MOST, sum(w * x for w, x in zip(weights, page.features(k, t), strict=True)))) + costs[page.at[k]] for k, t in enumerate(texts)]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, e in enumerate(page.at):
        up = parent[e]
        if k:
            edges[k - 1, k] = NEXT_EDGE + (COUSIN_EDGE if parent[up] == parent[parent[page.at[k - 1]]] else 0.0)
        if up in last:
            edges[last[up], k] = edges.get((last[up], k), 0.0) + SIBLING_EDGE
        last[up] = k
    return scores, edges


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of least cost: a positive score is the cost of False, a negative one of True; an edge
    costs its weight if its ends differ. A maximum flow by levels (shortest augmenting paths) finds them."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(i: int, j: int, there: float, back: float) -> None:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to.extend((j, i))
        room.extend((there, back))

    for i, c in enumerate(scores):
        arc(source, i, c, 0.0) if c > 0 else arc(i, sink, -c, 0.0)
    for (i, j), w in edges.items():
        arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], todo = 0, deque([source])
        while todo:
            i = todo.popleft()
            for e in out[i]:
                if level[to[e]] < 0 and room[e] > 1e-9:
                    level[to[e]] = level[i] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried, path, i = [0] * (n + 2), [], source
        while True:
            if i == sink:
                least = min(room[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9:
                        cut = min(cut, k)
                i = to[path[cut] ^ 1]
                del path[cut:]
            elif tried[i] < len(out[i]):
                e = out[i][tried[i]]
                if room[e] > 1e-9 and level[to[e]] == level[i] + 1:
                    path.append(e)
                    i = to[e]
                else:
                    tried[i] += 1
            elif not path:
                break
            else:
                i = to[path.pop() ^ 1]
                tried[i] += 1


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The content blocks of a page, joined by empty lines."""
    read = Page(page or "")
    texts = read.texts()
    keep = minimum_cut(*graph_of(read, texts, weights)) if texts else []
    return "\n\n".join(t for t, k in zip(texts, keep, strict=False) if k)


def fitted(rows: list[tuple[tuple[float, ...], bool]]) -> tuple[float, ...]:
    """The weights of greatest posterior for labelled blocks: a logistic model, normal round ``PRIOR``, by Newton's method with steps that are halved until they help."""
    if not rows:
        return PRIOR
    x, y = np.array([f for f, _ in rows]), np.array([label for _, label in rows], float)
    prior, fixed = np.array(PRIOR[:FITTED]), x[:, FITTED:] @ np.array(PRIOR[FITTED:])
    x, share, w = x[:, :FITTED], SAMPLE_WEIGHT / len(rows), prior.copy()
    sign = 2 * y - 1
    loss = lambda w: share * np.logaddexp(0, -sign * (x @ w + fixed)).sum() + 0.5 * ((w - prior) ** 2).sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        step = np.linalg.solve(share * (x.T * (p * (1 - p))) @ x + np.eye(FITTED), share * (x.T @ (y - p)) + prior - w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (*w.tolist(), *PRIOR[FITTED:])


def labelled(page: str | None, most: int = SAMPLE_BLOCKS) -> list[tuple[tuple[float, ...], bool]]:
    """Features and label of blocks of a page that marks decide, at most so many, spread over the page."""
    read = Page(page or "")
    texts = read.texts()
    costs = read.costs(texts)
    told = [k for k, e in enumerate(read.at) if costs[e]]
    return [(read.features(k, texts[k]), costs[read.at[k]] > 0) for k in told[:: -(-len(told) // most) or 1]]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [labelled(x) for x in b.column(1).to_pylist()]
        flat = [[v for f, label in r for v in (*f, float(label))] for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.list_(pa.float64()))], ["h", "x"])


def classifier(pages: DataFrame, n_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights fitted to the sample of ``pages``."""
    hashed = pages.select(F.xxhash64("html").alias("h"), F.col("html").cast("string").alias("html")).filter("html is not null")
    last = hashed.select("h").distinct().orderBy("h").limit(n_pages).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR
    rows = hashed.filter(F.col("h") <= last).mapInArrow(_sampled, "h bigint, x array<double>").groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect()
    size = len(PRIOR) + 1
    return fitted([(tuple(r.x[k : k + size - 1]), r.x[k + size - 1] > 0) for r in rows for k in range(0, len(r.x), size)])


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``main_text``; ``weights`` are the classifier's, fitted to ``pages`` if not given."""
    used = weights or classifier(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([main_text(x, used) for x in b.column(1).to_pylist()], pa.string())], ["r", *RESULTS])

    own = [c for c in pages.columns if c not in ("html", *RESULTS)]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    rows = pages.select(rest.alias("r"), F.col("html").cast("string").alias("x"))
    out = rows.mapInArrow(run, f"r {rows.schema['r'].dataType.simpleString()}, main_text string")
    return out.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(own)], *RESULTS)
