"""Elements of pages by selectors, all of them in one forward pass.

A selector is a chain of element tests with blanks between them: ``tag``, ``#id``, ``.class``, ``[attribute]``, ``[attribute=value]``, ``[attribute*=part]`` or several
of these together; each test holds for an element inside the one before. The tokens of a page move a state along every chain: how many tests the
open elements satisfy so far. An element that satisfies the last test is found; its text is what the tokens up to its own end
tag hold, so elements of the same name inside it do not end it.

Pages may be broken: an end tag closes the nearest open element of its name and what is open inside, one without a start is nothing, and what is open at the
end ends there. A list item, paragraph, option, row or cell ends the one before it. Scripts and styles have no text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TEST = re.compile(r"(?P<tag>[a-z][a-z0-9-]*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<how>\*?=)(?:'(?P<single>[^']*)'|\"(?P<double>[^\"]*)\"|(?P<bare>[^'\"\]\s]*)))?\]", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
#: Elements that end an open one of their own name, up to these.
_ENDS = {"li": ("ul", "ol"), "p": ("div", "section", "article", "main", "li", "td"), "option": ("select",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}

# What a content's text leaves out, and its blocks.
LEFT_OUT_TAGS = frozenset("script style noscript nav footer header form".split())
LEFT_OUT_CLASSES = frozenset(("cookie", "cookies", "navigation"))
BLOCKS = frozenset("p h1 h2 h3 h4 h5".split())


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    start: int
    end: int = -1


@dataclass(frozen=True)
class Test:
    tag: str
    needs: tuple[tuple[str, str, str], ...]

    def holds(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag and self.tag != tag:
            return False
        for name, how, value in self.needs:
            own = attributes.get(name)
            if own is None or how == "=" and own != value or how == "*=" and value not in own or how == "~=" and value not in own.split():
                return False
        return True


@cache
def compiled(selector: str) -> tuple[Test, ...]:
    chain = []
    for part in re.split(r"\s+(?![^\[]*\])", selector.strip()):
        tag, needs, at = "", [], 0
        while at < len(part):
            m = _TEST.match(part, at)
            if not m:
                raise ValueError(f"selector {selector!r} has an unknown test at {part[at:]!r}")
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
            elif m["id"]:
                needs.append(("id", "=", m["id"]))
            elif m["class"]:
                needs.append(("class", "~=", m["class"]))
            else:
                needs.append((m["name"].lower(), m["how"] or "", m["single"] or m["double"] or m["bare"] or ""))
        chain.append(Test(tag, tuple(needs)))
    return tuple(chain)


@dataclass
class Scan:
    """What one pass over a page found."""

    pieces: list[str] = field(default_factory=list)
    found: dict[str, list[Element]] = field(default_factory=dict)
    left_out: list[tuple[int, int]] = field(default_factory=list)

    def text(self, e: Element) -> str:
        """An element's text on one line."""
        return " ".join("".join(p for p in self.pieces[e.start : e.end] if p not in _BREAKS).split())

    def content(self, e: Element) -> str:
        """An element's text block by block, without navigation, forms, hidden and repeated parts."""
        out, at = [], e.start
        for s, t in self.left_out:
            if s > e.start and t <= e.end and s >= at:
                out += self.pieces[at:s]
                at = t
        flat = "".join(_BREAKS.get(p, p) for p in out + self.pieces[at : e.end])
        lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in flat.split("\n"))
        return "\n".join(x for x in lines if x)

    def lines(self) -> str:
        """The whole page's text as it is laid out, one line a block."""
        flat = "".join("\n" if p in _BREAKS else p for p in self.pieces)
        return "\n".join(x for x in (" ".join(y.split()) for y in flat.split("\n")) if x)

    def first_text(self, selectors: list[str]) -> str | None:
        return next((x for s in selectors for e in self.found.get(s, ())[:1] if (x := self.text(e))), None)

    def texts(self, selectors: list[str]) -> list[str]:
        every = [x for s in selectors for e in self.found.get(s, ()) if (x := self.text(e))]
        return list({x.casefold(): x for x in reversed(every)}.values())[::-1]

    def first_content(self, selectors: list[str], least: int) -> str:
        return next((x for s in selectors for e in self.found.get(s, ())[:1] if len(x := self.content(e)) >= least), "")


#: Marks between texts: the end of a line, the begin of a list item, the edge of an element that is laid out as a block.
_LINE, _ITEM, _ROW = "\0line", "\0item", "\0row"
_BREAKS = {_LINE: "\n", _ITEM: "\n• ", _ROW: ""}
_ROWS = frozenset("div section article main header footer aside nav form table tr td th dl dt dd ul ol title body".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def scan(page: str, selectors: list[str]) -> Scan:
    """All elements of a page that any of the selectors names."""
    chains = [(s, compiled(s)) for s in selectors]
    out = Scan(found={s: [] for s in selectors})
    # open elements: name, element, how far each chain has come inside it, and where it began to be left out
    stack: list[tuple[str, Element, tuple[int, ...], int]] = []
    open_: dict[str, int] = {}
    at, none = 0, (0,) * len(chains)

    def text(upto: int) -> None:
        if upto > at:
            out.pieces.append(html.unescape(page[at:upto]))

    def close(k: int) -> None:
        while len(stack) > k:
            tag, e, _, began = stack.pop()
            open_[tag] -= 1
            if tag in BLOCKS or tag == "li" or e.attributes.get("role") == "heading":
                out.pieces.append(_LINE)
            elif tag in _ROWS:
                out.pieces.append(_ROW)
            e.end = len(out.pieces)
            if began >= 0:
                out.left_out.append((began, e.end))

    raw = ""
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        tag = (m[2] or "").lower()
        if raw:  # nothing but its end tag ends a script
            if tag != raw or not m[1]:
                continue
            if raw not in ("script", "style"):
                text(m.start())
        else:
            text(m.start())
        at, raw = m.end(), ""
        if not tag:
            continue
        if m[1]:
            if open_.get(tag):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in _ENDS and open_.get(tag):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or stack[k][0] in _ENDS[tag]), -1)
            if k >= 0 and stack[k][0] == tag:
                close(k)
        attributes = _attributes(m[3]) if m[3] else {}
        began = -1
        if tag in LEFT_OUT_TAGS or attributes.get("aria-hidden") == "true" or not LEFT_OUT_CLASSES.isdisjoint(attributes.get("class", "").split()):
            began = len(out.pieces)
            out.pieces.append("")  # so that it begins behind the element that holds it
            began = len(out.pieces)
        e = Element(tag, attributes, len(out.pieces))
        if tag == "br":
            out.pieces.append(_LINE)
        elif tag == "li":
            out.pieces.append(_ITEM)
        elif tag in BLOCKS or attributes.get("role") == "heading":
            out.pieces.append(_LINE)
        elif tag in _ROWS:
            out.pieces.append(_ROW)
        before = stack[-1][2] if stack else none
        state = before
        for i, (name, chain) in enumerate(chains):
            p = before[i]
            if chain[-1].holds(tag, attributes) and p >= len(chain) - 1:
                out.found[name].append(e)
            if p < len(chain) - 1 and chain[p].holds(tag, attributes):
                state = (*state[:i], p + 1, *state[i + 1 :])
        if tag in _VOID:
            e.end = len(out.pieces)
            continue
        stack.append((tag, e, state, began))
        open_[tag] = open_.get(tag, 0) + 1
        raw = tag if tag in _RAW else ""
    if not (raw in ("script", "style")):
        text(len(page))
    close(0)
    out.left_out.sort()
    return out
