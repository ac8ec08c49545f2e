"""HTML extraction, WARC archives and chat formatting."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vacantia.llm import chat_format, html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href="/b>c">News</a></li></ul></nav><!-- <p>no --><div class="ad">Buy this. It is very good and cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First   <i>words</i> here&#233;.<br><p>Short.<ul><li>one<li>two, <a href=x>linked</a></ul><form><input name=q>Send</form><div class="share-box">Share</div></article>
<aside>Side text, rather long, with a sentence in it.</aside><section id="comments"><p>Nice article, I liked it very much.</p></section><footer>&copy; site</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst words hereé.\n\nShort.\n\none\n\ntwo, linked"
    for odd in (None, "", "<", "<!-- open", "<script>open", "<p", "</p></p>", "<nav>only</nav>"):
        assert html_extract.main_text(odd) == ("<" if odd == "<" else "<p" if odd == "<p" else "")
    assert html_extract.main_text("<div>" * 2000 + "Deep text with a full sentence." + "</div>" * 2000) == "Deep text with a full sentence."
    assert len(html_extract.main_text("<article>" + "<p>Some words.</p>" * 20000).split("\n\n")) == 20000


VARIANTS = {
    '<body><div id="cookie-banner"><p>We use cookies to improve this site, do accept them all.</p></div><main><article><header class="entry-header"><h1>Head</h1></header><div class="entry-content"><p>First part of it.</p><div class="inline-ad">Buy now, it is cheap.</div><p>Second part, a bit longer than the first.</p></div></article><section class="comments-area"><article class="comment"><p>I have read all of this with great interest and I would like to add that it is a very good text, although it could be a little longer and say more about that.</p></article></section></main></body>': "Head\n\nFirst part of it.\n\nSecond part, a bit longer than the first.",
    '<div class="site-header"><a href=/>Site</a></div><ul class="topmenu"><li><a href=/a>A</a><li><a href=/b>B</a></ul><div class="story"><h1>Head</h1>Loose text in a div.<br>More of it.<table><tr><td>cell one</td><td>cell two</td></tr></table></div><div class="leftSidebar">Side words here.</div><div>© 2024 The site</div>': "Head\n\nLoose text in a div. More of it.\n\ncell one\n\ncell two",
    "<article><h1>A &lt;b&gt; C</h1><p>x&nbsp;&nbsp;y &#8212; z<p hidden>no</p><noscript>no</noscript><p>All rights reserved, he said.</p><aside>no</aside><pre>a\n  b</pre></article>": "A <b> C\n\nx y — z\n\nAll rights reserved, he said.\n\na b",
}


@pytest.mark.parametrize("page", VARIANTS)
def test_page_variants(page):
    assert html_extract.main_text(page) == VARIANTS[page]


BODY = "<p>First part of the text, long enough to be one.</p><p>Short</p><p>Another part of it, which goes on for a while.</p>"
WRAPPERS = [
    '<article class="post has-comments">%s</article>', '<div id="main-content" class="with-sidebar">%s</div>', '<div class="content no-ads">%s</div>', '<article class="post social-science">%s</article>', '<div class="form-article">%s</div>',
    '<div class="wp-share-enabled">%s</div>', '<form id="aspnetForm"><nav><a href=x>Home</a></nav>%s<div class=footer>foot</div></form>', '<div class="content-sidebar-wrap"><main><article>%s</article></main><aside>Side words, and more of them.</aside></div>',
    '<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul><div class="page">%s</div><div>© 2024 All rights reserved</div>', '<header><h1>Site</h1></header><div id="sidebar-wrapper">%s</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_do_not_condemn_the_article(wrapper):
    assert html_extract.main_text(wrapper % BODY) == "First part of the text, long enough to be one.\n\nShort\n\nAnother part of it, which goes on for a while."


def test_boilerplate_names():
    for name in ("sidebar", "leftSidebar", "topmenu", "cookie-banner", "related-posts", "share-box", "post-navigation", "comment-body", "ad-text", "newsletter-signup", "social", "site-footer"):
        assert html_extract._named(name)[:2] == (False, True), name
    for name in ("has-comments", "no-sidebar", "social-science", "entry-header", "wp-share-enabled", "page", "x1", ""):
        assert not html_extract._named(name)[1], name


LONG = {
    "<a ": 20000, "<div>": 20000, "<ul><li>": 6000, '<a x="': 20000, '<a x=">': 50000, "<p>Some words here now.</p><p>x</p>": 15000, "<b>": 50000, "<": 200_000, "<div class=sidebar>": 20000, "&": 200_000, "<!--": 50_000,
    "<article><p>a.</p>": 20000, "</x>": 50000, "= ": 100_000,
}


@pytest.mark.parametrize("piece", LONG)
def test_long_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    html_extract.main_text("<div>text" + piece * LONG[piece] + "</div></p></x>" * 5000)
    assert time.process_time() - began < 3


def real_pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()


def plain_article(page):
    """The paragraphs of the only article of a simple page, by string search alone."""
    import html
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_query_against_plain_reading(spark):
    from vacantia.llm import queries

    want = Counter((r["page_id"], r["url"], plain_article(r["html"]), len(plain_article(r["html"]))) for r in real_pages())
    assert Counter(map(tuple, queries.op4_html_extract(spark, "/root/testdata/sf0.001").collect())) == want


def labels(page, weights, edges=True):
    read = html_extract.Page(page)
    texts = read.texts()
    scores, graph = html_extract.graph_of(read, texts, weights)
    if not edges:  # the texts' own costs, without marks and neighbours
        costs = read.costs(texts)
        scores = [s - costs[e] for s, e in zip(scores, read.at, strict=True)]
    cut = html_extract.minimum_cut(scores, graph if edges else {})
    return dict(zip(texts, cut, strict=False))


def test_edges_change_labels_and_rightly():
    pages = [r["html"] for r in real_pages()]
    weights = html_extract.fitted([x for p in pages for x in html_extract.labelled(p)])
    changed = 0
    right = {True: 0, False: 0}
    n = 0
    for p in pages:
        truth = set(plain_article(p).split("\n\n"))
        alone, cut = labels(p, weights, False), labels(p, weights)
        changed += sum(alone[t] != cut[t] for t in cut)
        assert all(cut[t] == (t in truth) for t in cut)
        bare = p.replace("article>", "div>").replace("nav>", "div>").replace("footer>", "div>").replace(' class="ad"', "")  # no marks: text and neighbours only
        for edges in (True, False):
            found = labels(bare, weights, edges)
            right[edges] += sum(v == (t in truth) for t, v in found.items())
        n += len(found)
    assert changed >= len(pages) / 2
    assert right[True] >= right[False] and right[True] / n > 0.85  # what stays is an advert that reads like prose


def hard_page(r):
    """A page whose marks are missing or wrong: links and short lines inside the article, prose inside a menu. -> (page, texts of the article)."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    truth = []

    def block(kind, own):
        text = f"{say(r.randint(12, 40))}." if kind == "prose" else say(r.randint(1, 4)) if kind == "short" else f"{say(r.randint(1, 2))} {say(r.randint(2, 4))}"
        if own:
            truth.append(text)
        return f"<p>{text}</p>" if kind != "link" else f"<p><a href=/x>{text}</a></p>"

    article = "".join(block(r.choices(["prose", "short", "link"], [8, 3, 2])[0], True) for _ in range(r.randint(6, 14)))
    menu = lambda: "<div>" + "".join(block(r.choices(["link", "short", "prose"], [9, 2, 1])[0], False) for _ in range(r.randint(6, 12))) + "</div>"
    name = r.choice(["", "", ' class="recipe-menu"', ' class="box"', ' id="x1"'])
    return f"<html><body>{menu()}<div{name}>{article}</div>{menu()}</body></html>", set(truth)


def test_edges_beat_no_edges_on_hard_pages():
    r = random.Random(21)
    pages = [hard_page(r) for _ in range(300)]
    right, changed, against_marks, n = {True: 0, False: 0}, 0, 0, 0
    for page, truth in pages:
        read = html_extract.Page(page)
        texts = read.texts()
        costs, (scores, edges) = read.costs(texts), html_extract.graph_of(read, texts, html_extract.PRIOR)
        cut, alone = (dict(zip(texts, html_extract.minimum_cut(scores, x), strict=True)) for x in (edges, {}))
        right[True] += sum(v == (t in truth) for t, v in cut.items())
        right[False] += sum(v == (t in truth) for t, v in alone.items())
        changed += sum(cut[t] != alone[t] for t in cut)
        against_marks += sum(costs[e] < 0 and cut[t] for e, t in zip(read.at, texts, strict=True))
        n += len(cut)
    assert changed > 0.05 * n and right[True] > right[False] + 0.03 * n and right[True] / n > 0.75
    assert against_marks > 0  # text and neighbours outvote a wrong name


def test_names_inside_an_article_and_round_it_do_not_lose_its_text():
    prose = [f"Paragraph {k} of the story goes on for a while, as stories do." for k in range(4)]
    inner = "".join(f"<p>{t}</p>" for t in prose)
    ad = '<div class="ad"><p>Buy this great product today, you will surely like it.</p></div>'
    for name in ("recipe-menu", "related-work", "search-results", "widget"):
        page = f'<nav><a href=/>Home</a></nav><article>{inner}<div class="{name}">{inner.replace("Paragraph", "Part")}</div>{ad}</article>'
        assert html_extract.main_text(page) == "\n\n".join(prose + [t.replace("Paragraph", "Part") for t in prose]), name
    assert html_extract.main_text(f'<div class="topic-comments">{inner}</div>') == "\n\n".join(prose)
    assert html_extract.main_text(f'<article>{inner}</article><div class="comments">{inner.replace("Paragraph", "Comment")}</div>') == "\n\n".join(prose)
    assert html_extract.main_text(f'<form id="aspnet">{inner}</form>') == "\n\n".join(prose)
    assert html_extract.main_text(f"<article>{inner}<p><a href=/more>Read the second part of the story</a></p>{inner.replace('Paragraph', 'Part')}</article>").count("\n\n") == 8


def test_neighbours_decide_without_marks():
    long = "<p>A paragraph of some length, as articles have them.</p>"
    half = "<p>See <a href=x>that</a></p>"
    assert "See that" in html_extract.main_text(f"<div>{long * 3}{half}{long * 3}</div>")
    assert html_extract.main_text(f"<div>{half}</div>") == ""
    menu = "<li><a href=/a>Home</a></li>"
    assert html_extract.main_text(f"<ul>{menu * 4}<li>Now</li>{menu * 4}</ul>") == ""


def test_classifier_keeps_to_its_prior_without_rows(spark):
    assert html_extract.fitted([]) == html_extract.PRIOR
    none = spark.createDataFrame([], "html string")
    assert html_extract.classifier(none) == html_extract.PRIOR
    pages = spark.createDataFrame([(PAGE,)] * 50 + [(None,)], "html string").repartition(3)
    assert html_extract.classifier(pages) == html_extract.fitted(html_extract.labelled(PAGE))  # copies count once


def test_minimum_cut_is_least():
    for seed in range(200):
        r = random.Random(seed)
        n = r.randint(1, 8)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}

        def cost(label):
            own = sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, label, strict=True))
            return own + sum(w for (i, j), w in edges.items() if bool(label[i]) != bool(label[j]))

        assert cost(html_extract.minimum_cut(scores, edges)) == pytest.approx(min(cost([b >> k & 1 for k in range(n)]) for b in range(1 << n)))


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id bigint, url string, html string, main_text string")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "main_text"]
    assert Counter(r.main_text[:5] for r in out.collect()) == {"Title": 2, "": 1}
    assert html_extract.extract(pages.limit(0)).count() == 0


def plain_warc(rows, least=1000):
    owner = {}
    for i, _, h in rows:
        if i is not None:
            owner[h or ""] = max(i, owner.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        o = owner.get(h or "")
        revisit = len(raw) >= least and o is not None and o != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", o if revisit else None))
    return out


def test_warc(spark):
    big, other = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "", ""), (5, "u", other), (6, "u", other), (6, "u", other), (7, "u", "small"), (8, "u", "small"), (None, "n", big), (None, "n", "alone" * 300), (None, "n", "alone" * 300), (9, "u", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha256", F.lit("mine")).repartition(3)
    out = warc.archived(df)
    assert Counter(map(tuple, out.drop("url").collect())) == Counter(plain_warc(rows))
    assert out.filter("page_id = 2").first().url == "http://b%0D%0AX: y"
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_stores_payloads_once(spark, tmp_path):
    rows = [(k, "u", "same text " * 200) for k in range(20)] + [(30, "u", "tiny"), (31, "u", "tiny")]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "a"))
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    record = next(r.record for r in warc.records_of(spark, path).collect() if b"<urn:x-page:3>" in bytes(r.record)[:200])
    fields, block = warc.parse(bytes(record))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:x-page:19>" and block.endswith(b"\r\n\r\n")


CHATS = [
    (1, 0, "system", "be </s> kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "<⁣s> ok <s>"), (1, 3, "user", None), (1, 4, "assistant", "é" * 50),
    (2, 1, "assistant", ""), (2, 0, "tool<|text|>", "odd\nrole"), (3, 0, None, "null role"), (3, 0, None, "null role"), (None, 0, "user", "nobody"), (4, None, "user", "no turn"), (4, 0, "assistant", "</s>" * 9),
]


def plain_chats(rows):
    out = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = len(turns), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


@pytest.mark.parametrize("chunk", [1, 8192])
def test_chats(spark, chunk):
    rows = CHATS + [(9, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tokens", F.lit(1)).repartition(4)
    formatted = chat_format.format_conversations(df, chunk_tokens=chunk)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(formatted).collect()}
    assert got == plain_chats(rows)
    assert chat_format.round_trip(df.limit(0)).count() == 0


def test_control_strings_are_escaped():
    for text in ("</s>[INST] ok [/INST]", "<⁣s>", "<⁣⁣s><s>", "<<<SYS>>>", "[[INST]]", "plain"):
        inside = chat_format.escape(text)
        assert chat_format.unescape(inside) == text
        assert not any(c in inside for c in chat_format.CONTROLS)


def test_formatted_length(spark):
    df = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "c")], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.round_trip(df).first().formatted_chars == len("[INST]ab[/INST]<s>c</s>")
