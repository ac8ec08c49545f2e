"""JSON of any shape: all nodes, texts, paths by row, evidence that moves, and the readers of pages that rest on them."""

import json

from pyspark.sql import functions as F

from vacantia.operators import nested
from vacantia.sources import extract


def plain(value, path=""):
    yield path
    if isinstance(value, dict):
        for k in sorted(value):
            yield from plain(value[k], f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from plain(x, f"{path}[{i}]")


DEEP = "x"
for _ in range(12):
    DEEP = {"k": [DEEP]}
VALUES = [{"b": [1, {"c": "two"}, None], "a": "one"}, [], {}, "alone", 5, None, [["p", ["q"]], "r"], DEEP, {"": "no name", "e f": {"g": True}}]


def test_nodes_and_texts(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(90, "{bad"), (91, None), (92, "")]
    df = spark.createDataFrame(rows, "id int, j string")
    found = nested.nodes(df, ["id"], "j").collect()
    for i, v in enumerate(VALUES):
        assert [r.path for r in sorted((r for r in found if r.id == i), key=lambda r: r.place)] == list(plain(v)), v
    assert not [r for r in found if r.id >= 90]
    text = {r.id: r.text for r in nested.texts(df, ["id"], "j").collect()}
    assert text == {0: "one\ntwo", 3: "alone", 6: "p\nq\nr", 7: "x", 8: "no name"}


def test_nothing(spark):
    assert nested.nodes(spark.createDataFrame([], "id int, j string"), ["id"], "j").count() == 0


def test_paths_by_row(spark):
    v = json.dumps({"a": [{"b": "x"}, {"b": 7}], "m n": {"o": [True]}, "d": {"min": 2027, "max": 2029}, "description": "Write, well-tested code in Python.", "list": ["Old one", "Café &  Bar"]})
    rows = [("a[1].b", "7"), ("a[0].b", "x"), ("a[0]", None), ("a[5].b", None), ("m n.o[0]", "true"), ("d", None), ("zz.y", None), ("", None), (None, None)]
    df = spark.createDataFrame([(v, p) for p, _ in rows], "j string, p string")
    assert [r[0] for r in df.select(nested.resolved(F.try_parse_json("j"), F.col("p"))).collect()] == [w for _, w in rows]
    moves = [("list[0]", "café bar", "list[1]"), ("list[9]", "OLD-ONE", "list[0]"), ("list[0]", "gone", None), ("a[0].b", "7", "a[1].b"), ("d", "2027-2029", "d"), ("d", "2027", None), ("description", "well tested", "description"), ("a", "x", None), ("list[0]", "  ", None), ("a[0].b", None, None), ("nowhere[0]", "x", None)]
    df = spark.createDataFrame([(v, p, s) for p, s, _ in moves], "j string, p string, s string")
    assert [r[0] for r in df.select(nested.realigned(F.try_parse_json("j"), F.col("p"), F.col("s"))).collect()] == [w for _, _, w in moves]


def test_readers_of_pages(spark):
    job = {"@type": ["Thing", "JobPosting"], "title": "Intern", "hiringOrganization": [{"name": "Acme"}], "jobLocation": {"address": {"addressLocality": "Paris"}}, "url": "u", "datePosted": "2026-01-01"}
    deep = {"@graph": [{"x": [{"y": job}]}, {"@type": "JobPosting", "title": "Second", "hiringOrganization": "Plain"}]}
    page = lambda *bodies: "<html>" + "".join(f"<script type='application/ld+json'>{b}</script>" for b in bodies) + "</html>"
    state = lambda v: f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(v)}</script>'
    pages = [(1, page(json.dumps(deep), "{broken")), (2, page("<!-- " + json.dumps([job]) + " -->")), (4, "<p>ld+json</p>"), (5, None), (6, state({"props": {"jobs": [{"title": "T", "company": {"name": "C"}, "location": "L"}, {"title": "no company"}]}}))]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = sorted((r.page_id, r.title, r.company, r.location) for r in extract.structured_postings(df).collect())
    assert got == [(1, "Intern", "Acme", "Paris"), (1, "Second", "Plain", None), (2, "Intern", "Acme", "Paris")]
    assert [(r.page_id, r.title, r.company, r.location, r.url) for r in extract.state_postings(df).collect()] == [(6, "T", "C", "L", None)]
