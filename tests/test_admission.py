"""Why postings are not admitted, with written answers."""

from pyspark.sql import functions as F

from vacantia.functions import classify as k

_TEAM = " You join a team of people on real products for four months, you are paid for it, and you learn a trade."
ROWS = [
    # title, company, description, score, located, dead, reason, reason where postings without a category are welcome
    ("Software Engineer Intern", "Acme", "Build Python services." + _TEAM, 60, True, False, None, None),
    ("Software Engineer Intern 2026", "Acme", "Build Python services." + _TEAM, 60, True, False, "title", "title"),
    ("PhD Intern", None, "", 0, False, True, "title", "title"),
    ("Software Engineer Intern", " ", "Build Python services." + _TEAM, 60, True, False, "incomplete", "incomplete"),
    ("Software Engineer Intern", "Acme", "Build Python services.", 60, True, False, "incomplete", "incomplete"),
    ("Software Engineer Intern", "Acme", None, 60, True, False, "incomplete", "incomplete"),
    (None, "Acme", "Build Python services." + _TEAM, 60, True, False, "incomplete", "incomplete"),
    ("Office Manager", "Acme", "Order paper, pens and coffee." + _TEAM, 60, True, False, "not a placement", "not a placement"),
    ("Software Engineer Intern", "Acme", "Build Python services." + _TEAM, 19, False, True, "score", "score"),
    ("Bakery Intern", "Acme", "Bake bread in the morning." + _TEAM, 20, True, False, "no category", None),
    ("Bakery Intern", "Acme", "Bake bread in the morning." + _TEAM, 44, False, False, "no category", "location"),
    ("Bakery Intern", "Acme", "Bake bread in the morning." + _TEAM, 45, True, False, None, None),
    ("Software Engineer Intern", "Acme", "Build Python services." + _TEAM, 60, False, True, "location", "location"),
    ("Software Engineer Intern", "Acme", "Build Python services." + _TEAM, 60, True, True, "dead link", "dead link"),
]


def test_reasons(spark):
    df = spark.createDataFrame(ROWS, "title string, company string, description string, score int, located boolean, dead boolean, reason string, lenient string")
    says = lambda unclassified: k.rejected(*map(F.col, ("title", "company", "description", "score")), 20, F.col("located"), F.col("dead"), unclassified)
    for r in df.select("*", says(False).alias("got"), says(True).alias("got_lenient")).collect():
        assert (r.got, r.got_lenient) == (r.reason, r.lenient), r
