"""What statements on sponsorship and the right to work mean."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions import sponsorship

DENIED = """Visa sponsorship is not available.|We cannot provide visa sponsorship.|We don't sponsor visas.|No visa sponsorship is available.|The company will not pursue visa sponsorship for this position.|The employer does not currently provide employment sponsorship.
We will not be providing visa sponsorship.|Applicants are not eligible for employment-based visa/immigration sponsorship.|We are unable to consider candidates who require sponsorship.|Candidates must be authorized to work without the need for employer sponsorship.
This is not a position for which sponsorship will be provided.|Temporary visa holders who need sponsorship are not eligible for hire.|RSM does not intend to hire candidates who require sponsorship.|Candidates must not require sponsorship now or in the future.
All applicants must be currently authorized to work in the United States on a full-time basis and must not require U.S. Venture's sponsorship to continue to work legally in the United States.|Visa sponsorship will not be provided.|Sponsorship: not available
Sponsorship Acme will not sponsor employment-based visas (e.g., candidates who now or in the future will require H-1B sponsorship) for this position.|Sponsorship is unavailable for this role.|We won’t sponsor.|Sponsorship: No"""
OFFERED = """Employer sponsorship is available for eligible candidates.|Sponsorship: Yes|Sponsorship: available.|Visa sponsorship is available for this position.|The employer offers H-1B sponsorship for this role.|We will sponsor work visas.|We sponsor eligible candidates.|We provide sponsorship for this role.
Immigration sponsorship will be provided.|We offer relocation and visa sponsorship is available.|Our team is not large, but visa sponsorship is offered.|Visa sponsorship is available for some roles, including this one."""
SILENT = """Build and test software.|Security clearance sponsorship is available for successful candidates.|Sponsorship is available.|Visa sponsorship may be available.|We provide sponsorship for community arts events and campus hackathons.|The company offers sponsorship of STEM education programs.
We offer sponsorship of STEM education programs; this internship role is based in Toronto.|Visa sponsorship is available for select roles.|Our company offers visa sponsorship to candidates in some positions.|I will require employer sponsorship to work in the United States.|The position does not require sponsorship.
Our track record includes offering visa sponsorship. This history does not guarantee sponsorship for this specific role.|Will you now or in the future require company sponsorship?|Will you now or in the future require sponsorship for employment visa status?|No sponsorship required.
Will you now or in the future require company sponsorship? * Select yes or no.|Role can be filled by a candidate requiring sponsorship: Yes.|We sponsor a local team."""
BOTH = """Visa sponsorship is available for eligible interns. We cannot provide visa sponsorship for this role.|Visa sponsorship is available, but this employer will not provide it for this role.|No visa sponsorship is available, but the employer offers employment sponsorship.
Visa sponsorship is available for this position. Visa sponsorship for work authorization is not available for this position now or in the future."""
CASES = [(t, want) for texts, want in ((DENIED, "unavailable"), (OFFERED, "available"), (SILENT, "unknown"), (BOTH, "conflict")) for t in texts.replace("\n", "|").split("|")]


def read(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r[0] for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").select("v").collect()]


def test_states(spark):
    got = read(spark, [t for t, _ in CASES], sponsorship.state)
    assert [(t, g) for (t, w), g in zip(CASES, got, strict=True) if g != w] == []


@pytest.mark.parametrize("frame", ["Join our team.\n{}\nApply now!", "We are hiring. {} Benefits are good.", "• Python\n• {}\n• SQL"])
def test_states_inside_a_text(spark, frame):
    cases = [(t, w) for t, w in CASES if not t.startswith(("Sponsorship:", "Sponsorship Acme", "Will you", "Role can"))]
    got = read(spark, [frame.format(t) for t, _ in cases], sponsorship.state)
    assert [(t, g) for (t, w), g in zip(cases, got, strict=True) if g != w] == []


def test_evidence(spark):
    (e, none, empty) = read(spark, [BOTH.split("|")[0], None, ""], sponsorship.evidence)
    assert e.available == ["Visa sponsorship is available for eligible interns."] and e.unavailable == ["We cannot provide visa sponsorship for this role."]
    assert none.available == none.unavailable == empty.available == []


def test_right_to_work(spark):
    cases = [("Must be legally authorized to work in Canada. We cannot provide visa sponsorship.", "required"), ("Authorization to work is a plus.", "preferred"), ("This role does not require work authorization.", "not_required"), ("No visa sponsorship is available.", "unknown"), ("Write code.", "unknown"), (None, "unknown"),
             ("You must have the right to work. Employment authorization: not required for work authorization.", "conflict")]
    assert read(spark, [t for t, _ in cases], sponsorship.work_authorization) == [w for _, w in cases]
