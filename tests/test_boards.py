"""Readers of applicant systems' pages: selectors in one pass, nested and broken pages, pages read by lines."""

import time

import pytest

from vacantia.sources import boards
from vacantia.sources.extract import semantic
from vacantia.sources.selectors import compiled, scan

LONG = "This internship lets you learn robotics with a team of engineers who build real products, and every task is paid for."


def test_an_element_ends_at_its_own_end_tag():
    s = scan('<div id="content"><div>Short intro.</div><p>Body <b>here</b></p><div><div>deep</div></div>tail</div><div>outside</div>', ["#content", "#content div div", "div p b"])
    (e,) = s.found["#content"]
    assert s.text(e) == "Short intro.Body heredeeptail" and s.content(e) == "Short intro.\nBody here\ndeeptail"
    assert [s.text(x) for x in s.found["#content div div"]] == ["deep"] and [s.text(x) for x in s.found["div p b"]] == ["here"]


def test_selectors():
    page = """<section class="a  b" data-x='one "two"'><H1 CLASS=title>T&amp;T</H1><img alt="Acme Logo" src=x><a href="/apply?a=1&amp;b=2">Go</a></section><h1>second</h1>"""
    s = scan(page, [".a.b h1", "h1", "section.title", "img[alt*='Logo']", "a[href]", "[data-x='one \"two\"']", ".b [href*=apply]", "h2"])
    assert s.first_text([".a.b h1"]) == "T&T" and s.texts(["h1"]) == ["T&T", "second"] and not s.found["section.title"] and not s.found["h2"]
    assert s.found["img[alt*='Logo']"][0].attributes["alt"] == "Acme Logo" and s.found["a[href]"][0].attributes["href"] == "/apply?a=1&b=2"
    assert len(s.found[".b [href*=apply]"]) == 1 and s.first_text(["h2", "h1"]) == "T&T" and s.first_text(["h2"]) is None
    with pytest.raises(ValueError):
        compiled("a > b")


def test_content_leaves_out_navigation_and_marks_items():
    page = "<main><nav><ul><li>menu</ul></nav><h2>Head</h2>One<br>two<ul><li>x<li>y</ul><form>no</form><div class='cookie big'>no</div><p aria-hidden='true'>no</p><script>if (a < b) '</div>'</script><p>last</main>"
    s = scan(page, ["main"])
    assert s.content(s.found["main"][0]) == "Head\nOne\ntwo\n• x\n• y\nlast"


def test_broken_pages():
    assert scan("", ["h1"]).found == {"h1": []}
    s = scan("</div><h1>open <b>bold</h1> after</b><div>never closed", ["h1", "div"])
    assert s.first_text(["h1"]) == "open bold" and s.first_text(["div"]) == "never closed"
    s = scan("<p>one<p>two<table><tr><td>a<td>b<tr><td>c</table>1 < 2 <", ["p", "td"])
    assert s.texts(["td"]) == ["a", "b", "c"] and s.texts(["p"])[0] == "one"
    assert scan("<!-- <h1>no</h1> --><h1>yes</h1><!-- open", ["h1"]).texts(["h1"]) == ["yes"]


@pytest.mark.parametrize("unit", ["<", "<a ", "<div>", '<a "', "<p>", "<li>x", "</div>", "<!", "<!--", "<?", "<script>", "&", "<div></span>"])
def test_hostile_pages_take_time_in_proportion(unit):
    began = time.process_time()
    scan(unit * 60_000, ["h1", "#content", ".a .b"])
    assert time.process_time() - began < 5


def read(spark, *pages):
    df = spark.createDataFrame([(k, u, p) for k, (u, p) in enumerate(pages)], "page_id int, url string, html string")
    return {r.page_id: r.asDict() for r in boards.ats_postings(df).collect()}


def test_pages_of_systems_with_elements(spark):
    green = f'<head><title>Robotics Intern at Other</title></head><img alt="Northstar Logo"><h1 class="app-title">Robotics Intern</h1><div class="location">Toronto, ON</div><div class="location">toronto, on</div><div id="content"><div>Short intro.</div><p>{LONG}</p></div><a href="/northstar/jobs/12345/apply">Apply Now</a>'
    lever = f'<h1>Careers</h1><div class="posting-headline"><h2>Frontend Intern</h2></div><div class="posting-categories"><div class="location">Remote <b>Canada</b></div></div><div class="location">footer place</div><div class="posting-page"><div class="content"><div>{LONG}</div></div></div>'
    work = f"<meta property='og:site_name' content='Maple Data'><div data-automation-id='jobPostingHeader'><h2>Data Co-op</h2></div><div data-automation-id='locations'>Waterloo</div><div data-automation-id='jobPostingDescription'><div><div>{LONG}</div></div></div><div data-automation-id='postedOn'>Posted 3 Days Ago</div>"
    ashby = f"<h1 data-testid='job-title'>Design Intern</h1><p class='job-location-x'>Berlin</p><div data-testid='job-description'><p>{LONG}</p></div>"
    got = read(
        spark, ("https://boards.greenhouse.io/northstar/jobs/12345", green), ("https://jobs.lever.co/aurora/222", lever), ("https://maple.wd5.myworkdayjobs.com/jobs/job/Waterloo/Data-Coop_R9001", work), ("https://jobs.ashbyhq.com/acme/1f", ashby),
        ("https://example.org/jobs/1", green), ("https://jobs.lever.co/aurora/223", lever.replace(LONG, "Short internship.")), ("https://jobs.lever.co/aurora/224", lever.replace("internship", "job").replace("Intern<", "Role<")), ("https://jobs.lever.co/a/1", None), (None, green),
    )
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0]["title"], got[0]["company"], got[0]["locations"], got[0]["job_id"]) == ("Robotics Intern", "Northstar", ["Toronto, ON"], "12345")
    assert got[0]["description"] == f"Short intro.\n{LONG}" and got[0]["application_url"] == "https://boards.greenhouse.io/northstar/jobs/12345/apply"
    assert (got[1]["title"], got[1]["locations"], got[1]["application_url"]) == ("Frontend Intern", ["Remote Canada", "footer place"], "https://jobs.lever.co/aurora/222/apply")
    assert (got[2]["title"], got[2]["company"], got[2]["posted"], got[2]["locations"]) == ("Data Co-op", "Maple Data", "Posted 3 Days Ago", ["Waterloo"])
    assert got[3]["locations"] == ["Berlin"] and got[3]["application_url"] == "https://jobs.ashbyhq.com/acme/1f/application"


def test_pages_of_systems_read_by_lines(spark):
    laid = lambda text: "".join(f"<div><span>{x}</span></div>" for x in text.split("\n"))
    first = laid(f"Life here\nMachine Learning Intern - 2027\nLocation:\nSan Jose\nTeam:\nTech\nJob Code:\nA221977\nResponsibilities\n{LONG}\nMinimum Qualifications\nAbout Us\nWe are.")
    second = "<title>Software Intern - 2027 Summer - TikTok</title>" + laid(f"Company\nSan JoseInternR&amp;DFuture Talent Job ID: A134948A\nResponsibilities\n{LONG}\nThe hourly rate range for this position is $45- $45.\nApply to this job\n")
    oracle = "<title>Research Internship - AI - Acme Home Careers</title>" + laid(f"View More Jobs\nResearch Internship - AI\nSan Jose, CA, United States\nTRENDING\nJOB DESCRIPTION\n{LONG}\nABOUT US\nold")
    whole = "<title>2027 Data Program - Internship - JPMC Candidate Experience page</title>" + laid(f"View More Jobs\n2027 Data Program - Internship\nChicago, IL, United States and 1 more\nAPPLY NOW\nJOB INFORMATION\nJob Identification\n210773869\nPosting Date\n08/11/2026, 12:19 PM\nLocations\nChicago, IL, United States\nNew York, NY, United States\nApply Before\n11/06/2026, 12:00 AM\nBase Pay/Salary\nChicago, IL $45.67-$45.67\nJOB DESCRIPTION\n{LONG}")
    site = "https://{}.fa.us6.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/{}"
    got = read(spark, ("https://joinbytedance.com/search/7671291260529821957", first), ("https://careers.tiktokusds.com/usds/position/76/detail", second), (site.format("ehac", 15762), oracle), (site.format("jpmc", 210773869), whole))
    pick = lambda k, *f: tuple(got[k][x] for x in f)
    assert pick(0, "title", "company", "locations", "job_id") == ("Machine Learning Intern - 2027", "ByteDance", ["San Jose"], "A221977") and "About Us" not in got[0]["description"]
    assert pick(1, "title", "company", "locations", "job_id", "salary") == ("Software Intern - 2027 Summer", "TikTok USDS Joint Venture", ["San Jose"], "A134948A", "$45- $45")
    assert pick(2, "title", "company", "locations", "job_id") == ("Research Internship - AI", "Acme Home", ["San Jose, CA, United States"], "15762")
    assert pick(3, "company", "locations", "job_id", "posted", "deadline", "salary") == ("JPMorganChase", ["Chicago, IL, United States", "New York, NY, United States"], "210773869", "08/11/2026, 12:19 PM", "11/06/2026, 12:00 AM", "Chicago, IL $45.67-$45.67")


def test_a_shown_heading_comes_before_a_hidden_one():
    page = f'<main><h1 class="visibility--hidden--visually">Brand</h1><h2 class="banner__text__title">Reliability Intern</h2><article>{LONG} Your role begins in May.</article></main>'
    assert semantic(page) == [{"title": "Reliability Intern"}] and semantic("<h1>x</h1>short") == []
