"""Page facts on small documents."""

import pytest

from rosterloom.functions import vocab
from rosterloom.operators import pages


def one(spark, html, expr):
    return spark.createDataFrame([(html,)], "h string").select(expr).first()[0]


@pytest.mark.parametrize("html,want", [
    ('<meta property="og:description" content=" A &amp; B "><meta name="description" content="C">', "A & B"),
    ("<META CONTENT='C' NAME='Description'>", "C"),
    ('<meta name="description" content=""><meta name="twitter:description" content="T">', "T"),
    ('<meta name="keywords" content="k">', None),
])
def test_meta_description(spark, html, want):
    assert one(spark, html, pages.meta_description("h")) == want


def test_visitor_links_take_the_first_in_document_order(spark):
    html = ('<a href="/about">About</a><a class="x" href="plan.html"><b>Plan</b> your visit</a>'
            '<a href="/tickets">Buy</a><a href="https://o.org/visit">go</a><a href=\'/ada\'>ADA</a>')
    df = spark.createDataFrame([(1, "http://m.org/a/b", html), (2, "http://m.org", "none")],
                               "id int, url string, html string")
    out = {r.id: r for r in pages.visitor_links(df, "id", "url", "html").collect()}
    assert out[1].hours_url == "http://m.org/a/plan.html"
    assert out[1].tickets_url == "http://m.org/tickets"
    assert out[1].accessibility_url == "http://m.org/ada"
    assert out[2].hours_url is None
    plan = pages.visitor_links(df, "id", "url", "html")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_clean_text(spark):
    html = ("<html><header>H</header><body><script>x()</script><p>One &amp; two</p>\n\n\n<p>Three</p>"
            "<!-- <p>no</p> --><footer>F</footer></body></html>")
    assert one(spark, html, pages.clean_text("h")) == "One & two\nThree"
    assert one(spark, "<p>" + "y" * 30 + "</p>", pages.clean_text("h", 10)) == "y" * 10 + "..."


PAGE = """<html><body><div id="x">Open daily</div><main>
<nav>hours</nav><section>Hours: 9-5 <br>daily</section><div>Other</div>
<div>Schedule<section>open late</section></div><aside>tickets</aside></main></body></html>"""


def topic(spark, html, *words):
    df = spark.createDataFrame([(1, html)], "id bigint, h string")
    return pages.topic_sections(df, "id", "h", {"x": words}).first().x_text


def test_topic_sections(spark):
    # the outer block and the one inside both mention the topic, so both are taken
    assert topic(spark, PAGE, *vocab.SECTION_KEYWORDS["hours"]) == (
        "Hours: 9-5\ndaily\nSchedule\nopen late\nopen late")
    # nothing mentions the topic: the whole main area
    assert topic(spark, PAGE, "wheelchair") == "Hours: 9-5\ndaily\nOther\nSchedule\nopen late"
    assert topic(spark, "<p>no body</p>", "x") is None
    assert topic(spark, None, "x") is None and topic(spark, "", "x") is None
    long = topic(spark, "<body><article>" + "<p>cost</p>" * 400 + "</article></body>", "cost")
    assert long.endswith("...") and len(long) == 1503
    areas = ('<div id="main">c</div><div class="x content">a &amp; b<div>in</div></div>', '<body id="b">c</body>',
             "<div id=main><img src=x/>c<br>d</div>")
    assert [topic(spark, a, "none") for a in areas] == ["a & b\nin", "c", "c\nd"]


def test_topic_sections_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, PAGE)], "id bigint, html string")
    out = pages.topic_sections(df, "id", "html")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
    row = out.first()
    assert row.hours_text.startswith("Hours: 9-5") and row.admission_text.startswith("Hours")


def test_links_attributes_comments_and_dots(spark):
    html = ('<!-- <a href="/hours">hours</a> --><script>"<a href=\'/hours\'>hours</a>"</script>'
            '<a data-href="/wrong" href="../visit/./x?a=../b">Plan your visit</a><a href="./accessible/..">More</a>')
    df = spark.createDataFrame([(1, "https://x.org/a/b/", html)], "id int, url string, html string")
    row = pages.visitor_links(df, "id", "url", "html").first()
    assert row.hours_url == "https://x.org/a/visit/x?a=../b"
    assert row.accessibility_url == "https://x.org/a/b/"


def test_clutter_is_removed_by_depth(spark):
    assert one(spark, "<nav>a<nav>b</nav>c</nav>d", pages.clean_text("h")) == "d"
    assert one(spark, "x</nav>y<header>z", pages.clean_text("h")) == "xy"
    assert one(spark, "<p>Mus&eacute;e &#8217;&#x1F600;&amp;lt; &bogus; 1 < 2</p>", pages.clean_text("h")) == (
        "Mus\u00e9e \u2019\U0001F600&lt; &bogus; 1 < 2")
    assert one(spark, '<meta name="description" content="&Eacute;t&#233; &apos;">',
               pages.meta_description("h")) == "\u00c9t\u00e9 '"


def test_sections_outside_the_main_area_do_not_count(spark):
    page = "<body><main><p>x</p></main><div>Open hours here</div></body>"
    assert topic(spark, page, "hours") == "x"


def soup(rnd):
    """A page of nested, unclosed, stray and odd tags."""
    parts = []
    for _ in range(rnd.randint(0, 60)):
        name = rnd.choice(["div", "section", "nav", "header", "aside", "p", "article", "main", "b", "nav-x", "BODY"])
        parts.append(rnd.choice([
            f"<{name}>", f"<{name}>", f"</{name}>", f"</{name} >", f"<{name}/>", f'<{name} class="a content">',
            f"<{name} id=main>", "ho", "urs", " open ", "cost", "<br>", "<!-- <div> hours -->", "<", "&amp;",
            "<script>'<nav>'</script>", "</script>", "\n x", "<!doctype html>"]))
    return "".join(parts)


def tokens_by_hand(html):
    import re

    found = re.findall(r"(?is)<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)"
                       r"|<[a-z/!?][^>]*>|[^<]+|<", html)
    out = []
    for t in found:
        name = re.match(r"</?([a-zA-Z][^\s/>]*)", t)
        name = name.group(1).lower() if name else ""
        moves = 0 if name in ("", "br", "script") else -1 if t.startswith("</") else 0 if t.endswith("/>") else 1
        out.append((t, name, moves, t.startswith("<!--") or name == "script"))
    return out


def outside_by_hand(tokens, names):
    depth, kept = 0, []
    for t in tokens:
        if t[1] in names:
            depth = max(0, depth + t[2])
        elif not depth and not t[3]:
            kept.append(t)
    return kept


def inside_by_hand(tokens, at):
    depth = 1
    for j in range(at + 1, len(tokens)):
        depth += tokens[j][2] if tokens[j][1] == tokens[at][1] else 0
        if not depth:
            return tokens[at + 1:j]
    return tokens[at + 1:]


def sections_by_hand(html, words):
    import re

    tokens = outside_by_hand(tokens_by_hand(html), ("nav", "header", "footer", "aside"))
    opens = [i for i, t in enumerate(tokens) if t[2] == 1]

    def attr(i, name):
        m = re.search(rf"\s{name}\s*=\s*[\"']?([^\"'>]*)", tokens[i][0])
        return m.group(1) if m else ""

    tests = [lambda i: tokens[i][1] == "main", lambda i: tokens[i][1] == "article",
             lambda i: "content" in attr(i, "class").split(), lambda i: attr(i, "id") == "content",
             lambda i: "main" in attr(i, "class").split(), lambda i: attr(i, "id") == "main",
             lambda i: tokens[i][1] == "body"]
    at = next((i for test in tests for i in opens if test(i)), None)
    if at is None:
        return None
    area = inside_by_hand(tokens, at)

    def texts(part):
        return [t[0].replace("&amp;", "&") for t in part if t[1] == ""]

    blocks = [texts(inside_by_hand(area, i)) for i, t in enumerate(area)
              if t[2] == 1 and t[1] in ("section", "div", "article")]
    hits = [b for b in blocks if any(w in "".join(b).lower() for w in words)][:3]
    pieces = [p.strip() for b in hits for p in b] if hits else [p.strip() for p in texts(area)]
    return "\n".join(p for p in pieces if p)


def test_page_structure_equals_a_stack(spark):
    import random

    rnd = random.Random(11)
    rows = [(i, soup(rnd)) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "id int, h string")
    topics = {"x": ("hours", "cost"), "y": ("open",)}
    got = {r.id: r for r in pages.topic_sections(df, "id", "h", topics, max_length=10 ** 6).collect()}
    kept = {r.id: r.k for r in df.select("id", pages.without_elements(
        pages.text.as_col("h"), ("nav", "header", "footer")).alias("k")).collect()}
    hits = 0
    for i, html in rows:
        want = [sections_by_hand(html, w) if html else None for w in topics.values()]
        assert [got[i].x_text, got[i].y_text] == want, html
        hits += want[0] is not None
        if html is not None:
            assert kept[i] == [t[0] for t in outside_by_hand(
                tokens_by_hand(html), ("nav", "header", "footer"))], html
    assert hits > 100


@pytest.mark.parametrize("page", ["<div>no words</div>", "<nav>a</nav><p>b</p>"])
def test_long_pages_take_time_in_proportion(spark, page):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, f"<main>{page * n}</main>")], "id bigint, h string")
        start = time.perf_counter()
        df.select(pages.clean_text("h")).collect()
        pages.topic_sections(df, "id", "h").collect()
        return time.perf_counter() - start

    seconds(100)
    # 25 times the tokens, beside what any run takes: far from 625 times the work
    short, long = seconds(1_000), seconds(25_000)
    assert long < 20 * short
