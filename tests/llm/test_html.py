import random

import pytest

from inkgauge.llm import op4_mincut as o

PAGE = """<!DOCTYPE html><html><head><title>t &amp; x</title><style>p{}</style></head><body><header><h1>Site</h1>
<ul class="menu"><li><a href=/>Home</a><li><a href=/a>About us</a></ul></header><div class="cookie-notice">We use cookies to improve. Accept?</div>
<div id="content"><h1>Big title</h1><p>First paragraph of the story, with <b>bold</b>ness &eacute;t&eacute;.<p>Second   one.&#32;It is longer
than the first and <!-- no --> has words.</p><div class="ad">Buy this now! It is cheap.</div><ul><li>One item of a list in the text.</li>
<li>Another item here.</li></ul><p>End of 1 &lt; 2.</p><form><label>Name</label><input><button>Go</button></form></div>
<aside><h3>Related</h3><p>Some other story here that is long enough to look like content.</p></aside><section id="comments">
<p>Great article! I really liked reading this, thanks.</p></section><script>var a = "<p>no</p>";</script>
<footer>&copy; 2020 <p>Imprint is a longer paragraph. Legal text.</p></footer></body></html>"""


def test_page():
    assert o.extract_blocks(PAGE) == [
        "Big title", "First paragraph of the story, with boldness été.", "Second one. It is longer than the first and has words.",
        "One item of a list in the text.", "Another item here.", "End of 1 < 2.",
    ]


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "</", "<p>", "<!--", "<script>", "<a href='", "&amp", "<p><b><i></p></div></b>x", "<" * 500, "<div>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(o.extract_blocks(page), list)


def cost_of(side, costs, edges):
    return sum(b if s else a for s, (a, b) in zip(side, costs)) + sum(c for i, j, c in edges if side[i] != side[j])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_a_minimum(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    costs = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
    edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
    best = min(cost_of([bool(m >> i & 1) for i in range(n)], costs, edges) for m in range(1 << n))
    assert cost_of(o.minimum_cut(costs, edges), costs, edges) == best


def test_query_keeps_articles(spark):
    import html
    import re

    rows = o.op4_html_mincut(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0].split("<footer")[0]
        body = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", "", body)).split()) and r.n_chars == len(r.text)


def test_frame_with_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, PAGE, "k"), (3, PAGE, "k")], "page_id int, html string, blocks string")
    got = o.extract_html(df).collect()
    assert [len(r.blocks) for r in sorted(got, key=lambda r: r.page_id)] == [0, 0, 6, 6]
    assert o.extract_html(df.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["", "</head>"])
@pytest.mark.parametrize("begin", ["<body>", "<BODY class=x>", ""])
def test_a_head_may_have_no_end_tag(begin, end):
    page = f"<!doctype html><html><head><meta charset=utf-8><title>t</title><style>p{{}}</style>\n{end}{begin}<main><p>The first paragraph of a story, it is long enough.<p>And here is one more of it.</main>"
    assert o.extract_blocks(page) == ["The first paragraph of a story, it is long enough.", "And here is one more of it."]


def test_text_ends_a_head():
    assert [t for _, t in o.blocks_of("<head><title>t</title> \n<script>1</script>Plain words.")] == ["Plain words."]
    assert [t for _, t in o.blocks_of("<head><title>t</title><br>Plain words.<p>More.")] == ["Plain words.", "More."]


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    def seconds(n):
        pages = ["<b>" * n + "x</p>" * n, "<div>" * n + "</i>word" * n, "<ul>" + "<span>" * n + "<li>a" * n, "<p>long text. " * n]
        start = time.process_time()
        found = [" ".join(o.extract_blocks(p)) for p in pages]
        assert found[3].count("long text.") == n
        return time.process_time() - start

    seconds(200)
    small, large = seconds(2000), seconds(16_000)
    assert large < 30 * small + 1.0


def test_an_end_tag_ends_the_innermost_open_element_of_its_name():
    page = "<main><p>One <b>two <i>three</b> four.</p></i></em><p>Five.</main>"
    assert " ".join(o.extract_blocks(page)) == "One two three four. Five."
