import html
import re

import numpy as np
import pytest
from conftest import SF_SMALL
from inclusio.llm import html_extract as hx
from inclusio.llm.boosting import fit_trees


@pytest.fixture(scope="module")
def trees(spark):
    return hx.train(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))


def template_text(source):
    """Main text of the test pages, by their template."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_query_against_the_template(spark):
    from inclusio.llm.catalog import op9_main_text
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = op9_main_text(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == template_text(pages[r.page_id].html) and r.n_chars == len(r.text)


SENTENCES = "The first sentence of the text is long enough to count, and it goes on. A second one follows it, with some more words."


@pytest.mark.parametrize("side", [
    '<header class="site"><h1>My Site</h1></header>', "<nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>", '<div id="cookie-notice">We use cookies here.</div>',
    "<aside><p>Something beside it, that is long enough to look like text.</p></aside>", "<form><label>Name</label><input><button>Go</button></form>",
    '<section class="comments"><h3>Comments</h3><p>I like it, great, thanks a lot for this.</p></section>', '<div class="ad banner">Buy it now.</div>', "<footer><p>&copy; me</p></footer>",
    "<script>if (a < b) document.write('<p>no</p>')</script>", "<style>p > a {x:y}</style>", "<!-- <p>hidden</p> -->", '<div class="sidebar"><p>Related things, all of them, in one place.</p></div>', "<noscript><p>Turn it on.</p></noscript>"])
def test_parts_that_are_not_main_text(trees, side):
    inside = "" if side.startswith("<header") else side  # a header inside an article is the article's
    page = f'<html><head><title>T</title></head><body>{side}<article><h1>A &amp; B</h1><p>{SENTENCES}</p><p>x&lt;y&nbsp; z\n\t w<b>bold</b>ly</p>{inside}</article>{side}</body></html>'
    assert hx.extract([page], trees) == [f"A & B\n\n{SENTENCES}\n\nx<y z wboldly"]


def test_structure_decides_where_nothing_is_named(trees):
    page = (f"<html><body><div><a href=1>Home</a> <a href=2>About</a></div><div><h1>Plain Title</h1><p>{SENTENCES}<p>{SENTENCES} Again.</div>"
            "<div><a href=3>Terms</a> | <a href=4>Privacy</a></div></body></html>")
    assert hx.extract([page], trees) == [f"Plain Title\n\n{SENTENCES}\n\n{SENTENCES} Again."]


def test_no_kept_node_stands_below_a_dropped_one(trees):
    rng = np.random.default_rng(3)
    page = hx.Page("<body>" + "".join(f"<div>{'<ul><li>a b c<li>d e</ul>' * 3}<p>text {i}</div>" for i in range(20)))
    _, own = hx.features([page])
    for _ in range(20):
        odds = rng.normal(0, 2, len(page.tag))
        kept = hx.decode(page, odds, own)
        neutral = [t in ("#root", "html", "body") for t in page.tag]
        assert all(kept[page.parent[i]] or neutral[page.parent[i]] for i in np.flatnonzero(kept) if page.parent[i] >= 0)
        assert not any(kept[i] and odds[i] < 0 and page.end[i] == i for i in range(len(kept)) if not neutral[i])


def test_broken_pages(trees):
    for source in ("", " ", "<", "<p", "</p></div>", "<p>a<script>x", "<!-- x", "<div " * 50, "<b><p></b>x", "&#0;&bogus;&#x110000;", "\x00<p>\x00", "<p>" * 3000, "<div>" * 400 + "x" + "</div>" * 400, "<a href='>'>x</a>" * 20):
        assert isinstance(hx.extract([source], trees)[0], str) and isinstance(hx.extract([source], None)[0], str)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.2)).astype(float)
    t = fit_trees(x[:3000], y[:3000], np.ones(3000))
    assert ((t.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_odd_rows(spark, trees):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<article><p>some text here, more of it.</p></article>"), (3, "v", "just words, with no tags at all.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars", "'z' AS rank", "'k' AS `all`")
    got = sorted(((r.page_id, r.url, r.text) for r in hx.main_texts(df, trees).collect()), key=str)
    assert [g[:2] for g in got] == sorted([(r[0], r[1]) for r in rows], key=str) and ("some text here, more of it." in [g[2] for g in got])
    assert hx.main_texts(df.limit(0), trees).collect() == [] and hx.train(df.limit(0)) is None
    assert hx.main_texts(df, hx.train(df)).count() == len(rows)


@pytest.mark.parametrize("odd", [
    '<svg viewBox="0 0 1 1"/>', "<svg/>", "<math />", "<svg><title/><path d=x /></svg>", "<svg><style/></svg>", "<svg>a<br/>b</svg>", "<svg><text>Label</text></svg>", "<svg>", "<object data=x>", "<select>",
    "<select><option>One<option>Two", "<template>", "<noscript><div><p>Turn it on.</p></div></noscript>", "<object><object>no</object>no</object>", "<object><p>no</object>", "<template><li>no<li>no</template>",
    "<SCRIPT>if (a</b) '</scripty>'</SCRIPT >", "<style>p</STYLE\n>", "<select><option>a</select>", "<a href=x><svg><text>no</text></svg></a>"])
def test_odd_elements_do_not_take_main_text(trees, odd):
    page = f"<html><body><article><h1>A title</h1><p>{SENTENCES}{odd}</p><p>{SENTENCES} Again.</p></article></body></html>"
    assert hx.extract([page], trees) == [f"A title\n\n{SENTENCES}\n\n{SENTENCES} Again."]


def test_letters_that_get_longer_in_lower_case(trees):
    page = f"<html><body><article><h1>A title</h1><p>{'\u0130' * 300} {SENTENCES}<script>x</script></p><p>{SENTENCES}</p><script>y</script><p>{SENTENCES} End.</p></article></body></html>"
    assert hx.extract([page], trees) == [f"A title\n\n{'\u0130' * 300} {SENTENCES}\n\n{SENTENCES}\n\n{SENTENCES} End."]


def test_dropped_elements_leave_no_trace():
    lists = lambda p: (p.tag, p.parent, p.depth, p.nth, p.side, p.main, p.link, p.end, p.children, [x for x in p.pieces if x[0] >= 0])
    for odd in ("<noscript><div><a href=x>no<p>no</a></div></noscript>", "<template><ul><li>no</ul></template>", "<svg><a>no</a><title>no</title></svg>", "<select><option>no</select>"):
        assert lists(hx.Page(f"<div><a href=x>b</a>{odd}<p>c <a href=y>d</a></p></div>")) == lists(hx.Page("<div><a href=x>b</a><p>c <a href=y>d</a></p></div>"))


@pytest.mark.parametrize("body, text", [
    ("<p title=it's>First one.</p><p>You don't say.</p><p>Third.</p>", ["First one.", "You don't say.", "Third."]),
    ('<p class="a"">First.</p><p>Second.</p>', ["First.", "Second."]),
    ("<p x=\"1\" y = '2>3' z=4/>b<br/>c <i q>d</i> < e <3 f</p>", ["b c d < e <3 f"]),
    ('<p data-note="hidden nav">Kept.</p><p =odd "x>Also.</p>', ["Kept.", "Also."]),
    ("<p a='x>One.</p><p>Two.</p>", ["One.", "Two."])])
def test_quotes_outside_values_are_characters(trees, body, text):
    page = hx.Page(f"<article>{body}</article>")
    assert page.blocks([1] * len(page.tag)) == text


def test_an_unfinished_tag_ends_the_page_once():
    page = hx.Page("<p>Before.</p>tail <b class='x")
    assert page.blocks([1] * len(page.tag)) == ["Before.", "tail"]


@pytest.mark.parametrize("page", [lambda n: "<a " * n, lambda n: "<div>" * n + "x", lambda n: "<!" * n, lambda n: '<a b="' * n + ">",
                                  lambda n: "<p><button>" + "<div>" * n + "x", lambda n: "<ul>" + "<li><div>" * n])
def test_long_pages_take_time_in_proportion(page):
    import time
    took = []
    for n in (10_000, 20_000):
        began = time.perf_counter()
        hx.features([hx.Page(page(n))])
        took.append(time.perf_counter() - began)
    assert took[1] < 2.3 * took[0] + 0.2
