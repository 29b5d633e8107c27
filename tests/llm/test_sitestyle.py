import html as entities
import re

import pytest

from tidelake.llm import sitestyle
from tidelake.session import Scratch


def main(page):
    return " ".join(t for (_, prior, _), t in sitestyle.settle(sitestyle.blocks(page)) if prior != 0)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a &amp; b&nbsp;c &#233; &eacute <b>x</b>y</p>", "a & b c é é xy"),
        ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T one two"),
        ("<nav><a>m</a></nav><article>a<div class='comments'><p>c</p></div>b</article>", "a b"),
        ("<main><header><h1>H</h1></header>x<form>f<input></form><aside>s</aside><p>y</main>", "H x y"),
        ("<div class=ad>buy</div><div id='content'><p>text</p></div><div class='cookie-notice'>ok?</div>", "text"),
        ("<article>a<script>if (a</b>) '<p>'</script><style>p{}</style><!-- <p>no --><p>b &lt;p&gt;</article>", "a b <p>"),
        ("<article>cut off in a tag <a hre", "cut off in a tag"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table></article>", "1 2 3 4 5"),
        ("<article>in<em>line</em> <i>and</i>\n more</article>", "inline and more"),
        ("<article>a &am", "a &am"),
        ("<article>1 < 2 and a<b></article>", "1 < 2 and a"),
        ("<ARTICLE><P TITLE='>'>x</P></ARTICLE><section id=comments><article>reply</article></section>", "x"),
        ("<article hidden>no</article><article>yes</article>", "yes"),
        ("<script>never ends", ""),
    ],
)
def test_pages(page, text):
    assert main(page) == text


def test_sample(spark, scratch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in sitestyle.extract(pages, scratch).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*(>|\Z)", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", inner)
        assert got[r.page_id] == " ".join(entities.unescape(inner).split())


def test_style_tree(spark, scratch):
    """Pages without a main part: what a host repeats goes, what one page has stays."""
    page = "<div class=top>Site name</div><div class=x><p>story {0} about {0}</p><p>read more</p></div><div>always the same</div>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(12)] + [(50, "http://h.example/3b", page.format(3))]
    rows += [(100, "http://alone.example/", "<div>always the same</div>"), (101, None, None), (102, "x", "<nav>n</nav>"), (102, "x", "<nav>n</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in sitestyle.extract(df, scratch).collect())
    want = [(k, f"story {k} about {k}") for k in range(12)] + [(50, "story 3 about 3"), (100, "always the same"), (101, ""), (102, ""), (102, "")]
    assert got == want
    assert sitestyle.extract(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark, "test")).count() == 0


def test_article_pages_count_in_the_tree(spark, scratch):
    """What a host's articles repeat goes from them and from plain pages; a host's few plain pages are no statistics of their own."""
    page = "<div class=top>Site name</div><article><p>story {0} about {0}</p><p>read more</p></article><div class=x>always the same</div>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(40)]
    rows += [(100, "http://h.example/plain", "<div class=top>Site name</div><div class=y>plain text</div><div class=x>always the same</div>")]
    rows += [(200 + k, f"http://small.example/{k}", f"<div>outside {k}</div><article><p>shared</p><p>own {k}</p></article>") for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in sitestyle.extract(df, scratch).collect()}
    want = {k: f"story {k} about {k}" for k in range(40)} | {100: "plain text", 200: "shared own 0", 201: "shared own 1"}
    assert got == want


@pytest.mark.parametrize(
    "page",
    [
        "<main class='no-sidebar'>x</main>",
        "<article class='post social-story'>x</article>",
        "<div id=content class='with-sidebar'><p>x</div>",
        "<div class='overflow-hidden'><article>x</article></div>",
        "<article data-title='The hidden valley'>x</article>",
        "<article data-hidden='false'>x</article>",
        "<div title='a class=ad'>x</div>",
        "<article class='post no-sidebar'>x</article>",
        "<article class='legal-news'>x</article>",
        "<article><section class='social-policy'>x</section></article>",
        "<article><div class='article-header'><h1>x</h1></div></article>",
        "<div id=content>x</div><div>y</div>",
    ],
)
def test_words_inside_names_and_values_are_no_furniture(page):
    assert main(page) == "x"


def test_a_hint_lowers_importance(spark, scratch):
    """On 3 of 16 pages a text's importance is 0.60, so it stays; below a hint it is 0.45."""
    page = "<div class=a>{1}</div><div class='with-sidebar'>{1} too</div><div>own {0}</div>"
    rows = [(k, f"http://h.example/{k}", page.format(k, "pair" if k < 3 else f"single {k}")) for k in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitestyle.extract(df, scratch).collect()}
    assert got == {k: f"pair own {k}" if k < 3 else f"single {k} single {k} too own {k}" for k in range(16)}


STORY = "{0} went where {0} had been, and {0} said so to all of them who asked for it. " * 3


def test_a_teaser_is_not_the_page(spark, scratch):
    """A story in a part for it stays, a short article beside it does not stand for the page."""
    page = "<div class=top>Site name</div><div id=content><p>{0}</p></div><article><p>read {1} next</p></article>"
    rows = [(k, f"http://h{k % 3}.example/{k}", page.format(STORY.format(f"who{k}"), k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in sitestyle.extract(df, scratch).collect()}
    assert got == {k: STORY.format(f"who{k}").strip() for k in range(60)}


def test_hosts_without_articles(spark, scratch):
    """No element says what it is: on each of several hosts the tree alone finds the story."""
    page = "<div class=q1>Name of {1}</div><div class=q2><p>{0}</p><p>{0} again</p></div><div class=q3><p>all of {1}</p><p>since 1999</p></div>"
    rows = [(k, f"http://h{k % 4}.example/{k}", page.format(STORY.format(f"who{k}"), k % 4)) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in sitestyle.extract(df, scratch).collect()}
    assert got == {k: " ".join([STORY.format(f"who{k}").strip(), STORY.format(f"who{k}"), "again"]).replace("  ", " ") for k in range(80)}


def test_deep_nesting_is_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert [t for _, t in sitestyle.settle(sitestyle.blocks("<div class=a>" * n + "x" + "</section></div>" * n))] == ["x"]
        return time.process_time() - began

    assert seconds(40_000) < 12 * seconds(10_000) + 0.5
