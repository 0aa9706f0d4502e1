"""Hostile and odd markup: nothing of an article is lost, and time grows with a page's length (four times the page: below nine times the time)."""

import time

import pytest

from pagegraph.llm import html_extract


def text(source):
    return html_extract.content(html_extract.parse(source), set())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p title=it's>One</p><p>Two don't</p><p>Three</p>", "One Two don't Three"),
        ('<div class="layout has-sidebar"><article><p>x</p></article></div>', "x"),
        ('<div class="sidebar"><article><p>only</p></article></div>', "only"),
        ('<div id="comments"><article><p>reader</p></article></div><article><p>writer</p></article>', "writer"),
        ('<article><p class="social">a</p><p id="comment-law">b</p><h2 id="menu">c</h2><div class="share-buttons">d</div><p class="ad">e</p></article>', "a b c"),
        ('<article><div class="cookie-notice">a</div><div class="noticeboard">b</div><div id="side_bar-comment">c</div></article>', "b c"),
        ("<article><p a=\"x>y</p><p>z</p></article>", "y z"),
        ("<article><p a='b>c' d=e/>f<p>g", "f g"),
        ("<article><a href=x?a=b&c='d'>l</a> <b>m</b", "l m</b"),
        ("<article>5 < 6 <7 </ 8 <p>9", "5 < 6 <7 </ 8 9"),
        ("<article><![CDATA[raw]]> <?php x ?>y<!doctype z>", "raw y"),
        ("<article><P CLASS=AD>no</P><p>yes", "yes"),
    ],
)
def test_nothing_of_the_article_is_lost(source, want):
    assert text(source) == want


UNITS = ['<a "', "<a b='", '<a b="x', "</x ", '<a b=">" ', "<a '", "</script ", "<a b='\"> ", "< a", "<a/", "<a =", "<![CDATA[", "<!", "<a b= ", "<b>", "<div><b></q></p>", "<p><b><p>", "<li><ul>", "<td><table>", "<script>", "<textarea></text"]


@pytest.mark.parametrize("unit", UNITS)
def test_time_grows_with_length(unit):
    def seconds(n):
        best = 1e9
        for _ in range(3):
            start = time.process_time()
            root = html_extract.parse(unit * n)
            html_extract.content(root, set())
            best = min(best, time.process_time() - start)
        return best

    assert seconds(16_000) < 9 * max(seconds(4_000), 0.01)


def test_deep_pages_have_digests_in_linear_time():
    root = html_extract.parse("<b>x " * 20_000)
    start = time.process_time()
    _, nodes = html_extract.skeleton(root)
    own = html_extract.digests(root, nodes)
    assert len(set(own)) == 20_000 and own[0] == own[1] and time.process_time() - start < 5


def test_digests_are_of_the_words():
    def of(source):
        root = html_extract.parse(source)
        return html_extract.digests(root, [c for c in root.children if not isinstance(c, str)])

    assert of("<p>a  <b>b</b> c</p><p>a b c</p><p>a b</p><p> </p><p>c</p>")[:2] == of("<p>a b c</p>") * 2
    assert len(set(of("<p>a b</p><p>b a</p><p>ab</p><p>a</p><p></p>"))) == 5


def test_siblings_beyond_eight_are_aligned_one_by_one(spark):
    """A notice without a telling name goes whatever the number of paragraphs around it."""
    for n in (3, 7, 9, 40):
        pages = [(i, f"http://a.org/{i}", "<article>" + "".join(f"<p>Story {i} {k}</p>" for k in range(n)) + "<p>Read more on our site</p>" + f"<p>End {i}</p></article>") for i in range(6)]
        got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert got == {i: " ".join(f"Story {i} {k}" for k in range(n)) + f" End {i}" for i in range(6)}
