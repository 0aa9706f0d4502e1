"""Wikitext tables in HTML: marks, attributes, nesting, and what is left open or closed too often."""

import time

import pytest

from pagegraph.functions import markup


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{|\n|a\n|}", "<table><tr><td>a</td></tr></table>"),
        ("{| class=x\n|-\n! h !! i\n|-\n| a || b\n|c\n|}", '<table class="x"><tr><th>h</th><th>i</th></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>'),
        ("{|\n|+ align=left | Cap ''x''\n! scope=\"col\" | h || style='y' | i\n|}", '<table><caption align="left">Cap <i>x</i></caption><tr><th scope="col">h</th><th style="y">i</th></tr></table>'),
        ("{|\n| [[A|b]] || {{t|u}} || k=v | c\n|}", '<table><tr><td><a href="/wiki/A">b</a></td><td>{{t|u}}</td><td k="v">c</td></tr></table>'),
        ("{|\n| a\nb\n\nc\n|}", "<table><tr><td>a\nb\nc</td></tr></table>"),
        ("{|\n|\n{|\n|in\n|}\nafter\n|}out", "<table><tr><td><table><tr><td>in</td></tr></table>\nafter</td></tr></table><p>out</p>"),
        ("{|\n{|\n|x\n|}\n|}", "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>"),
        ("{|\nloose\n|}", "<table><tr><td>loose</td></tr></table>"),
        ("{|\n| open", "<table><tr><td>open</td></tr></table>"),
        ("|} a\n| b", "<p>|} a</p><p>| b</p>"),
        ("* li\n{|\n|a\n|}\n* li", "<ul><li>li</li></ul><table><tr><td>a</td></tr></table><ul><li>li</li></ul>"),
        ("{| onclick=x class='<b>'\n|}", '<table class="&lt;b&gt;"></table>'),
        ("{|\n|-\n|-----\n|a\n|}", "<table><tr></tr><tr><td>a</td></tr></table>"),
        ("{|\n|a<ref>r</ref>\n|}", '<table><tr><td>a<sup><a href="#cite1">[1]</a></sup></td></tr></table><ol><li id="cite1">r</li></ol>'),
    ],
)
def test_tables(spark, source, want):
    assert spark.createDataFrame([(source,)], "t string").select(markup.wiki_to_html("t").alias("h")).first().h == want


def test_deep_and_long_tables():
    def seconds(source):
        out = []
        writer = markup.TableWriter(out, lambda x: x)
        start = time.process_time()
        for line in source.split("\n"):
            writer.line(line)
        while writer.open:
            writer.end()
        assert "".join(out).count("<table") == "".join(out).count("</table>")
        return time.process_time() - start

    for unit in ("{|\n|x\n", "{|\n|x\n|}\n", "|a||b\n", "{|\n", "|}\n"):
        assert seconds("{|\n" + unit * 20_000) < 9 * max(seconds("{|\n" + unit * 5_000), 0.01)


def test_many_tables_take_time_in_proportion():
    """A text of very many tables is read once, not once a table."""
    import time

    from pagegraph.functions.markup import _with_tables

    began = time.process_time()
    text, tables, _ = _with_tables("<table><tr><td>a</td></tr></table> b " * 20_000)
    assert tables == 20_000 and text.count("{|") == 20_000 and time.process_time() - began < 15
