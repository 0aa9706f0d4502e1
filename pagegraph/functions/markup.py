"""Markup operators that need loops over a text: Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import html
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .spans import replace_outside

# Types, not type strings: workers import this module too, and have no session to parse them.
_TEXT = Ty.StringType()

# ----------------------------------------------------------------- tree of a page

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RESET = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOP = {"ul", "ol", "dl", "table", "body", "html", "div", "select"}


class _Rows(HTMLParser):
    """Rows (node, parent, depth, tag, attributes, text) of a tolerant parse."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, int, str, dict, str]] = []
        self.stack: list[tuple[int, str]] = [(-1, "")]

    def _add(self, tag: str, attributes: dict, text: str) -> int:
        self.rows.append((len(self.rows), self.stack[-1][0], len(self.stack) - 1, tag, attributes, text))
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        shut = _RESET.get(tag, set())
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][1] in shut:
                del self.stack[i:]
                break
            if self.stack[i][1] in _STOP:
                break
        node = self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in _VOID:
            self.stack.append((node, tag))

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, "")

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self._add("#text", {}, data)


def node_rows(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per element and text of each page: key, node, parent, depth, tag, attributes, text."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                p = _Rows()
                p.feed(t or "")
                p.close()
                out += [(k, *r) for r in p.rows]
            yield pd.DataFrame(out, columns=["k", "node", "parent", "depth", "tag", "attributes", "text"])

    few = pages.select(F.col(key).alias("k"), F.col(source).alias("t"))
    return few.mapInPandas(run, f"k {kind}, node int, parent int, depth int, tag string, attributes map<string,string>, text string").withColumnRenamed("k", key)


def element_counts(pages: DataFrame, tags: tuple[str, ...], key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, n): how many elements of each tag a page's tree has, as a struct; no shuffle."""

    @F.pandas_udf(Ty.StructType([Ty.StructField(t, Ty.LongType()) for t in tags]))
    def count(series: pd.Series) -> pd.DataFrame:
        out = []
        for t in series:
            p = _Rows()
            p.feed(t or "")
            p.close()
            n = Counter(r[3] for r in p.rows)
            out.append([n[x] for x in tags])
        return pd.DataFrame(out, columns=list(tags))

    return pages.select(key, count(F.col(source)).alias("n"))


def find_all(nodes: DataFrame, tag: str | None = None, attribute: str | None = None, value: str | None = None, pattern: str | None = None) -> DataFrame:
    """Nodes by tag, attribute, attribute's value or text pattern."""
    out = nodes
    if tag:
        out = out.where(F.col("tag") == tag)
    if attribute:
        got = F.try_element_at("attributes", F.lit(attribute))
        out = out.where(got.isNotNull() if value is None else got == value)
    return out.where(F.col("text").rlike(pattern)) if pattern else out


def children(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """Children of nodes."""
    return nodes.join(of.select(key, F.col("node").alias("parent")).distinct(), [key, "parent"], "left_semi")


def parents(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    return nodes.join(of.select(key, F.col("parent").alias("node")).distinct(), [key, "node"], "left_semi")


def siblings(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes with a parent in common with the given ones, these too."""
    return nodes.join(of.select(key, "parent").distinct(), [key, "parent"], "left_semi")


@F.pandas_udf(_TEXT)
def prettify(source: pd.Series) -> pd.Series:
    """The parsed tree, indented, with every element closed."""

    def one(t: str | None) -> str:
        p = _Rows()
        p.feed(t or "")
        p.close()
        out: list[str] = []
        open_: list[tuple[int, str]] = []
        for _, _, depth, tag, attributes, text in p.rows:
            while open_ and open_[-1][0] >= depth:
                d, was = open_.pop()
                out.append(" " * d + f"</{was}>")
            if tag == "#text":
                out.append(" " * depth + html.escape(text.strip(), quote=False))
            else:
                out.append(" " * depth + f"<{tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in attributes.items()) + (" />" if tag in _VOID else ">"))
                if tag not in _VOID:
                    open_.append((depth, tag))
        while open_:
            d, was = open_.pop()
            out.append(" " * d + f"</{was}>")
        return "\n".join(out)

    return source.map(one, na_action=None)


def without_nodes(pages: DataFrame, tags: list[str], source: str = "html") -> DataFrame:
    """The pages with elements of some tags cut out, whatever they enclose."""
    drop = frozenset(tags)

    @F.pandas_udf(_TEXT)
    def cut(series: pd.Series) -> pd.Series:
        def one(t):
            out, depth, at = [], 0, 0
            for m in re.finditer(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^>]*?(/?)>", t or ""):
                if m[2].lower() not in drop:
                    continue
                if not m[1]:
                    if depth == 0:
                        out.append(t[at : m.start()])
                    if not m[3] and m[2].lower() not in _VOID:
                        depth += 1
                    at = m.end() if depth == 0 else at
                elif depth:
                    depth -= 1
                    at = m.end() if depth == 0 else at
            return "".join(out) + ("" if depth else (t or "")[at:])

        return series.map(one)

    return pages.withColumn(source, cut(F.col(source)))


# ----------------------------------------------------------------- protected spans


def replace_except(old: str, new: str, exceptions: tuple[str, ...]):
    """A UDF that replaces a pattern outside protected spans; `\\1` refers to groups."""
    return replace_outside(old, new, exceptions)


def is_disabled(text, place):
    """Whether a position (from 0) lies in a comment or a disabled element."""
    from .text import DISABLED

    marked = F.concat(F.substring(text, F.lit(1), place), F.lit("\x01"), F.substring(text, place + 1, F.lit(1 << 30)))
    return ~F.contains(F.regexp_replace(marked, DISABLED, ""), F.lit("\x01"))


# ----------------------------------------------------------------- tables, wikitext, similarity


_TABLE_TAG = re.compile(r"(?i)<(/?)table\b[^>]*>")


def _table_spans(t: str) -> list[tuple[int, int]]:
    """The outermost HTML tables, by depth, in one pass."""
    depth, start, out = 0, 0, []
    for m in _TABLE_TAG.finditer(t):
        if not m[1]:
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append((start, m.end()))
    return out


def _with_tables(t: str, around: str = "") -> tuple[str, int, int]:
    """A text with its tables in wiki markup, how many they are, and the warnings; time is in proportion to the text and the depth of tables."""
    out, at, warnings, spans = [], 0, 0, _table_spans(t)
    for a, b in spans:
        new, n = _convert_table(t[a:b])
        out += [t[at:a], around, new, around]
        at, warnings = b, warnings + n
    return "".join([*out, t[at:]]), len(spans), warnings


def _convert_table(t: str) -> tuple[str, int]:
    """Wiki markup of one HTML table (nested ones first) and the number of warnings."""
    inner = re.sub(r"(?is)^<table\b([^>]*)>(.*)</table>$", r"\2", t)
    attributes = re.sub(r"(?is)^<table\b([^>]*)>.*$", r"\1", t).strip()
    inner, _, warnings = _with_tables(inner, "\n")
    inner = re.sub(r"(?i)</?(?:tbody|thead|tfoot)\b[^>]*>", "", inner)
    inner = re.sub(r"(?is)<caption\b[^>]*>(.*?)</caption>", lambda m: "\n|+ " + m[1].strip(), inner)
    inner = re.sub(r"(?i)<tr\b([^>]*)>", lambda m: "\n|-" + (" " + m[1].strip() if m[1].strip() else ""), inner)
    blank = r"(?:\s*(?=\n\{\|)|\s*)"  # a nested table stays on a line of its own
    inner = re.sub(rf"(?i)<th\b([^>]*)>{blank}", lambda m: "\n! " + (m[1].strip() + " | " if m[1].strip() else ""), inner)
    inner = re.sub(rf"(?i)<td\b([^>]*)>{blank}", lambda m: "\n| " + (m[1].strip() + " | " if m[1].strip() else ""), inner)
    inner = re.sub(r"(?i)\s*</(?:td|th|tr)\s*>", "", inner)
    warnings += len(re.findall(r"(?i)</?(?:td|th|tr)\b", inner)) + (not re.search(r"\n[|!] ", inner))
    inner = re.sub(r"\n\s*\n+", "\n", inner)
    return "{|" + (" " + attributes if attributes else "") + "\n" + inner.strip("\n") + "\n|}", warnings


@F.pandas_udf(Ty.StructType([Ty.StructField("text", _TEXT), Ty.StructField("tables", Ty.IntegerType()), Ty.StructField("warnings", Ty.IntegerType())]))
def tables_to_wiki(series: pd.Series) -> pd.DataFrame:
    """Every HTML table outside comments and nowiki in wiki markup."""
    out = []
    for t in series:
        hidden: list[str] = []

        def hide(m, hidden=hidden):
            hidden.append(m[0])
            return f"\x02{len(hidden) - 1}\x03"

        text = re.sub(r"(?is)<!--.*?-->|<nowiki>.*?</nowiki>", hide, t or "")
        text, tables, warnings = _with_tables(text)
        out.append((re.sub(r"\x02(\d+)\x03", lambda m, hidden=hidden: hidden[int(m[1])], text), tables, warnings))
    return pd.DataFrame(out, columns=["text", "tables", "warnings"])


@F.pandas_udf(_TEXT)
def html_cleanup(series: pd.Series) -> pd.Series:
    """Presentational HTML to wiki markup and CSS, repeated until nothing changes."""
    rules = [
        (re.compile(r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>"), r"'''\1'''"), (re.compile(r"(?is)<(?:i|em)>(.*?)</(?:i|em)>"), r"''\1''"), (re.compile(r"(?i)<br\s*>"), "<br />"), (re.compile(r"(?i)<hr\s*/?>"), "\n----\n"),
        (re.compile(r"(?is)<font\s+color=[\"']?([#\w]+)[\"']?\s*>(.*?)</font>"), r'<span style="color:\1">\2</span>'), (re.compile(r"(?is)<center>(.*?)</center>"), r'<div style="text-align:center">\1</div>'),
        (re.compile(r"(?i)\balign=[\"']?(left|right|center)[\"']?"), r'style="text-align:\1"'), (re.compile(r"(?i)\b(margin|padding):(\S+) \2 \2 \2(?=[;\"])"), r"\1:\2"), (re.compile(r"(?is)<(span|small|big)>\s*</\1>"), ""),
    ]

    def one(t):
        was = None
        while t != was:  # each replacement takes markup away that none brings back
            was = t
            for pattern, new in rules:
                t = pattern.sub(new, t)
        return t

    return series.map(one, na_action="ignore")


_ATTRIBUTES = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=]+))")


def _attributes(t: str) -> str:
    """Attributes of wikitext in HTML, without those that run scripts."""
    found = ((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTES.findall(t))
    return "".join(f' {k}="{html.escape(v)}"' for k, v in found if not k.startswith("on"))


class TableWriter:
    """Wikitext tables in HTML, line by line, nested in cells to any depth; what no mark closes is closed at the end."""

    def __init__(self, out: list[str], inline):
        self.out, self.inline = out, inline
        self.open: list[list] = []  # of each open table: whether a row is open, and which cell

    def cell_end(self) -> None:
        if self.open[-1][1]:
            self.out.append(f"</{self.open[-1][1]}>")
            self.open[-1][1] = None

    def row_end(self) -> None:
        self.cell_end()
        if self.open[-1][0]:
            self.out.append("</tr>")
            self.open[-1][0] = False

    def row(self, attributes: str = "") -> None:
        self.row_end()
        self.out.append(f"<tr{_attributes(attributes)}>")
        self.open[-1][0] = True

    def cell(self, tag: str, text: str) -> None:
        self.cell_end()
        if not self.open[-1][0]:
            self.row()
        attributes, content = self.parts(text)
        self.out.append(f"<{tag}{attributes}>{content}")
        self.open[-1][1] = tag

    def parts(self, text: str) -> tuple[str, str]:
        """What stands before a single bar, unless that is in a link or a template, are attributes."""
        before, bar, after = text.partition("|")
        given = bar and "[[" not in before and "{{" not in before
        return (_attributes(before), self.inline(after.strip())) if given else ("", self.inline(text.strip()))

    def end(self) -> None:
        self.row_end()
        self.out.append("</table>")
        self.open.pop()

    def line(self, line: str) -> str | None:
        """Takes a line; what it is not part of a table is given back."""
        t = line.strip()
        if t.startswith("{|"):
            if self.open and not self.open[-1][1]:
                self.cell("td", "")
            self.out.append(f"<table{_attributes(t[2:])}>")
            self.open.append([False, None])
        elif not self.open:
            return line
        elif t.startswith("|}"):
            self.end()
            if rest := t[2:].strip():
                return self.line(rest) if self.open else rest
        elif t.startswith("|-"):
            self.row(t[2:].lstrip("-"))
        elif t.startswith("|+"):
            self.row_end()
            attributes, content = self.parts(t[2:])
            self.out.append(f"<caption{attributes}>{content}</caption>")
        elif t.startswith("!"):
            for part in re.split(r"!!|\|\|", t[1:]):
                self.cell("th", part)
        elif t.startswith("|"):
            for part in t[1:].split("||"):
                self.cell("td", part)
        elif t and self.open[-1][1]:
            self.out.append("\n" + self.inline(t))
        elif t:
            self.cell("td", t)
        return None


@F.pandas_udf(_TEXT)
def wiki_to_html(series: pd.Series) -> pd.Series:
    """Headings, lists, tables, bold, italics, links, references and paragraphs of wikitext in HTML."""

    def inline(t: str, refs: list[str]) -> str:
        def ref(m):
            refs.append(m[1])
            return f'<sup><a href="#cite{len(refs)}">[{len(refs)}]</a></sup>'

        t = re.sub(r"(?is)<ref\b[^>/]*>(.*?)</ref>", ref, t)
        t = re.sub(r"\[\[([^\]|]+)\|([^\]]+)\]\]", lambda m: f'<a href="/wiki/{m[1].replace(" ", "_")}">{m[2]}</a>', t)
        t = re.sub(r"\[\[([^\]|]+)\]\]", lambda m: f'<a href="/wiki/{m[1].replace(" ", "_")}">{m[1]}</a>', t)
        t = re.sub(r"\[(https?://\S+) ([^\]]+)\]", r'<a href="\1">\2</a>', t)
        return re.sub(r"''(.+?)''", r"<i>\1</i>", re.sub(r"'''(.+?)'''", r"<b>\1</b>", t))

    def one(t):
        out, lists, refs = [], "", []
        table = TableWriter(out, lambda x: inline(x, refs))
        for line in re.sub(r"(?s)<!--.*?-->", "", t or "").split("\n"):
            if table.open or line.lstrip().startswith("{|"):
                if not table.open:
                    out += ["</ul>" if c == "*" else "</ol>" for c in reversed(lists)]
                    lists = ""
                line = table.line(line)
                if line is None:
                    continue
            marks = re.match(r"[*#]*", line)[0]
            same = len([1 for a, b in zip(marks, lists, strict=False) if a == b])
            out += ["</ul>" if c == "*" else "</ol>" for c in reversed(lists[same:])] + ["<ul>" if c == "*" else "<ol>" for c in marks[same:]]
            lists = marks
            head = re.match(r"(={1,6})\s*(.+?)\s*\1\s*$", line)
            if marks:
                out.append(f"<li>{inline(line[len(marks) :].strip(), refs)}</li>")
            elif head:
                out.append(f"<h{len(head[1])}>{inline(head[2], refs)}</h{len(head[1])}>")
            elif line.strip():
                out.append(f"<p>{inline(line.strip(), refs)}</p>")
        while table.open:
            table.end()
        out += ["</ul>" if c == "*" else "</ol>" for c in reversed(lists)]
        if refs:
            out.append("<ol>" + "".join(f'<li id="cite{i + 1}">{r}</li>' for i, r in enumerate(refs)) + "</ol>")
        return "".join(out)

    return series.map(one)


@F.pandas_udf(Ty.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; 0 if either is null."""
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_TEXT)
def text_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff without context lines; empty where nothing changed."""
    return pd.Series(["\n".join([*difflib.unified_diff((s or "").splitlines(), (t or "").splitlines(), n=0, lineterm="")][2:]) for s, t in zip(a, b, strict=True)])


@F.pandas_udf(_TEXT)
def unescape(series: pd.Series) -> pd.Series:
    """All character references decoded."""
    return series.map(html.unescape, na_action="ignore")


@F.pandas_udf(_TEXT)
def detected_text(body: pd.Series, header: pd.Series) -> pd.Series:
    """Bytes as text by byte order mark, header charset, meta element, UTF-8 and Windows-1252, in this order."""

    def one(b, h):
        if b is None:
            return None
        names = [n for mark, n in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if b.startswith(mark)]
        m = re.search(r"charset=[\"']?([\w-]+)", h or "")
        names += [m[1]] if m else []
        m = re.search(rb"(?i)<meta[^>]*charset=[\"']?([\w-]+)|<\?xml[^>]*encoding=[\"']([\w-]+)", b[:2048])
        names += [(m[1] or m[2]).decode("ascii")] if m else []
        for n in [*names, "utf-8", "windows-1252"]:
            try:
                return b.decode(n)
            except (LookupError, UnicodeDecodeError):
                continue
        return b.decode("latin-1")

    return pd.Series([one(b, h) for b, h in zip(body, header, strict=True)])


@F.pandas_udf(_TEXT)
def first_sentences(series: pd.Series) -> pd.Series:
    """The first paragraph's sentences up to 250 characters; at least one. None of disambiguation and set-index pages."""

    def one(t):
        if re.search(r" id=\"(?:disambigbox|setindexbox)\"", t or ""):
            return ""
        m = re.search(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|\Z)", t or "")
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", m[1])).split()) if m else ""
        out = ""
        for s in re.split(r"(?<=[.!?])\s+", text):
            if out and len(out) + 1 + len(s) > 250:
                break
            out = f"{out} {s}".strip()
        return out

    return series.map(one)


def merged_references():
    """A UDF: equal references once with their content, then by name. Names come from the first named use, the host or a number."""

    @F.pandas_udf(_TEXT)
    def run(series: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            pattern = re.compile(r"(?is)<ref(?:\s+name\s*=\s*[\"']?([^\"'>/]+?)[\"']?\s*)?>(.*?)</ref>")
            uses: dict[str, int] = {}
            names: dict[str, str] = {}
            for m in pattern.finditer(t):
                c = m[2].strip()
                uses[c] = uses.get(c, 0) + 1
                if m[1]:
                    names.setdefault(c, m[1])
            taken = set(names.values())
            for c, n in uses.items():
                if n > 1 and c not in names:
                    h = re.search(r"https?://(?:www\.)?([^/\s\]]+)", c)
                    base = h[1] if h else "auto"
                    k, name = 1, base
                    while name in taken:
                        k, name = k + 1, f"{base}{k + 1}"
                    names[c] = name
                    taken.add(name)
            seen: set[str] = set()

            def put(m):
                c = m[2].strip()
                if uses[c] == 1:
                    return m[0]
                if c in seen:
                    return f'<ref name="{names[c]}" />'
                seen.add(c)
                return f'<ref name="{names[c]}">{c}</ref>'

            return pattern.sub(put, t)

        return series.map(one)

    return run


#: Where a reference's content has a word to name it by, in order of preference; words that are no names; where it has a number.
_NAME_SOURCES = (
    r"\|\s*last\s*=(\w+)",
    r"[Bb][Yy] +[A-Z][a-z]+ +([A-Z][a-z]+)[.,'\"]",
    r"^((?:Mc|)[A-Z][a-z])[,.]",
    r"(?s)\w+://[a-z0-9\-\.]*?([a-z0-9\-]+)\.[a-z\.]{2,6}[ /|=!]",
    r"(?s)^(?:\[\[[^][]+\|)?((?<![{])(?<=\W)\b\w+)[,. ].*?(\d{2,4}\b)",
    r"(?si)\{\{.*?\|(\w*?)\|.*\}\}",
)
_NO_NAMES = frozenset("january february march april may june july august september october november december".split())
_NUMBER_SOURCES = (r"\|\s*(?:pages|page|p|pp)\s*=\s*(\d+)", r"\b(?:pages|page|p|pp|pg)[.:= ]*(\d{1,4})\b[\w\s\.\-<&\]]*", r"\|\s*year\s*=\s*(\d{4})", r"\b(19\d\d|200[0-7])\b", r"\b([mclxvi]*[clxvi]{2,6})(?:\b|\.)")
_DEFAULT_NAME = "autogenerated"


def reference_name(content: str, text: str) -> str:
    """A name for a reference that the text does not hold yet: a word of its content (author, site, first word, template), else its longest capitalised word; then a page, a year or a Roman number, else a count."""
    plain = re.sub(r"accessdate\s*=[^{|}]*|Retrieved [\s\w\[\],]+", " ", content)
    words = (m[1] for p in _NAME_SOURCES if (m := re.search(p, plain)))
    name = next((w for w in words if len(w) > 4 and w.lower() not in _NO_NAMES), None)
    if name is None:
        bare = re.sub(r"\|[^{|}=]+=|\{\{[^{|}]+\||\[\[[^][|]+\|", " ", content)
        name = max([_DEFAULT_NAME, *re.findall(r"\b(?:Mc)?[A-Z][a-z]+\b", bare)], key=len)
    name = name.strip("\t\r\n 0123456789-").lower()
    numbers = (m[1] for p in _NUMBER_SOURCES if (m := re.search(p, plain)))
    if number := next((n for n in numbers if name + n not in text), None):
        return name + number
    k = 1
    while f"{name}{k}" in text:
        k += 1
    return f"{name}{k}"


def with_named_references(t: str) -> str:
    """Unnamed references that occur again get a name and are written once, where that makes the text much shorter: a name and its tags have less than half the content's length."""
    pattern = re.compile(r"(?si)<ref>(.*?)</ref>")
    uses = Counter(m[0] for m in pattern.finditer(t))
    named: dict[str, str] = {}
    for whole, n in uses.items():  # in order of their first use
        if n > 1:
            content = pattern.fullmatch(whole)[1]
            name = reference_name(content, "\n".join([t, *named.values()]))
            if len(content) * 0.5 > len(name) + 8:
                named[whole] = name
    seen: set[str] = set()

    def put(m):
        name = named.get(m[0])
        if name is None:
            return m[0]
        if m[0] in seen:
            return f'<ref name="{name}"/>'
        seen.add(m[0])
        return f'<ref name="{name}">{m[1]}</ref>'

    return pattern.sub(put, t)


def named_references():
    """A UDF of with_named_references."""

    @F.pandas_udf(_TEXT)
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: None if t is None else with_named_references(t))

    return run


@F.pandas_udf(_TEXT)
def with_references_section(series: pd.Series) -> pd.Series:
    """Adds a list of references before external links, categories or the end, if one is missing."""

    def one(t):
        if t is None or not re.search(r"(?i)<ref[ >]", t) or re.search(r"(?i)<references|\{\{\s*(?:reflist|refs)", t):
            return t
        m = re.search(r"(?im)^==+\s*(?:external links|see also|weblinks)\s*==+|^\[\[category:", t)
        at = m.start() if m else len(t)
        return t[:at].rstrip() + "\n\n== References ==\n<references />\n\n" + t[at:]

    return series.map(one)


@F.pandas_udf(Ty.StructType([Ty.StructField(c, _TEXT) for c in ("subject", "label", "description")]))
def dab_line(series: pd.Series) -> pd.DataFrame:
    """The parts of a disambiguation line `* [[Subject|label]], description`."""
    out = []
    for t in series:
        m = re.match(r"^[*#:]+\s*[\"']*\[\[([^\]|]+)(?:\|([^\]]*))?\]\][\"']*\s*[,:–-]?\s*(.*)$", t or "")
        out.append((m[1].strip(), (m[2] or m[1]).strip(), m[3].strip()) if m else (None, None, None))
    return pd.DataFrame(out, columns=["subject", "label", "description"])


@F.pandas_udf(_TEXT)
def apply_action(text: pd.Series, action: pd.Series, needle: pd.Series, value: pd.Series) -> pd.Series:
    """One edit on a text: append, replace, unlink, archive or tag the link of a URL."""
    out = []
    for t, a, n, v in zip(text, action, needle, value, strict=True):
        link = re.compile(r"\[" + re.escape(n or "") + r"(?:\s+([^\]]*))?\]") if n else None
        if t is None or link is None:
            out.append(t)
        elif a == "replace":
            out.append(t.replace(n, v or ""))
        elif a == "unlink":
            out.append(link.sub(lambda m: m[1] or "", t))
        elif a == "archive":
            out.append(link.sub(lambda m, v=v, n=n: f"[{v} {m[1] or n}]", t))
        elif a == "append":
            out.append(link.sub(lambda m, v=v: m[0] + " " + (v or ""), t))
        elif a == "tag":
            out.append(link.sub(lambda m, v=v: m[0] + " {{dead link|date=" + (v or "") + "}}", t))
        else:
            out.append(t)
    return pd.Series(out)


def class_texts(pages: DataFrame, name: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, node, text): all text below each element of a class, at any depth; a page never leaves its row."""

    @F.pandas_udf(Ty.ArrayType(Ty.StructType([Ty.StructField("node", Ty.IntegerType()), Ty.StructField("text", _TEXT)])))
    def collect(series: pd.Series) -> pd.Series:
        out = []
        for t in series:
            p = _Rows()
            p.feed(t or "")
            p.close()
            inside: dict[int, int] = {}
            parts: dict[int, list[str]] = {}
            for node, parent, _, _, attributes, text in p.rows:
                above = inside.get(parent)
                if above is not None or name in attributes.get("class", "").split():
                    inside[node] = node if above is None else above
                    parts.setdefault(inside[node], [])
                    if text:
                        parts[inside[node]].append(text)
            out.append([{"node": n, "text": " ".join(" ".join(x).split())} for n, x in parts.items()])
        return pd.Series(out)

    return pages.select(key, F.explode(collect(F.col(source))).alias("p")).select(key, "p.node", "p.text")
