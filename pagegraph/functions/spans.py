"""Protected spans of wikitext: found from the left, nested ones to the end that matches, as rows; masked by tokens and put back.

At each place the kind that begins first takes its span; what begins inside it is
part of it. Templates and tables nest to any depth: an end belongs to the last
beginning that is still open, and a beginning that nothing ends is no span. Reading
takes time proportional to the text: a kind whose end does not come again is not
looked for again.

Brackets alone are matched by columns too: places of openings and closings are
rows, prefix sums give the depth of each, and at one depth they come in pairs.

Defined results: null texts have no spans and stay null; an unknown kind is an
error; a text may hold the tokens' own characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches

#: Kinds of spans by name: how they begin, and how they end (nothing where the beginning is the whole span).
KINDS: dict[str, tuple[str, str | None]] = {
    "comment": (r"<!--", r"-->"),
    "includeonly": (r"<includeonly>", r"</includeonly>"),
    "math": (r"<math\b[^<>]*>", r"</math>"),
    "noinclude": (r"<noinclude>", r"</noinclude>"),
    "nowiki": (r"<nowiki>", r"</nowiki>"),
    "pre": (r"<pre\b[^<>]*>", r"</pre>"),
    "source": (r"<source\b[^<>]*>", r"</source>"),
    "ref": (r"<ref\b[^<>/]*>", r"</ref>"),
    "timeline": (r"<timeline>", r"</timeline>"),
    "startspace": (r"^ .*$", None),
    "table": (r"^\{\||<table\b[^<>]*>", "nested"),
    "template": (r"\{\{", "nested"),
    "hyperlink": (r"https?://[^\]\s<>\"]*[^\]\s).:;,<>\"]", None),
    "gallery": (r"<gallery\b[^<>]*>", r"</gallery>"),
    "link": (r"\[\[", "]]"),  # with no other closing bracket before its end
    "header": (r"^=[^\n]*=[ \t]*$", None),
    "inputbox": (r"<inputbox>", r"</inputbox>"),
}
#: How nested spans begin and end.
NESTED = {"template": ((r"\{\{", r"\}\}"),), "table": ((r"^\{\|", r"^\|\}"), (r"<table\b[^<>]*>", r"</table\s*>"))}
_FLAGS = re.I | re.M
#: What any kind, and any beginning or end of nested spans, starts with: asked first, as few places have it.
_FIRST, _BRACKETS = r"(?=[<{\[h]|^)", r"(?=[<{|}])"


def matched(t: str, kind: str) -> dict[int, int]:
    """Beginnings of a nested kind with the ends that match them."""
    ends: dict[int, int] = {}
    for begin, end in NESTED[kind]:
        open_: list[int] = []
        for m in re.finditer(f"{_BRACKETS}(?:(?P<begin>{begin})|{end})", t, _FLAGS):
            if m["begin"] is not None:
                open_.append(m.start())
            elif open_:
                ends[open_.pop()] = m.end()
    return ends


@lru_cache(32)
def _openers(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile(f"{_FIRST}(?:{'|'.join(f'(?P<{k}>{KINDS[k][0]})' for k in kinds)})", _FLAGS)


@lru_cache(32)
def _closer(kind: str) -> re.Pattern:
    return re.compile(KINDS[kind][1], re.I)


def spans(t: str, kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans of a text, in order; none overlap."""
    if not kinds:
        return []
    out, at, gone, ends, bracket = [], 0, set(), {}, -1
    opener = _openers(kinds)
    while m := opener.search(t, at):
        kind, end = m.lastgroup, None
        close = KINDS[kind][1]
        if close is None:
            end = m.end()
        elif close == "nested":
            if kind not in ends:
                ends[kind] = matched(t, kind)
            end = ends[kind].get(m.start())
        elif kind == "link":
            if bracket < m.end():
                bracket = t.find("]", m.end())
                bracket = len(t) if bracket < 0 else bracket
            end = bracket + 2 if t.startswith("]]", bracket) else None
        elif kind not in gone:
            if found := _closer(kind).search(t, m.end()):
                end = found.end()
            else:
                gone.add(kind)
        if end is None:
            left = tuple(k for k in kinds if k not in gone)
            if not left:
                break
            opener, at = _openers(left), m.start() + (kind not in gone)
        elif end > m.start():
            out.append((kind, m.start(), end))
            at = end
        else:
            at = m.start() + 1
    return out


def _known(kinds: tuple[str, ...]) -> tuple[str, ...]:
    if unknown := set(kinds) - KINDS.keys():
        raise ValueError(f"no such kinds of spans: {sorted(unknown)}")
    return tuple(kinds)


SPANS = "array<struct<kind: string, start: int, length: int>>"


def protected(*kinds: str):
    """A UDF: the spans of a text as SPANS, starts from 0, in code points; of all kinds if none is named."""
    wanted = _known(kinds or tuple(KINDS))

    @F.pandas_udf(SPANS)
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: None if t is None else [(k, a, b - a) for k, a, b in spans(t, wanted)])

    return run


def replace_outside(old: str, new: str, kinds: tuple[str, ...]):
    """A UDF that replaces a pattern outside protected spans; `\\1` refers to groups."""
    wanted, pattern = _known(kinds), re.compile(old)

    def one(t):
        if t is None:
            return None
        out, at = [], 0
        for _, a, b in spans(t, wanted):
            out += [pattern.sub(new, t[at:a]), t[a:b]]
            at = b
        return "".join([*out, pattern.sub(new, t[at:])])

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(one)

    return run


def span_rows(pages: DataFrame, key: str, text: str, *kinds: str) -> DataFrame:
    """(key, n, kind, start, length, span): a row per span."""
    bounded_batches(pages.sparkSession, 256)
    found = pages.select(key, text, F.posexplode(protected(*kinds)(F.col(text))).alias("n", "s"))
    return found.select(key, "n", "s.kind", "s.start", "s.length", F.substring(F.col(text), F.col("s.start") + 1, F.col("s.length")).alias("span"))


# ----------------------------------------------------------------- tokens

_BEGIN, _END = "\ue000", "\ue001"


def mask(*kinds: str):
    """A UDF: struct<masked, parts>: each span, and each character that tokens are made of, is a token that stands for a part."""
    wanted = _known(kinds or tuple(KINDS))
    marks = re.compile(f"[{_BEGIN}{_END}]")

    def one(t):
        if t is None:
            return None
        parts, out, at = [], [], 0

        def token(part):
            parts.append(part)
            return f"{_BEGIN}{len(parts) - 1}{_END}"

        for _, a, b in spans(t, wanted):
            out += [marks.sub(lambda m: token(m[0]), t[at:a]), token(t[a:b])]
            at = b
        return {"masked": "".join([*out, marks.sub(lambda m: token(m[0]), t[at:])]), "parts": parts}

    @F.pandas_udf("masked string, parts array<string>")
    def run(series: pd.Series) -> pd.DataFrame:
        rows = [one(t) or {"masked": None, "parts": None} for t in series]
        return pd.DataFrame(rows, columns=["masked", "parts"])

    return run


def unmask(masked: Column, parts: Column) -> Column:
    """The text with all tokens put back, wherever they stand now and however often."""
    pieces = F.split(masked, _BEGIN, -1)

    def back(p):
        return F.concat(F.get(parts, F.substring_index(p, _END, 1).cast("int")), F.substring(p, F.locate(_END, p) + 1, F.length(p)))

    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), back)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))


# ----------------------------------------------------------------- brackets as rows


def bracket_spans(pages: DataFrame, key: str, text: str, begin: str = r"\{\{", end: str = r"\}\}") -> DataFrame:
    """(key, depth, start, length) of all bracket pairs of texts with distinct keys, at any depth, by window sums.

    A closing bracket that nothing opens does not count: depths are sums above the least sum so far.
    """
    pattern = f"{begin}|{end}"
    both = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("token"))
    rows = pages.select(key, F.posexplode(both).alias("place", "x")).select(key, "place", F.length("x.gap").alias("gap"), F.col("x.token").alias("token")).where("token is not null")
    w = Window.partitionBy(key).orderBy("place")
    step = F.when(F.col("token").rlike(f"^(?:{begin})$"), 1).otherwise(-1)
    rows = rows.withColumn("step", step).withColumn("stop", F.sum(F.col("gap") + F.length("token")).over(w)).withColumn("sum", F.sum("step").over(w))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("sum").over(w)))
    # The depth that a bracket is of; a closing one that is the least sum so far closes nothing.
    least_before = F.coalesce(F.lag("floor").over(w), F.lit(0))
    rows = rows.withColumn("stray", (F.col("step") < 0) & (F.col("sum") < least_before)).withColumn("depth", F.col("sum") - F.col("floor") + F.when(F.col("step") < 0, 1).otherwise(0))
    pair = Window.partitionBy(key, "depth").orderBy("place")
    kept = rows.where("not stray").withColumn("next_step", F.lead("step").over(pair)).withColumn("next_stop", F.lead("stop").over(pair))
    start = F.col("stop") - F.length("token")
    return kept.where("step > 0 and next_step < 0").select(key, "depth", start.alias("start"), (F.col("next_stop") - start).alias("length"))
