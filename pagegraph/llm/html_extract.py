"""Main text of pages by wrapper induction.

Pages of a host are aligned with the host's pivot (its page of least id) by
simple tree matching over their DOM trees. A pivot node whose text is the same on nearly
all aligned pages, and there are enough of different text, is template; what
varies is content. Besides, what markup itself names as menu, header, footer, sidebar, notice,
advert, form, script, style or comment is never content: by tag or role, or by a
class or id that as a whole is such a name (main-menu, but not has-sidebar; of a
paragraph only names of adverts and the like). An article or main is never lost to
the name of a block around it.

Every page becomes a profile (its whole tree and text digests); profiles, not
pages, meet the pivots, votes are added up before and in the shuffle, and a
host's wrapper is no larger than its pivot's tree. Pages meet wrappers in a
broadcast join while the wrappers are small by measure, else in a plain join.

Text is taken from the article (else main, else body), without template nodes
in any of them. Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by one space in page order.

Defined results: null and empty html have empty text; broken markup is read to
its end; a null or hostless URL shares no wrapper; repeated rows stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, ready_checkpoints

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_SKIP = frozenset("script style noscript template iframe xmp noframes nav footer aside form button select textarea input svg canvas head title menu dialog object".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments commentlist disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skip widget".split()
)
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_ENDS_P = _BLOCK - {"body", "html", "option", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dt", "dd", "legend", "summary"}
_SCOPE = frozenset("ul ol dl table div article section main body html nav header footer aside form blockquote td th".split())
_SHORT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th span a b i em strong small q cite code pre blockquote figcaption".split())
#: Of the words above, those that name a paragraph or a phrase too; others name blocks only, as a paragraph may well be about notices.
_PLAIN = frozenset("ad ads advert adverts advertisement advertising sponsored breadcrumb breadcrumbs pagination".split())
#: What a name may hold beside those words, as in main-menu or cookie-box; has-sidebar or comment-law are other names.
_NEUTRAL = frozenset("site page main top bottom left right primary secondary global inner outer box bar block panel section area wrapper container wrap content list item items link links button buttons text".split())

_SIMPLE = re.compile(r"<([A-Za-z][^\s/><]*+)([^<>\"'=]*+(?:=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++)[^<>\"'=]*+)*+)>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    __slots__ = ("tag", "name", "role", "children")

    def __init__(self, tag: str, name: str = "", role: str = ""):
        self.tag, self.name, self.role = tag, name, role
        self.children: list[Node | str] = []

    @property
    def sign(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


class Reader:
    """Tags of a page, one after the other, in time proportional to its length.

    A quote opens a value only behind an equals sign; one that nothing closes belongs to a bare value.
    When a tag has no end outside quotes it ends at the next `>`, and so does every later tag.
    """

    def __init__(self, source: str):
        self.source, self.simple = source, True

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """(name, attributes, closed at once, place behind it) of the start tag at a place; None if none ends."""
        if m := _SIMPLE.match(self.source, at):
            found = {k.lower(): (a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(m[2]))} if m[2] else {}
            return m[1].lower(), found, m[2].endswith("/"), m.end()
        source, pos, found = self.source, _NAME.match(self.source, at + 1).end(), {}
        name, closed = source[at + 1 : pos].lower(), False
        while self.simple and (pos := _SPACE.match(source, pos).end()) < len(source):
            if source[pos] == ">":
                return name, found, source[pos - 1] == "/", pos + 1
            m = _KEY.match(source, pos)
            key, pos, value = m[0].lower(), m.end(), ""
            if m := _EQUALS.match(source, pos):
                pos = m.end()
                quote = source[pos : pos + 1]
                end = source.find(quote, pos + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, pos = source[pos + 1 : end], end + 1
                else:
                    m = _BARE.match(source, pos)
                    value, pos = m[0], m.end()
            found.setdefault(key, value)
        self.simple = False
        end = source.find(">", at)
        return None if end < 0 else (name, {}, closed, end + 1)


def parse(source: str) -> Node:
    """A tree of any markup: unknown ends are ignored, missing ones implied. Time is proportional to the length."""
    root, reader = Node("#root"), Reader(source)
    stack, at, text, end = [root], 0, 0, len(source)
    places: dict[str, list[int]] = {}  # where in the stack nodes of a tag are open
    scopes = [0]  # where in the stack nodes are that close what opens in them

    def close(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()

    def words(until: int) -> None:
        if until > text:
            stack[-1].children.append(html.unescape(source[text:until]))

    while (at := source.find("<", at)) >= 0:
        c = source[at + 1 : at + 2]
        if c in ("!", "?") and c:
            words(at)
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
            elif source.startswith("<![CDATA[", at):
                stop = source.find("]]>", at)
                stack[-1].children.append(source[at + 9 : end if stop < 0 else stop])
                at = end if stop < 0 else stop + 3
            else:
                stop = source.find(">", at)
                at = end if stop < 0 else stop + 1
            text = at
        elif c == "/" and (m := _NAME.match(source, at + 2)):
            stop = source.find(">", m.end())
            if stop < 0:
                break
            words(at)
            at = text = stop + 1
            tag = m[0].lower()
            if (open_ := places.get(tag)) and (open_[-1] >= scopes[-1] or tag not in ("p", "b", "i", "em", "strong", "span", "a", "li")):
                close(open_[-1])
        elif c.isascii() and c.isalpha():
            if (got := reader.tag(at)) is None:
                break
            words(at)
            tag, found, closed, at = got
            text = at
            shut = _CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in _ENDS_P else frozenset())
            if shut and (i := max((places[t][-1] for t in shut if places.get(t)), default=0)) >= scopes[-1] and i:
                close(i)
            node = Node(tag, " ".join(sorted(f"{found.get('class', '')} {found.get('id', '')}".lower().split())), found.get("role", "").lower())
            stack[-1].children.append(node)
            if tag in _VOID or closed:
                continue
            if tag in _RAW:
                shut_tag = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                stop = shut_tag.start() if shut_tag else end
                node.children.append(source[at:stop])
                behind = source.find(">", stop) if shut_tag else -1
                at = text = end if behind < 0 else behind + 1
            else:
                places.setdefault(tag, []).append(len(stack))
                if tag in _SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
        else:
            at += 1
    words(end)
    return root


def named(node: Node) -> bool:
    """Whether a class or an id of a node, as a whole, names boilerplate."""
    if not node.name or node.tag in ("html", "body", "article", "main"):
        return False
    for name in node.name.split():
        parts = [p for p in re.split(r"[_\-]+", name) if p]
        if node.tag in _SHORT:
            if parts and all(p in _PLAIN for p in parts):
                return True
        elif any(p in _WORDS for p in parts) and all(p in _WORDS or p in _NEUTRAL for p in parts):
            return True
    return False


def named_boilerplate(node: Node, inside: bool) -> bool:
    """Whether markup says that a node is not content. inside: of an article, where a header is the article's own."""
    if node.tag in _SKIP or node.role in _ROLES:
        return True
    return not inside if node.tag == "header" else named(node)


def _gather(node: Node, out: list[str], inside: bool, drop: set[int]) -> None:
    work: list[tuple[Node | str | None, bool]] = [(node, inside)]
    while work:
        x, inside = work.pop()
        if x is None:
            out.append("\0")
        elif isinstance(x, str):
            out.append(x.replace("\0", " "))
        elif id(x) in drop or named_boilerplate(x, inside):
            out.append("\0" if x.tag in _BLOCK or x.tag in _SKIP else "")
        elif x.tag == "br" or x.tag == "hr":
            out.append(" ")
        else:
            deeper = inside or x.tag == "article"
            block = x.tag in _BLOCK
            if block:
                out.append("\0")
                work.append((None, inside))
            work += [(c, deeper) for c in reversed(x.children)]


def _outermost(root: Node, tag: str) -> list[Node]:
    """Nodes of a tag outside boilerplate, and outside each other; where there are none, those in blocks that names alone call so."""

    def search(skip) -> list[Node]:
        found, work = [], [root]
        while work:
            for c in work.pop().children:
                if isinstance(c, Node) and c.tag == tag and not any(w in _WORDS for w in c.name.split()):
                    found.append(c)
                elif isinstance(c, Node) and c.tag != tag and not skip(c):
                    work.append(c)
        return found

    return search(lambda x: named_boilerplate(x, False)) or search(lambda x: x.tag in _SKIP or x.role in _ROLES)


def content(root: Node, drop: set[int]) -> str:
    """The text of the article, else of main, else of everything, without boilerplate and template nodes."""
    for tag in ("article", "main"):
        if parts := _outermost(root, tag):
            ids = {id(p) for p in parts}
            out: list[str] = []
            work: list[Node] = [root]
            while work:  # in page order
                x = work.pop()
                if id(x) in ids:
                    _gather(x, out, True, drop)
                    out.append("\0")
                else:
                    work += [c for c in reversed(x.children) if isinstance(c, Node)]
            text = " ".join(" ".join(b.split()) for b in "".join(out).split("\0") if b.strip())
            if text:
                return text
    out = []
    for c in root.children:
        _gather(c, out, False, drop) if isinstance(c, Node) else out.append(c)
    return " ".join(" ".join(b.split()) for b in "".join(out).split("\0") if b.strip())


# ----------------------------------------------------------------- wrappers


def skeleton(root: Node) -> tuple[list, list[Node]]:
    """(tree, nodes): nested [sign, [children]] of the whole page; nodes[i]: the DOM node of tree node i, in preorder."""
    nodes: list[Node] = []
    top: list = [root.sign, []]
    work: list[tuple[Node, list]] = [(root, top)]
    while work:
        node, tree = work.pop()
        nodes.append(node)
        kids = [c for c in node.children if isinstance(c, Node) and c.tag not in ("script", "style", "br")]
        tree[1] = [[k.sign, []] for k in kids]
        work += zip(reversed(kids), reversed(tree[1]), strict=True)
    return top, nodes


def flat(tree: list) -> tuple[list[str], list[int]]:
    """Signs and numbers of children in preorder; JSON of any depth."""
    signs, counts, work = [], [], [tree]
    while work:
        sign, kids = work.pop()
        signs.append(sign)
        counts.append(len(kids))
        work += reversed(kids)
    return signs, counts


class Aligner:
    """Simple tree matching of a tree with others, exact for trees of any width and depth.

    Equal subtrees are one shape, and a pair of shapes is weighed once. Equal first
    and last children are matched at once, as no largest match gains by another
    choice; the rest takes one row of weights at a time, so time grows with the
    product of the two rests and memory with their sum.
    """

    SMALL, TABLE = 64, 1 << 22

    def __init__(self, signs: list[str], counts: list[int]):
        self.known: dict[tuple, int] = {}
        self.sign: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.height: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.root = self._shape(signs, counts)

    def _shape(self, signs: list[str], counts: list[int]) -> int:
        stack: list[int] = []
        for sign, n in zip(reversed(signs), reversed(counts), strict=True):
            kids = tuple(reversed(stack[len(stack) - n :])) if n else ()
            del stack[len(stack) - n :]
            if (at := self.known.get((sign, kids))) is None:
                at = self.known[sign, kids] = len(self.sign)
                self.sign.append(sign)
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))
                self.height.append(1 + max((self.height[k] for k in kids), default=0))
            stack.append(at)
        return stack[0]

    def _ends(self, a: int, b: int) -> tuple[int, int]:
        """How many first and last children are equal."""
        x, y = self.kids[a], self.kids[b]
        n, lo, hi = min(len(x), len(y)), 0, 0
        while lo < n and x[lo] == y[lo]:
            lo += 1
        while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        return lo, hi

    def _rest(self, a: int, b: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        lo, hi = self._ends(a, b)
        return lo, hi, self.kids[a][lo : len(self.kids[a]) - hi], self.kids[b][lo : len(self.kids[b]) - hi]

    def _of(self, a: int, b: int) -> int:
        return self.size[a] if a == b else self.weights.get((a, b), 0)

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...]):
        """Row by row, the largest weights of a prefix of x and all prefixes of y."""
        if len(x) * len(y) <= self.SMALL:
            row = [0] * (len(y) + 1)
            yield row
            for a in x:
                new = [0]
                for j, b in enumerate(y):
                    new.append(max(row[j + 1], new[j], row[j] + self._of(a, b)))
                row = new
                yield row
            return
        shapes, place = np.unique(np.array(y, np.int64), return_inverse=True)
        shapes, weigh = shapes.tolist(), {}
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for a in x:
            if a not in weigh:
                weigh[a] = np.array([self._of(a, b) for b in shapes], np.int64)
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weigh[a][place]), out=new[1:])
            row = new
            yield row

    def _last(self, x: tuple[int, ...], y: tuple[int, ...]):
        for row in self._rows(x, y):
            last = row
        return last

    def _weigh(self, a: int, b: int) -> None:
        """Weights of all pairs of shapes that the pair needs, lower ones first."""
        need, work = set(), [(a, b)]
        while work:
            pair = work.pop()
            if pair in need or pair in self.weights:
                continue
            need.add(pair)
            _, _, x, y = self._rest(*pair)
            by_sign: dict[str, list[int]] = {}
            for d in dict.fromkeys(y):
                by_sign.setdefault(self.sign[d], []).append(d)
            work += [(c, d) for c in dict.fromkeys(x) for d in by_sign.get(self.sign[c], ()) if c != d]
        for p, q in sorted(need, key=lambda pair: self.height[pair[0]]):
            lo, hi, x, y = self._rest(p, q)
            kids = self.kids[p]
            self.weights[p, q] = 1 + sum(self.size[k] for k in (*kids[:lo], *kids[len(kids) - hi :])) + (int(self._last(x, y)[-1]) if x and y else 0)

    def _chosen(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places in x and y of the children that a largest match pairs."""
        out, work = [], [(0, len(x), 0, len(y))]
        while work:
            i0, i1, j0, j1 = work.pop()
            if i0 == i1 or j0 == j1:
                continue
            if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > self.TABLE:  # halves, so that no whole table is held
                mid = (i0 + i1) // 2
                above = np.asarray(self._last(x[i0:mid], y[j0:j1]))
                below = np.asarray(self._last(x[mid:i1][::-1], y[j0:j1][::-1]))[::-1]
                cut = j0 + int(np.argmax(above + below))
                work += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
                continue
            rows = list(self._rows(x[i0:i1], y[j0:j1]))
            i, j = i1 - i0, j1 - j0
            while i and j:
                if rows[i - 1][j] == rows[i][j]:
                    i -= 1
                elif rows[i][j - 1] == rows[i][j]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i0 + i, j0 + j))
        return out

    def pairs(self, signs: list[str], counts: list[int]) -> list[tuple[int, int]]:
        """Preorder numbers of the node pairs of a largest match with a tree."""
        other = self._shape(signs, counts)
        if self.sign[self.root] != self.sign[other]:
            return []
        if self.root != other:
            self._weigh(self.root, other)
        out: list[tuple[int, int]] = []
        work = [(self.root, other, 0, 0)]
        while work:
            a, b, na, nb = work.pop()
            if a == b:
                out += [(na + i, nb + i) for i in range(self.size[a])]
                continue
            out.append((na, nb))
            lo, hi, x, y = self._rest(a, b)
            p, q = self.kids[a], self.kids[b]
            at = [*accumulate((self.size[k] for k in p), initial=na + 1)]
            bt = [*accumulate((self.size[k] for k in q), initial=nb + 1)]
            same = [(i, i) for i in range(lo)] + [(len(p) - i, len(q) - i) for i in range(1, hi + 1)]
            work += [(p[i], q[j], at[i], bt[j]) for i, j in same + [(lo + i, lo + j) for i, j in self._chosen(x, y)]]
        return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching: preorder numbers of the node pairs of a largest match of two trees with equal roots."""
    return Aligner(*flat(a)).pairs(*flat(b))


class Aligners:
    """The aligner of the last pivot is kept, as pages of a host come together; a new one is made when it knows many shapes."""

    def __init__(self):
        self.pivot, self.aligner = None, None

    def of(self, pivot: str) -> Aligner:
        if self.pivot != pivot or len(self.aligner.known) + len(self.aligner.weights) > 1 << 17:
            self.pivot, self.aligner = pivot, Aligner(*json.loads(pivot))
        return self.aligner


_PRIME = (1 << 61) - 1


def digests(root: Node, nodes: list[Node]) -> list[str]:
    """A digest of the words of each node, empty without any; nodes may lie in each other at any depth.

    The page's words, a space behind each, are the digits of one number, to the base of 256; a node's
    digest is its part of that number modulo a prime, from the running values before and behind it.
    """
    n = total = 0
    begun: dict[int, tuple[int, int]] = {}
    found: dict[int, str] = {}
    work: list[Node | str] = [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            if own := x.split():
                data = f"{' '.join(own)} ".encode("utf-8", "replace")
                n += len(data)
                total = (total * pow(256, len(data), _PRIME) + int.from_bytes(data, "big")) % _PRIME
        elif (start := begun.get(id(x))) is None:
            begun[id(x)] = n, total
            work.append(x)
            work += x.children[::-1]
        elif k := n - start[0]:
            found[id(x)] = f"{k:x}.{(total - start[1] * pow(256, k, _PRIME)) % _PRIME:x}"
    return [found.get(id(x), "") for x in nodes]


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def induce_wrappers(pages: DataFrame, id_col: str, host: str, html_col: str, share: float = 0.9, least: int = 4) -> DataFrame:
    """(host, tree, template): the pivot's tree (JSON of flat()) and a JSON map of its constant nodes to their text's digest. Only hosts with such nodes."""

    def profile(batches):
        for b in batches:
            trees, marks, wholes = [], [], []
            for t in _texts(b, "html"):
                tree, nodes = skeleton(parse(t))
                trees.append(json.dumps(flat(tree), separators=(",", ":")))
                own = digests(nodes[0], nodes)
                marks.append(json.dumps(own, separators=(",", ":")))
                wholes.append(own[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(trees, pa.string()), pa.array(marks, pa.string()), pa.array(wholes, pa.string())], names=["host", "id", "tree", "marks", "whole"])

    few = pages.where(f"{host} <> '' and {html_col} is not null").select(F.col(host).alias("host"), F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    profiles = few.mapInArrow(profile, f"host string, id {kind}, tree string, marks string, whole string").groupBy("host", "whole").agg(F.min_by(F.struct("id", "tree", "marks"), F.struct("id", "tree")).alias("p")).select("host", "p.*").checkpoint()  # equal pages vote once
    pivots = profiles.groupBy("host").agg(F.min(F.struct("id", "tree")).alias("p"), F.count("*").alias("pages")).where(F.col("pages") >= least).select("host", F.col("p.tree").alias("pivot")).checkpoint()  # one row a host, so that the join below can split a hot host

    def vote(batches):
        aligners = Aligners()
        for b in batches:
            votes: Counter = Counter()
            for host_, tree, marks, pivot in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                marks = json.loads(marks)
                for at, own in aligners.of(pivot).pairs(*json.loads(tree)):
                    votes[host_, at, marks[own]] += 1
            rows = sorted(votes.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["host", "node", "mark", "n"])

    votes = profiles.join(pivots, "host").select("host", "tree", "marks", "pivot").mapInArrow(vote, "host string, node long, mark string, n long").groupBy("host", "node", "mark").agg(F.sum("n").alias("n"))
    nodes = votes.groupBy("host", "node").agg(F.sum("n").alias("total"), F.max(F.struct("n", "mark")).alias("top"))
    fixed = nodes.where((F.col("total") >= least) & (F.col("top.n") >= share * F.col("total")) & (F.col("top.mark") != "") & (F.col("node") > 0))
    template = fixed.groupBy("host").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("node").cast("string"), "top.mark"))))).alias("template"))  # at most one entry a node of the pivot
    return template.join(pivots, "host").select("host", F.col("pivot").alias("tree"), "template")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    ready_checkpoints(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    few = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    wrappers = induce_wrappers(few, "id", "host", "html").checkpoint()
    size = wrappers.agg(F.sum(F.length("tree") + F.length("template") + F.length("host"))).first()[0] or 0
    joined = few.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left").select("id", "url", "html", "tree", "template")

    def extract(batches):
        aligners = Aligners()
        for b in batches:
            out = []
            for source, tree, template in zip(_texts(b, "html"), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                root, drop = parse(source), set()
                if template:
                    known = json.loads(template)
                    own, nodes = skeleton(root)
                    marks = digests(root, nodes)
                    for at, mine in aligners.of(tree).pairs(*flat(own)):
                        if (mark := known.get(str(at))) and marks[mine] == mark:
                            drop.add(id(nodes[mine]))
                out.append(content(root, drop))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in few.schema}
    return joined.mapInArrow(extract, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_col)

