"""HTML elements as an array column.

Tree structure is the one thing the built-in functions cannot express, so one
Arrow stage turns a page into its text and its elements: numbered in document
order, each with the number of its last descendant, the bytes of the text it
covers, and the described ancestors it stands under. So the output grows with the
page, however deep its elements are nested, and a rule cuts the text of those
elements only that it looks at. Elements leave Python some pages at a time, however
many pages Spark hands over at once. The array stays on the row of its page: rules over
it need no join and no shuffle, and only elements some rule can use leave the stage.
"""

from __future__ import annotations

import html as _html
import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import settled
from storefront.functions.markup import (
    ATTRIBUTES,
    BOGUS_COMMENT,
    CLOSE,
    COMMENT,
    NAME_END,
    raw_element,
)
from storefront.params import WHITESPACE

# Executors get this module with the function that uses it; nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text offsets are bytes: ``from`` and ``to`` of all text, ``head`` and ``tail`` without outer space.
NODE_TYPE = (
    "struct<text:binary,nodes:array<struct<node:int,last:int,beg:int,end:int,tag:string,"
    "cls:array<string>,attrs:map<string,string>,under:array<string>,from:int,to:int,head:int,tail:int>>>"
)
_ARROW_TYPE = pa.struct(
    [
        ("text", pa.binary()),
        (
            "nodes",
            pa.list_(
                pa.struct(
                    [
                        ("node", pa.int32()),
                        ("last", pa.int32()),
                        ("beg", pa.int32()),
                        ("end", pa.int32()),
                        ("tag", pa.string()),
                        ("cls", pa.list_(pa.string())),
                        ("attrs", pa.map_(pa.string(), pa.string())),
                        ("under", pa.list_(pa.string())),
                        ("from", pa.int32()),
                        ("to", pa.int32()),
                        ("head", pa.int32()),
                        ("tail", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)
# What the stage holds as Python objects, at least one row: then those rows leave as Arrow.
HELD_ELEMENTS = 10_000
HELD_CHARS = 4_000_000
_BLANKS = re.compile(b"(?:" + b"|".join(re.escape(c.encode()) for c in WHITESPACE) + b")+")


@dataclass(frozen=True)
class Interest:
    """Which elements leave the stage: by tag, class or attribute name.

    ``shown`` are further attributes to carry, ``outers`` the ancestors that
    elements are told to stand under. Without any, all elements and all attributes
    are kept.
    """

    tags: frozenset = field(default_factory=frozenset)
    classes: frozenset = field(default_factory=frozenset)
    attrs: frozenset = field(default_factory=frozenset)
    shown: frozenset = field(default_factory=frozenset)
    outers: frozenset = field(default_factory=frozenset)

    def __or__(self, other: Interest) -> Interest:
        return Interest(
            self.tags | other.tags,
            self.classes | other.classes,
            self.attrs | other.attrs,
            self.shown | other.shown,
            self.outers | other.outers,
        )

    @property
    def everything(self) -> bool:
        return not (self.tags or self.classes or self.attrs)

    def likely(self) -> re.Pattern:
        """Found in the attributes of every element kept for a class or attribute name.

        Tells most tags apart without reading their attributes one by one; a
        character reference may spell anything, so it counts as likely.
        """
        words = sorted(self.classes | self.attrs)
        return re.compile("|".join([*map(re.escape, words), "&"]), re.IGNORECASE)


# Fixed values of the HTML standard: elements without an end tag, and start
# tags that end an open element of the same kind.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_ENDS_OPEN = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "p": ("p",),
}
_RAW = "script|style|title|textarea|iframe|xmp|noframes|noembed"
# 1 raw element, 2 end tag, 3 start tag, 4 its attributes
_TOKEN = re.compile(
    rf"(?is)<(?:{COMMENT}|{raw_element(_RAW)}|/([a-z][^\t\n\f\r />]*+){ATTRIBUTES}{CLOSE}"
    rf"|([a-z][^\t\n\f\r />]*+)({ATTRIBUTES}){CLOSE}|{BOGUS_COMMENT})",
    re.ASCII,
)
_RAW_PARTS = re.compile(
    rf"(?is)^<[a-z]+{NAME_END}({ATTRIBUTES}){CLOSE}(.*?)(?:</[a-z]+{NAME_END}[^>]*+{CLOSE})?\Z",
    re.ASCII,
)
_ATTRIBUTE = re.compile(
    r"""[\t\n\f\r /]*+([^\t\n\f\r />][^\t\n\f\r />=]*+)"""
    r"""(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)"?|'([^']*+)'?|([^\t\n\f\r >]*+)))?+"""
)
_WORD = re.compile(r"[^\t\n\f\r ]+")
_ATTR_REFERENCE = re.compile(
    r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![=a-zA-Z0-9])))"
)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or m[3] or m[4] or ""
        if "&" in value:
            value = _ATTR_REFERENCE.sub(lambda r: _html.unescape(r[0]), value)
        found.setdefault(m[1].lower(), value)
    return found


def parse_nodes(page: str, interest: Interest) -> tuple[bytes, list[dict]]:
    """The text of one page and its elements in document order."""
    kept: list[dict] = []
    texts: list[bytes] = []
    length = 0
    open_elements: list[tuple[str, dict | None]] = []
    open_tags: Counter[str] = Counter()  # an end tag without an open partner costs one look
    open_outers: Counter[str] = Counter()
    count = 0
    keep_all = interest.everything
    is_likely = interest.likely().search
    shown = interest.attrs | interest.shown
    # described ancestors by the class, attribute or tag that tells them first
    by_hint: dict[tuple[str, str], list[Sel]] = {}
    for sel in interest.outers:
        by_hint.setdefault(sel.hint, []).append(sel)
    under: list[str] = []  # which of them are open; a new list whenever that changes

    def add_text(piece: str) -> None:
        nonlocal length
        if piece:
            texts.append(piece.encode())
            length += len(texts[-1])

    def note_open() -> None:
        nonlocal under
        now = sorted(key for key, n in open_outers.items() if n)
        under = under if now == under else now

    def start(tag: str, source: str, at: int) -> dict | None:
        nonlocal count
        count += 1
        if not (keep_all or tag in interest.tags or is_likely(source)):
            return None
        attrs = _attributes(source)
        classes = _WORD.findall(attrs.get("class", ""))
        if not (
            keep_all
            or tag in interest.tags
            or not interest.classes.isdisjoint(classes)
            or not interest.attrs.isdisjoint(attrs)
        ):
            return None
        node = {
            "node": count - 1,
            "beg": at,
            "tag": tag,
            "cls": classes,
            "attrs": [(k, v) for k, v in attrs.items() if keep_all or k in shown],
            "under": under,
            "from": length,
        }
        hints = [("tag", tag), *(("class", c) for c in classes), *(("attr", a) for a in attrs)]
        described = {sel.key for h in hints if h in by_hint for sel in by_hint[h] if sel.matches(tag, classes, attrs, under)}
        if described:
            node["is"] = described
            open_outers.update(described)
            note_open()
        kept.append(node)
        return node

    def close(node: dict | None, at: int) -> None:
        if node is not None:
            node["last"], node["end"], node["to"] = count - 1, at, length
            if "is" in node:
                open_outers.subtract(node.pop("is"))
                note_open()

    def close_last(at: int) -> None:
        tag, node = open_elements.pop()
        open_tags[tag] -= 1
        close(node, at)

    def close_to(depth: int, at: int) -> None:
        while len(open_elements) > depth:
            close_last(at)

    position = 0
    for m in _TOKEN.finditer(page):
        before = page[position : m.start()]
        add_text(_html.unescape(before) if "&" in before else before)
        position = m.end()
        if m[1]:
            tag = m[1].lower()
            attrs, inner = _RAW_PARTS.match(m[0]).groups()
            node = start(tag, attrs, m.start())
            decoded = tag in ("title", "textarea") and "&" in inner
            add_text(_html.unescape(inner) if decoded else inner)
            close(node, position)
        elif m[2]:
            tag = m[2].lower()
            if open_tags[tag]:
                while open_elements[-1][0] != tag:
                    close_last(m.start())
                close_last(position)
        elif m[3]:
            tag = m[3].lower()
            ended = _ENDS_OPEN.get(tag, ())
            while open_elements and open_elements[-1][0] in ended:
                close_last(m.start())
            node = start(tag, m[4], m.start())
            if tag in _VOID:
                close(node, position)
            else:
                open_elements.append((tag, node))
                open_tags[tag] += 1
    rest = page[position:]
    add_text(_html.unescape(rest) if "&" in rest else rest)
    close_to(0, len(page))

    text = b"".join(texts)
    blanks = [m.span() for m in _BLANKS.finditer(text)]
    begins = [b for b, _ in blanks]
    for node in kept:
        head, tail = node["from"], node["to"]
        run = bisect_right(begins, head) - 1
        if run >= 0 and head < blanks[run][1]:
            head = min(blanks[run][1], tail)
        run = bisect_right(begins, tail - 1) - 1
        if head < tail and run >= 0 and tail <= blanks[run][1]:
            tail = blanks[run][0]
        node["head"], node["tail"] = head, tail
    return text, kept


def html_nodes_each(pages: Mapping[str, tuple[Column, Interest]]) -> Column:
    """``STRUCT`` of ``html_nodes`` of several columns by name, from one Python stage."""
    interests = {name: interest for name, (_, interest) in pages.items()}
    kind = pa.struct([(name, _ARROW_TYPE) for name in pages])

    @F.arrow_udf(f"struct<{','.join(f'{name}:{NODE_TYPE}' for name in pages)}>")
    def nodes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            rows, elements, chars = [], 0, 0
            for sources in zip(*columns, strict=True):
                row = {}
                for (name, interest), source in zip(interests.items(), sources, strict=True):
                    page = source.as_py() or ""
                    text, found = parse_nodes(page, interest)
                    row[name] = {"text": text, "nodes": found}
                    elements, chars = elements + len(found), chars + len(page)
                rows.append(row)
                if elements >= HELD_ELEMENTS or chars >= HELD_CHARS:
                    yield pa.array(rows, type=kind)
                    rows, elements, chars = [], 0, 0
            if rows:
                yield pa.array(rows, type=kind)

    return nodes(*(html for html, _ in pages.values()))


def html_nodes(html: Column, interest: Interest = Interest()) -> Column:
    """``STRUCT`` of a page's text and elements (``NODE_TYPE``), empty for a null page."""
    return html_nodes_each({"page": (html, interest)})["page"]


def cut_text(page: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` of the text of a page: no other part of it is looked at."""
    return F.substr(page["text"], start + 1, end - start).cast("string")


def node_text(node: Column, page: Column) -> Column:
    """Text of an element without outer space."""
    return cut_text(page, node["head"], node["tail"])


def node_rows(
    pages: DataFrame, by: Sequence[str], html: str = "html", interest: Interest = Interest()
) -> DataFrame:
    """The elements as a table ``(*by, node, last, beg, end, tag, cls, attrs, text)``."""
    parsed = settled(pages.select(*by, html_nodes(F.col(html), interest).alias("_page")))
    rows = parsed.select(*by, "_page", F.explode("_page.nodes").alias("_node"))
    node = F.col("_node")
    return rows.select(
        *by,
        *(node[c].alias(c) for c in ("node", "last", "beg", "end", "tag", "cls", "attrs")),
        cut_text(F.col("_page"), node["from"], node["to"]).alias("text"),
    )


@dataclass(frozen=True)
class Sel:
    """What an element must be: tag, classes, attribute tests, an ancestor.

    An attribute test is ``(name, op, value)`` with op ``has``, ``=``, ``^=``
    (starts with) or ``*=`` (contains).
    """

    tag: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    without: tuple[str, ...] = ()
    within: Sel | None = None

    @cached_property
    def hint(self) -> tuple[str, str]:
        """The class, attribute or tag that any such element has."""
        if self.classes:
            return "class", self.classes[0]
        return ("attr", self.attrs[0][0]) if self.attrs else ("tag", self.tag or "")

    @cached_property
    def key(self) -> str:
        """By what an element that stands under such a one tells so."""
        return repr((self.tag, self.classes, self.attrs, self.without, self.within and self.within.key))

    def matches(self, tag: str, classes: list[str], attrs: dict[str, str], under: list[str]) -> bool:
        return (
            (self.tag is None or self.tag == tag)
            and all(c in classes for c in self.classes)
            and not any(c in classes for c in self.without)
            and all(_ATTR_TESTS[op](attrs.get(name), want) for name, op, want in self.attrs)
            and (self.within is None or self.within.key in under)
        )

    def interest(self) -> Interest:
        """The narrowest single key that finds this element, and its ancestor's."""
        names = frozenset(name for name, _, _ in self.attrs)
        kind, hint = self.hint
        if kind == "class":
            own = Interest(classes=frozenset([hint]), shown=names)
        elif kind == "attr":
            own = Interest(attrs=names)
        else:
            own = Interest(tags=frozenset([hint]))
        return own | self.within.interest() | Interest(outers=frozenset([self.within])) if self.within else own


_ATTR_TESTS = {
    "has": lambda have, want: have is not None,
    "=": lambda have, want: have == want,
    "^=": lambda have, want: have is not None and have.startswith(want),
    "*=": lambda have, want: have is not None and want in have,
}


def interest_of(sels: Iterable[Sel], shown: Iterable[str] = ()) -> Interest:
    interest = Interest(shown=frozenset(shown))
    for sel in sels:
        interest = interest | sel.interest()
    return interest


def node_attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def inside(node: Column, ancestor: Column) -> Column:
    return (node["node"] > ancestor["node"]) & (node["node"] <= ancestor["last"])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", r"\\").replace("'", r"\'") + "'"


def _attr_test(node: str, name: str, op: str, want: str) -> str:
    have = f"try_element_at({node}.attrs, {_quoted(name)})"
    return {
        "has": f"{have} IS NOT NULL",
        "=": f"{have} = {_quoted(want)}",
        "^=": f"startswith({have}, {_quoted(want)})",
        "*=": f"contains({have}, {_quoted(want)})",
    }[op]


def _predicate(sel: Sel, node: str) -> str:
    """SQL test whether a node is what ``sel`` describes; null counts as no."""
    tests = [] if sel.tag is None else [f"{node}.tag = {_quoted(sel.tag)}"]
    tests += [f"array_contains({node}.cls, {_quoted(c)})" for c in sel.classes]
    tests += [f"NOT array_contains({node}.cls, {_quoted(c)})" for c in sel.without]
    tests += [_attr_test(node, *test) for test in sel.attrs]
    if sel.within is not None:
        tests.append(f"array_contains({node}.under, {_quoted(sel.within.key)})")
    return " AND ".join(tests) or "true"


def select_nodes(nodes: str, sels: Sequence[Sel]) -> Column:
    """Nodes of the array ``nodes`` that match any of the descriptions, in document order.

    The array must come from ``html_nodes`` with the ``interest_of`` these descriptions.
    One SQL expression per call: a rule table compares many fields, and building
    each comparison as a Column would cost far more than parsing the text.
    """
    either = " OR ".join(f"({_predicate(sel, 'n')})" for sel in sels)
    return F.expr(f"filter({nodes}, n -> {either})")
