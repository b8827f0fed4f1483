"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer.

The tree builder closes what a start tag implies is closed (a paragraph before a block, a list item before the next,
a cell before the next cell or row ...), ignores end tags without a start, and knows elements without content. The
renderer leaves out what a reader does not see: head, scripts, styles, templates, comments, ``hidden``,
``display: none`` and ``visibility: hidden`` (which a descendant may lift). Formulas in MathML are read in their place (without
annotations), and each label of an svg stands on a line of its own (without titles, descriptions and definitions). It emits all other text: blanks collapse
(not in ``pre``), blocks stand on lines of their own, paragraphs, headings, lists and tables apart from their
neighbours, list items carry their bullet or number and are indented by depth (up to ``DEEPEST`` levels), and the cells of a table are laid out
like pages of their own, line beside line in columns (up to ``COLUMN`` wide; longer lines are written in full). Style sheets are not read: only
``style`` and ``hidden`` attributes hide.

Defined results: null and empty pages give an empty text; unclosed, stray and wrongly nested tags, malformed declarations, comments and
references never fail. Pages of any length and depth are read whole, in linear time, without recursion. Repeated rows each get their text; other columns pass
through, and one named like the output column is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMN = 60
SPAN = 1000  # columns or rows that a cell may span
DEEPEST = 40  # levels of lists that are indented; text below is indented like those

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object video audio canvas datalist title".split())
# In svg and math: elements in which HTML begins again, and what is not seen. Text of an svg is drawn in two elements only.
HTML_INSIDE = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
UNSEEN_INSIDE = {"svg": frozenset("title desc metadata defs symbol script style".split()), "math": frozenset("annotation annotation-xml".split())}
SVG_TEXT = frozenset("text foreignobject".split())
BREAKOUT = frozenset("""b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small
    span strong strike sub sup table tt u ul var""".split())  # HTML elements that end svg and math around them
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
LINES = frozenset("""html body div section article aside nav header footer main address form li dt dd tr caption figcaption legend
    details summary dialog center option optgroup search hgroup""".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
ENDS_P = APART | (LINES - {"tr", "caption", "li", "dt", "dd", "option", "optgroup", "html", "body"}) | {"li", "dt", "dd"}

# Start tag -> (open elements that it ends, elements beyond which it looks no further).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
}
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_BLANKS = re.compile(r"[\x20\t\n\f\r]+")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_BETWEEN = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SHORT_COMMENT = re.compile(r"<!---?>")
_COMMENT_END = re.compile(r"--!?>")
_LONG_REFERENCE = re.compile(r"&#([xX])?([0-9a-fA-F]{9,})(;?)")
# Elements whose text holds no tags, with what ends them; two of them read character references.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title iframe xmp noembed noframes".split()}
REFERENCES = frozenset(("textarea", "title"))


class Node:
    """``around`` and ``inside`` are svg, math or empty (HTML): what the element belongs to, and its children. ``drawn``: its own text is seen."""

    __slots__ = ("around", "attributes", "children", "drawn", "inside", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []
        self.around = parent.inside if parent else ""
        if tag in HTML_INSIDE:
            self.inside, self.drawn = tag, tag == "math"
        elif self.around and tag not in HTML_INSIDE[self.around]:
            self.inside, self.drawn = self.around, parent.drawn or tag in SVG_TEXT
        else:
            self.inside, self.drawn = "", True


def plain(text: str) -> str:
    """Text with its character references read."""
    return unescape(_LONG_REFERENCE.sub(lambda m: f"&#{m[1] or ''}{m[2].lstrip('0')[:8] or 0}{m[3]}", text)) if "&" in text else text


def attributes_at(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, closed by a slash, place after the tag) of a tag whose name ends at ``at``; -1 if the page ends in it."""
    found: dict[str, str] = {}
    while True:
        start, at = at, _BETWEEN.match(html, at).end()
        if at >= len(html):
            return found, False, -1
        if html[at] == ">":
            return found, at > start and html[at - 1] == "/", at + 1
        name = _NAME.match(html, at)
        at, value = name.end(), ""
        if given := _EQUALS.match(html, at):
            at = given.end()
            if html[at:at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1:end], end + 1
            else:
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
        found.setdefault(name[0].lower(), plain(value))


class Builder:
    """Reads a page from left to right and builds the tree; ``open`` are the elements that have begun and not ended.

    Every step either moves on in the page or ends elements, so time is linear in the page whatever is malformed.
    """

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}  # where each tag's open elements stand in ``open``

    def _pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def _is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _end(self, tags: set[str], limits: set[str]) -> None:
        """End the innermost open element of ``tags`` and all within it, unless a limit comes first."""
        last, limit = (max((own[-1] for t in some if (own := self.places.get(t))), default=-1) for some in (tags, limits))
        if last > 0 and last >= limit:
            while len(self.open) > last:
                self._pop()

    def feed(self, html: str) -> None:
        at = 0
        while at < len(html):
            start = html.find("<", at)
            if start < 0:
                start = len(html)
            if start > at:
                self.handle_data(plain(html[at:start]))
            at = self._markup(html, start) if start < len(html) else start

    def _markup(self, html: str, at: int) -> int:
        """Read what begins with ``<``; returns the place after it."""
        tag = _TAG.match(html, at)
        if tag:
            name = tag[2].lower()
            attributes, slash, after = attributes_at(html, tag.end())
            if after < 0:
                return len(html)  # the page ends within a tag, which is dropped
            if tag[1]:
                self.handle_endtag(name)
                return after
            html_here = not self.open[-1].inside
            (self.handle_startendtag if slash else self.handle_starttag)(name, attributes)
            return self._raw(html, name, after) if name in RAW and html_here else after
        if html.startswith("<!--", at):
            if short := _SHORT_COMMENT.match(html, at):
                return short.end()
            end = _COMMENT_END.search(html, at + 4)
            return end.end() if end else len(html)
        if html.startswith("<![CDATA[", at) and self.open[-1].inside:
            end = html.find("]]>", at)
            self.handle_data(html[at + 9:end if end >= 0 else len(html)])
            return end + 3 if end >= 0 else len(html)
        if html[at + 1:at + 2] in ("!", "?", "/") and len(html) > at + 2:
            end = html.find(">", at + 2)
            return end + 1 if end >= 0 else len(html)
        self.handle_data("<")
        return at + 1

    def _raw(self, html: str, name: str, at: int) -> int:
        """Text of an element that holds no tags, up to its end tag."""
        end = RAW[name].search(html, at)
        stop = end.start() if end else len(html)
        if stop > at:
            self.handle_data(plain(html[at:stop]) if name in REFERENCES else html[at:stop])
        return stop

    def handle_starttag(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            self._end({"head"}, set())
            if tag == "html":
                self.root.attributes |= attributes
                return
            if self._is_open("body"):
                return
        elif tag not in HEAD and self._is_open("head") and tag != "head":
            self._end({"head"}, set())
        if tag in BREAKOUT:
            while self.open[-1].inside:
                self._pop()
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        node = Node(tag, attributes, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attributes: dict[str, str]) -> None:
        self.handle_starttag(tag, attributes)
        if self.open[-1].tag == tag and (tag in HTML_INSIDE or self.open[-1].around):  # elsewhere HTML ignores the slash
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", {})
        elif tag in ("html", "body") or tag in VOID:
            return
        else:
            self._end({tag}, set() if tag in ("table", "head") else {"table", "td", "th"} - {tag})

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class Flow:
    """Text laid out line by line. ``gap`` is the number of line breaks owed before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.blank, self.pending = 0, False, ""

    def breaks(self, n: int) -> None:
        self.gap, self.blank = max(self.gap, n), False

    def line(self) -> None:
        self.gap, self.blank = self.gap + 1, False

    def prefix(self, text: str) -> None:
        """What comes before the next text of a list item; nothing, if there is no text."""
        self.pending = text

    def raw(self, text: str, indent: str) -> None:
        if self.gap and self.parts:
            self.parts.append("\n" * self.gap)
        if self.gap or not self.parts:
            self.parts.append(self.pending or indent)
            self.pending = ""
        elif self.blank:
            self.parts.append(" ")
        self.gap, self.blank = 0, False
        self.parts.append(text)

    def words(self, text: str, indent: str) -> None:
        text = _BLANKS.sub(" ", text)
        if text[:1] == " ":
            self.blank = self.gap == 0 and bool(self.parts)
        if core := text.strip(" "):
            self.raw(core, indent)
            self.blank = text[-1] == " "

    def text(self) -> str:
        return "".join(self.parts).replace("\xa0", " ")


def _number(text: str, least: int, most: int, default: int) -> int:
    found = re.match(r"\s*([+-]?[0-9]{1,9})", text)
    return min(max(int(found[1]), least), most) if found else default


def wide(text: str) -> int:
    """Columns that a text takes: two for characters of double width."""
    return len(text) if text.isascii() else len(text) + sum(unicodedata.east_asian_width(c) in "WF" for c in text)


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table whose cells are (lines, columns, rows spanned): as many for each row as its highest cell has."""
    placed: list[dict[int, list[str]]] = []
    widths: dict[int, int] = {}
    below: dict[int, int] = {}
    for row in rows:
        cells: dict[int, list[str]] = {}
        held, below, at = below, {c: n - 1 for c, n in below.items() if n > 1}, 0
        for lines, across, high in row:
            while at in held:
                at += 1
            cells[at] = lines
            if across == 1:
                widths[at] = max([widths.get(at, 0), *(n for own in lines if (n := wide(own)) <= COLUMN)])
            if high > 1:
                below |= dict.fromkeys(range(at, at + across), high - 1)
            at += across
        placed.append(cells)
    used = sorted({c for cells in placed for c, lines in cells.items() if lines})
    out = []
    for cells in placed:
        shown = [c for c in used if c <= max((c for c, lines in cells.items() if lines), default=-1)]
        for i in range(max((len(lines) for lines in cells.values()), default=0)):
            own = [lines[i] if i < len(lines := cells.get(c, [])) else "" for c in shown]
            out.append("  ".join(t + " " * (widths.get(c, 0) - wide(t)) for c, t in zip(shown, own, strict=True)).rstrip())
    return out


def render(root: Node) -> str:
    """Visible text of a tree. Tables are laid out when they end; ``frames`` holds the flows around them."""
    flow = Flow()
    frames: list[tuple[Flow, list | None, list]] = []
    rows: list[list[tuple[list[str], int, int]]] | None = None
    lists: list[list] = []  # [ordered, next number]
    work: list[tuple] = [("enter", root, True, False)]
    while work:
        what, node, seen, pre = work.pop()
        indent = "  " * min(len(lists), DEEPEST)
        if what == "text":
            if not seen:
                continue
            if not pre:
                flow.words(node, indent)
            else:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        flow.line()
                    if line:
                        flow.raw(line, indent)
            continue
        tag = node.tag
        if what == "leave":
            if tag == "table":
                lines = [*filter(None, flow.text().split("\n")), *aligned(rows)]  # a caption, or text between cells, comes first
                flow, rows, lists = frames.pop()
                indent = "  " * min(len(lists), DEEPEST)
                flow.breaks(1)
                for i, line in enumerate(lines):
                    if i:
                        flow.line()
                    if line:
                        flow.raw(line, indent)
                flow.breaks(2)
            elif tag in ("td", "th") and rows is not None and frames and frames[-1][1] is rows:
                lines = [line.rstrip() for line in flow.text().strip("\n").split("\n")]
                flow, rows, lists = frames.pop()
                if not rows:
                    rows.append([])
                rows[-1].append((lines if any(lines) else [], _number(node.attributes.get("colspan", ""), 1, SPAN, 1), _number(node.attributes.get("rowspan", ""), 1, SPAN, 1)))
            elif tag in ("ul", "ol", "menu") and lists:
                lists.pop()
                flow.breaks(1 if lists else 2)
            elif tag in APART or tag in LINES or (node.around == "svg" and tag in SVG_TEXT):
                flow.breaks(2 if tag in APART else 1)
            continue
        style = node.attributes.get("style", "")
        if node.around == "svg":
            style = ";".join([style, *(f"{name}:{node.attributes[name]}" for name in ("display", "visibility") if name in node.attributes)])
        if tag in UNSEEN or (node.around and tag in UNSEEN_INSIDE[node.around]) or "hidden" in node.attributes or _NONE.search(style):
            continue
        if found := _VISIBILITY.search(style):
            seen = found[1].lower() == "visible"
        pre = pre or tag in ("pre", "textarea")
        if tag == "br":
            flow.line()
            continue
        if tag == "table":
            flow.breaks(2)
            frames.append((flow, rows, lists))
            flow, rows, lists = Flow(), [], []
        elif tag == "tr" and rows is not None:
            rows.append([])
        elif tag in ("td", "th") and rows is not None:
            frames.append((flow, rows, lists))
            flow, lists = Flow(), []
        elif tag in ("ul", "ol", "menu"):
            flow.breaks(1 if lists else 2)
            lists.append([tag == "ol", _number(node.attributes.get("start", ""), -(10**9), 10**9, 1)])
        elif tag == "li":
            flow.breaks(1)
            if lists:
                own = lists[-1]
                own[1] = _number(node.attributes.get("value", ""), -(10**9), 10**9, own[1])
                flow.prefix("  " * min(len(lists) - 1, DEEPEST) + (f"{own[1]}. " if own[0] else "- "))
                own[1] += 1
            else:
                flow.prefix("- ")
        elif tag in APART or tag in LINES or (node.around == "svg" and tag in SVG_TEXT):
            flow.breaks(2 if tag in APART else 1)
        work.append(("leave", node, seen, pre))
        work += [("text", c, seen, pre) if isinstance(c, str) else ("enter", c, seen, pre) for c in reversed(node.children)
                 if node.drawn or not isinstance(c, str)]
    return flow.text().strip("\n")


def page_text(html: str | None) -> str:
    """Visible text of a page."""
    builder = Builder()
    builder.feed(html or "")
    return render(builder.root)


def _texts(pages: pa.Array) -> pa.Array:
    return pa.array((page_text(p.as_py()) for p in pages), type=pa.string())


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the visible text of each whole page."""
    return pages.withColumn(out, F.arrow_udf(_texts, "string")(F.col(html)))
