"""HTML extraction by layout-aware rendering.

Method: a tree builder with implied tags turns the page into a tree (a list item ends the one before, a block ends an open
paragraph, a table row or cell ends its forerunner, an end tag without its start tag is passed over); visibility rules
take out what a browser would not show (head, scripts, styles, templates, hidden elements, `display: none`, closed
details, fallback content); a renderer then emits all visible text: one line for each block, blank lines around
paragraphs, headings, lists and tables, bullets and numbers with indentation, preformatted text as it stands, table cells
set under each other by the width of their column, over the rows and columns that they span. Builder and renderer work with
explicit stacks and know where each kind of element is open, so that their time grows with the page and not with its depth.

Defined cases: a null or empty page has no text (the empty string); broken or endless markup is read as far as it goes;
tag-like text that isn't a tag stays text; a number that isn't one counts as missing, a character reference beyond Unicode
is U+FFFD; spans stop at the limits of HTML (1,000 columns, 65,534 rows, the table's end); from INDENTED levels on lists and
quotes are no longer set in further; a cell that would stand beyond ALIGNED places of its line follows the text before it after a
gap, so that no line has more padding than that for each of NESTED tables around it; tables deeper than that are read cell by cell,
each a block; no text is lost by either; repeated rows, null ids and further columns stay; the new column replaces one of its
name; an empty table gives an empty result."""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from scoregate.llm.common import ship, slices

#: A quote opens a value only directly after "=", and only where it closes; otherwise it is a character as any other.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
_TOKEN = re.compile(
    rf"<(?:!--.*?(?:-->|--!>|\Z)|(/?)([A-Za-z][^\s/>]*)((?>[\s/]+|[^\s/>][^\s/>=]*+(?>\s*=\s*(?>{_VALUE}))?)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S
)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?>\s*=\s*({_VALUE}))?")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LONG_REFERENCE = re.compile(r"&#(?:0*([0-9]{7,})|[xX]0*([0-9a-fA-F]{6,})|0{7,}([0-9]{1,6})|[xX]0{7,}([0-9a-fA-F]{1,5})(?![0-9a-fA-F]));?")
_WHOLE = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])", re.A)
#: Levels up to which lists and quotes are set in.
INDENTED = 64
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
#: Places of a line up to which cells are set under each other; tables within each other that are laid out; columns searched at once.
ALIGNED, NESTED, SEARCHED = 200, 8, 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link map area rp".split())
#: Drawings and formulas: what has no text to show in them, whose own text isn't drawn, whose content is HTML, what ends them.
FOREIGN = frozenset(("svg", "math"))
UNSEEN_FOREIGN = frozenset(
    "defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split()
)
UNDRAWN = frozenset(("svg", "g"))
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BLOCKS = frozenset(
    "textarea address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu dir xmp".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend"}
#: What a start tag ends, and where the search for it stops.
_LISTS, _TABLE, _SECTION = ("ul", "ol", "menu", "dir"), ("table",), ("thead", "tbody", "tfoot")
IMPLIED = {
    "li": (("li",), (*_LISTS, "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")),
    "td": (("td", "th", "caption"), ("tr", "table")), "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), _TABLE), "tbody": ((*_SECTION, "tr", "td", "th", "caption"), _TABLE),
    "thead": ((*_SECTION, "tr", "td", "th", "caption"), _TABLE), "tfoot": ((*_SECTION, "tr", "td", "th", "caption"), _TABLE),
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)),
}
#: An end tag doesn't look beyond these for its start tag, unless it is one of them.
BARRIERS = frozenset(("table", "td", "th", "template", "html"))


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes or {}, [], foreign


def _long_reference(found: re.Match) -> str:
    digits, base = next((found[i], 10 if i in (1, 3) else 16) for i in range(1, 5) if found[i])
    return entities.unescape(f"&#{int(digits, base)};") if len(digits) <= 7 else "\ufffd"


def unescaped(text: str) -> str:
    """The text with its character references resolved, however many digits they have."""
    if "&" not in text:
        return text
    return entities.unescape(_LONG_REFERENCE.sub(_long_reference, text) if "&#" in text else text)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescaped(value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value))
    return found


def _whole(text: str | None) -> int | None:
    """The whole number that an attribute begins with."""
    found = _WHOLE.match(text or "")
    return int(found[1]) if found else None


class _Open:
    """The stack of open elements, and at which places of it each tag is open."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close everything from a place on."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags, 0 where none is open."""
        places = self.places
        return max((places[t][-1] for t in tags if t in places and places[t]), default=0)

    def close(self, tags, stops) -> None:
        """Close the innermost of the tags, with what is in it and those of the tags right around it, unless a stop is nearer."""
        at = self.last(tags)
        if at and at > self.last(stops):
            while at > 1 and self.nodes[at - 1].tag in tags and self.nodes[at - 1].tag not in stops:
                at -= 1
            self.cut(at)


def build(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("html")
    open_ = _Open(root)
    nodes = open_.nodes
    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        start = token.start() if token else size
        if start > at:
            nodes[-1].children.append(unescaped(page[at:start]))
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "br":
                nodes[-1].children.append(Node("br"))
            elif (place := open_.last((tag,))) and (tag in BARRIERS or tag in ("tr", *_SECTION) or open_.last(BARRIERS) < place):
                open_.cut(place)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                open_.close(("head",), ())
            continue
        if nodes[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            open_.cut(len(nodes) - 1)
        while tag in BREAKS_OUT and nodes[-1].foreign and nodes[-1].tag not in HOLDS_HTML:
            open_.cut(len(nodes) - 1)
        foreign = tag in FOREIGN or (nodes[-1].foreign and nodes[-1].tag not in HOLDS_HTML)
        if tag in ENDS_PARAGRAPH:
            open_.close(("p",), BARRIERS)
        if tag in IMPLIED:
            open_.close(*IMPLIED[tag])
        node = Node(tag, _attributes(token[3]) if token[3] else None, foreign)
        nodes[-1].children.append(node)
        if tag in VOID or (foreign and token[3].endswith("/")):
            continue
        if tag in RAW or tag in PLAIN:
            end = _END_TAGS[tag].search(page, at)
            inside = page[at : end.start() if end else size]
            node.children.append(unescaped(inside) if tag in PLAIN else inside)
            at = end.end() if end else size
        else:
            open_.push(node)
    return root


_END_TAGS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW | PLAIN}


def visible(node: Node) -> bool:
    """Whether a browser would show an element."""
    a = node.attributes
    if node.tag in UNSEEN or (node.foreign and node.tag in UNSEEN_FOREIGN) or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _HIDING.search(a["style"]))


def _width(line: str) -> int:
    """Columns that a line takes: two for a wide character, none for one that joins the one before."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1 for c in line)


class _Sink:
    """Where the lines of a page, a table or a cell gather: text runs make one line until a break."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.blank = False  # a blank line is due before the next line
        self.indent, self.levels = "", 0
        self.pending: list[_Block] = []  # blocks set in whose first line is still to come
        self.grid: _Grid | None = None

    def text(self, value: str, preformatted: bool) -> None:
        if preformatted:
            parts = value.replace("\r\n", "\n").split("\n")
            for part in parts[:-1]:
                self.run.append(part)
                self.end(True, keep=True)
            self.run.append(parts[-1])
        else:
            self.run.append(value)

    def end(self, preformatted: bool, keep: bool = False) -> None:
        """End the line; an empty one counts only if it is kept."""
        if not self.run and not keep:
            return
        line = "".join(self.run)
        line = line.rstrip() if preformatted else _SPACE.sub(" ", line).strip(" ")
        self.run = []
        if line or keep:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        ahead = [self.indent]
        for block in self.pending:
            ahead.append(block.prefix)
            block.before = self.indent, self.levels
            if self.levels < INDENTED:
                self.indent, self.levels = self.indent + " " * len(block.prefix), self.levels + 1
        self.pending.clear()
        self.lines.append(("".join(ahead) + line).rstrip() if not line else "".join(ahead) + line)


    def put_all(self, lines: list[str]) -> None:
        if lines:
            self.put(lines[0])
            self.lines += [self.indent + line if line else "" for line in lines[1:]] if self.indent else lines[1:]


class _Block:
    """An open block of a sink."""

    __slots__ = ("node", "sink", "preformatted", "prefix", "apart", "start", "due", "before", "count")

    def __init__(self, node: Node, sink: _Sink, preformatted: bool, prefix: str, apart: bool):
        self.node, self.sink, self.preformatted, self.prefix, self.apart = node, sink, preformatted, prefix, apart
        self.start, self.due, self.before, self.count = len(sink.lines), sink.blank, None, 0
        sink.blank |= apart
        if prefix:
            sink.pending.append(self)

    def close(self) -> None:
        sink = self.sink
        if self.prefix:
            if self.before is None:
                sink.pending.pop()
            else:
                sink.indent, sink.levels = self.before
        sink.blank = self.apart if len(sink.lines) > self.start else self.due


class _Grid:
    """The cells of a table: their lines, the row and column where they start, the rows and columns that they span."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def row(self) -> None:
        self.rows.append([])

    def cell(self, lines: list[str], node: Node) -> None:
        if not self.rows:
            self.row()
        across, down = _whole(node.attributes.get("colspan")), _whole(node.attributes.get("rowspan"))
        across = min(across, MOST_COLUMNS) if across and across > 0 else 1
        down = MOST_ROWS if down == 0 else min(down, MOST_ROWS) if down and down > 0 else 1
        self.rows[-1].append((lines, across, down))

    def placed(self) -> list[tuple[list[str], int, int, int, int]]:
        """(lines, row, last row + 1, column, last column + 1) of each cell, beside the cells that reach down from above."""
        out, taken = [], _Taken()
        for r, row in enumerate(self.rows):
            column = 0
            for lines, across, down in row:
                column = taken.free(column, r)
                until = min(r + down, len(self.rows))
                out.append((lines, r, until, column, column + across))
                if until > r + 1:
                    taken.take(column, column + across, until)
                column += across
        return out

    def drawn(self) -> list[str]:
        """The lines of the table. Only columns at which a cell starts count."""
        cells = self.placed()
        starts = sorted({c[3] for c in cells})
        if len(starts) < 2 and all(last_row - row == 1 for _, row, last_row, _, _ in cells):
            return list(itertools.chain.from_iterable(c[0] for c in cells))
        index = {c: i for i, c in enumerate(starts)}
        widths, heights = np.zeros(len(starts), np.int64), [0] * len(self.rows)
        spanning, reaching = [], []
        for lines, row, last_row, column, end in cells:
            first, last = index[column], bisect.bisect_left(starts, end)
            width = max(map(_width, lines), default=0)
            if last - first == 1:
                widths[first] = max(widths[first], width)
            elif width:
                spanning.append((last - first, first, width))
            heights[row] = max(heights[row], len(lines) if last_row - row == 1 else min(1, len(lines)))
            if last_row - row > 1 and lines:
                reaching.append((last_row, row, len(lines)))
        for span, first, width in sorted(spanning):
            own = widths[first : first + span]
            lacking = width - int(own.sum()) - len(GAP) * (span - 1)
            if lacking > 0:
                own += lacking // span
                own[: lacking % span] += 1
        # What cells over many rows lack goes to their last row; from the top, so that sums of what was given stay sums of a list's end.
        upto, given, sums = [0, *itertools.accumulate(heights)], [], [0]
        for last_row, row, n in sorted(reaching):
            lacking = n - (upto[last_row] - upto[row]) - (sums[-1] - sums[bisect.bisect_left(given, row)])
            if lacking > 0:
                heights[last_row - 1] += lacking
                given.append(last_row - 1)
                sums.append(sums[-1] + lacking)
        tops = [0, *itertools.accumulate(heights)]
        lefts = [0, *np.cumsum(widths + len(GAP)).tolist()]
        out: list[list[tuple[int, str]]] = [[] for _ in range(tops[-1])]
        for lines, row, _, column, _ in cells:
            for k, line in enumerate(lines):
                if line:
                    out[tops[row] + k].append((lefts[index[column]], line))
        drawn = []
        for parts in out:
            pieces, at = [], 0
            for left, text in sorted(parts):
                gap = left - at if left <= ALIGNED else max(ALIGNED - at, len(GAP) if at else 0)
                pieces += (" " * gap, text)
                at += gap + _width(text)
            drawn.append("".join(pieces).rstrip())
        return drawn


class _Taken:
    """Until which row each column is taken by a cell from above. The least of every SEARCHED columns is kept beside them, so that
    the next free column is found without a look at each one."""

    def __init__(self):
        self.until, self.least = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def take(self, first: int, end: int, until: int) -> None:
        if end > len(self.until):
            more = max(end, 2 * len(self.until)) // SEARCHED + 1
            self.until, self.least = (np.append(x, np.zeros(n - len(x), np.int32)) for x, n in ((self.until, more * SEARCHED), (self.least, more)))
        np.maximum(self.until[first:end], until, out=self.until[first:end])
        for k in range(first // SEARCHED, (end - 1) // SEARCHED + 1):
            self.least[k] = self.until[k * SEARCHED : (k + 1) * SEARCHED].min()

    def free(self, column: int, row: int) -> int:
        """The first column from the given one on that no cell from above takes in a row."""
        k = column // SEARCHED
        while k < len(self.least):
            here = self.until[max(column, k * SEARCHED) : (k + 1) * SEARCHED] <= row
            if here.any():
                return max(column, k * SEARCHED) + int(here.argmax())
            later = self.least[k + 1 :] <= row
            if not later.any():
                return max(column, len(self.until))
            k += 1 + int(later.argmax())
        return column


GAP = "  "


def render(root: Node) -> str:
    """All visible text of a tree."""
    top = _Sink()
    blocks = [_Block(root, top, False, "", False)]
    tables: list[_Sink | None] = []  # None: one that isn't laid out
    lists: list[_Block] = []
    work: list = [("open", c) for c in reversed(root.children)]
    while work:
        what, node = work.pop()
        here = blocks[-1]
        sink = here.sink
        if what == "close":
            sink.end(here.preformatted)
            here.close()
            blocks.pop()
            tag = node.tag
            if tag in _LISTS:
                lists.pop()
            if tag == "table" and tables.pop() is not None:
                outer = _Block(node, blocks[-1].sink, False, "", True)
                outer.sink.put_all(sink.lines + sink.grid.drawn() if sink.lines else sink.grid.drawn())
                outer.close()
            elif tag in ("td", "th") and tables and tables[-1]:
                tables[-1].grid.cell(sink.lines, node)
            continue
        if isinstance(node, str):
            sink.text(node, here.preformatted)
            continue
        tag = node.tag
        if tag == "br":
            sink.end(here.preformatted, keep=True)
            continue
        if tag == "wbr" or not visible(node):
            continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if node.foreign and tag in UNDRAWN:
            children = [c for c in children if isinstance(c, Node)]
        if tag not in BLOCKS and tag != "xmp":
            if node.foreign and tag == "text":  # a text of its own place in the drawing
                sink.run.append(" ")
                children = [*children, " "]
            if tag in ("input", "button", "select", "img") and sink.run:
                sink.run.append(" ")
            work += [("open", c) for c in reversed(children)]
            continue
        if tag == "hr":
            sink.end(here.preformatted)
            sink.blank = True
            continue
        if tag in ("tr", "thead", "tbody", "tfoot"):
            if tag == "tr" and tables and tables[-1]:
                tables[-1].grid.row()
                children = [c for c in children if not isinstance(c, str) or c.strip()]
            work += [("open", c) for c in reversed(children)]
            continue
        sink.end(here.preformatted)
        prefix = ""
        if tag == "li":
            owner = lists[-1] if lists else None
            if owner is not None and owner.node.tag == "ol":
                begin = _whole(node.attributes.get("value"))
                if begin is None and not owner.count:
                    begin = _whole(owner.node.attributes.get("start"))
                owner.count = owner.count + 1 if begin is None else begin
                prefix = f"{owner.count}. "
            else:
                prefix = "- "
        elif tag in ("dd", "blockquote"):
            prefix = "  "
        apart = tag in SPACED and tag != "table" and not (tag in _LISTS and lists)
        laid_out = tag == "table" and len(tables) < NESTED
        if laid_out or (tag in ("td", "th") and tables and tables[-1]):
            sink = _Sink()
        block = _Block(node, sink, here.preformatted or tag in ("pre", "textarea", "xmp"), prefix, apart)
        blocks.append(block)
        if tag == "table":
            if laid_out:
                sink.grid = _Grid()
            tables.append(sink if laid_out else None)
        elif tag in _LISTS:
            lists.append(block)
        work.append(("close", node))
        work += [("open", c) for c in reversed(children)]
    top.end(False)
    return "\n".join(top.lines).strip("\n")


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The pages with the string column ``text`` in the place of their html."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=html):
            names = batch.schema.names
            kept = [i for i, n in enumerate(names) if n not in (html, text)]
            texts = [page_text(p) for p in batch.column(names.index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(names[i] for i in kept), text])

    return pages.mapInArrow(run, T.StructType([f for f in pages.schema.fields if f.name not in (html, text)] + [T.StructField(text, T.StringType())]))
