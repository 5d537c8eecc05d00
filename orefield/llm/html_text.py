"""HTML to text by layout-aware rendering.

A tree builder makes a tree of the page with the tags that HTML implies (paragraphs, list items and table
parts end by themselves; tables get rows). Rendering walks the tree, leaves out what a browser does not show
(by tag, attribute, style, or style-sheet rules of single elements), and writes blocks on lines of their own with
blank lines between paragraphs, lists with marks and indentation, preformatted text as it stands, and tables with
their cells aligned in columns. Both keep their own stacks, so elements may nest as deep as they like.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe object audio video canvas datalist noembed noframes base link meta param source track colgroup area".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption h1 h2 h3 h4 h5 h6 hr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
#: An opening tag ends these open elements, up to the given bounds.
_ENDS = {t: (frozenset("p".split()), frozenset("button".split())) for t in BLOCKS - frozenset("body html option optgroup tbody td tfoot th thead tr legend caption summary".split())}
_LISTS, _TABLE = frozenset("ul ol menu dir".split()), frozenset("table".split())
_ENDS |= {
    "li": (frozenset("li".split()), _LISTS),
    "dt": (frozenset("dt dd".split()), frozenset("dl".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl".split())),
    "td": (frozenset("td th caption".split()), frozenset("tr table".split())),
    "th": (frozenset("td th caption".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr caption colgroup".split()), _TABLE),
    "option": (frozenset("option".split()), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select".split())),
}
_ENDS |= {t: (frozenset("thead tbody tfoot caption colgroup".split()), _TABLE) for t in ("thead", "tbody", "tfoot")}

_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_VALUED = frozenset("text search email url tel number date time month week datetime-local button submit reset".split())  # inputs that show their value


class Sheet:
    """Rules of style sheets on display and visibility, for selectors of one element (tag, classes, id); other selectors and @ rules are left out."""

    def __init__(self, text: str = ""):
        self.rules: list[tuple[str, frozenset, str, dict[str, str], tuple]] = []
        for n, m in enumerate(_RULE.finditer(_AT.sub(" ", _COMMENT.sub(" ", text)))):
            said = {x.lower(): y.lower() for x, y in _STYLE.findall(m[2])}
            for part in m[1].split(",") if said else ():
                if (one := _SELECTOR.fullmatch(part.strip())) and part.strip():
                    names = re.findall(r"[.#][\w-]+", one[2])
                    ids, classes = [x[1:] for x in names if x[0] == "#"], frozenset(x[1:] for x in names if x[0] == ".")
                    if len(ids) < 2:
                        tag = (one[1] or "*").lower()
                        self.rules.append((tag, classes, ids[0] if ids else "", said, (len(ids), len(classes), tag != "*", n)))
        self.rules.sort(key=lambda x: x[4])

    def of(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        """What rules, the hidden attribute and the element's own style say; the last word is the style's."""
        out = {"display": "none"} if "hidden" in attrs else {}
        if self.rules:
            classes = frozenset(attrs.get("class", "").split())
            for name, need, ident, said, _ in self.rules:
                if name in ("*", tag) and need <= classes and (not ident or ident == attrs.get("id")):
                    out |= said
        if "style" in attrs:
            out |= {x.lower(): y.lower() for x, y in _STYLE.findall(attrs["style"])}
        return out


class Node:
    __slots__ = ("attrs", "children", "css", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.css = tag, attrs or {}, [], ""


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The tree of a page, with the text of its style sheets. Never fails: stray end tags are ignored, open elements end with the page."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()  # elements on the stack by tag
    sheets: list[str] = []

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def close(tags: frozenset, bounds: frozenset) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in bounds:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                bounds = frozenset() if tag in ("table", "html") else frozenset(("table",)) if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else _TABLE
                if tag in ("table",) or opened[tag]:
                    close(frozenset((tag,)), bounds)
            continue
        if tag in ("html", "body", "head") and tag != "head":
            if m[3]:
                root.attrs = {**_attributes(m[3]), **root.attrs}
            close(frozenset(("head",)), frozenset())
            continue
        if tag in _ENDS:
            close(*_ENDS[tag])
            if tag in ("li", "dt", "dd") or tag in BLOCKS:
                close(frozenset(("p",)), frozenset(("button", "table", "td", "th", "li", "dd", "dt")))
        if tag not in HIDDEN and stack[-1].tag == "head":
            cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /") else None)
        stack[-1].children.append(node)
        if tag in VOID or (m[3].endswith("/") and (tag in ("svg", "math") or opened["svg"] or opened["math"])):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else n]
            if tag == "textarea":
                node.children.append(html.unescape(text.removeprefix("\n")))
            elif tag == "style":
                sheets.append(text)
            at = end.end() if end else n
            continue
        push(node)
    root.css = "\n".join(sheets)
    return root


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines being written: collapses white space, keeps blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.space = False
        self.started = False

    def text(self, s: str) -> None:
        parts = _BLANK.split(s)
        for k, p in enumerate(parts):
            if k:
                self.space = True
            if p:
                if self.space and self.started:
                    self.now.append(" ")
                self.now.append(p)
                self.space, self.started = False, True

    def end(self) -> None:
        if self.started:
            self._put("".join(self.now))
        self.now, self.space, self.started = [], False, False

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, lines: list[str]) -> None:
        self.end()
        for k, x in enumerate(lines):
            if k:
                self.lines.append(x)
            else:
                self._put(x)

    def blank(self) -> None:
        self.end()
        self.gap = True


def _number(text: str | None, otherwise: int) -> int:
    try:
        return int(text) if text is not None else otherwise
    except ValueError:
        return otherwise


def _span(node: Node, name: str, most: int) -> int:
    """A colspan or rowspan; HTML itself takes those over `most` as `most`."""
    n = _number(node.attrs.get(name), 1)
    return most if n == 0 and name == "rowspan" else min(most, max(1, n))


def _indented(lines: list[str], mark: str) -> list[str]:
    return [((mark if k == 0 else " " * len(mark)) + x).rstrip() for k, x in enumerate(lines)]


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, colspan, rowspan) padded to their columns' widths, two spaces apart; a cell of many rows leaves its columns free below."""
    widths: list[int] = []
    placed: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # columns that a cell above holds, and for how many rows more
    for row in rows:
        at, mine, held = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, span, down in row:
            while any(c in taken for c in range(at, at + span)):
                at += 1
            mine.append((at, lines, span))
            widths.extend([0] * (at + span - len(widths)))
            if span == 1:
                widths[at] = max(widths[at], max(map(width, lines), default=0))
            if down > 1:
                held |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        placed.append(mine)
        taken = held
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out: list[str] = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, upto = [], 0
            for at, lines, _ in row:
                if k < len(lines) and lines[k]:
                    room = max(0, starts[at] - upto, 2 if line else 0)
                    line += [" " * room, lines[k]]
                    upto += room + width(lines[k])
            out.append("".join(line).rstrip())
    return out


Step = Generator["Step", object, object]


def finished(step: Step) -> object:
    """The result of a step and of the steps that it waits for, on a stack of our own."""
    waiting, value = [step], None
    while waiting:
        try:
            inner = waiting[-1].send(value)
        except StopIteration as end:
            waiting.pop()
            value = end.value
        else:
            waiting.append(inner)
            value = None
    return value


class Renderer:
    """Renders the elements of a page; each method is a step of `finished`. `seen` says whether visibility lets text show."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet

    def shown(self, node: Node, seen: bool) -> bool | None:
        """Whether text in an element shows; None if the element and all in it does not."""
        if node.tag in HIDDEN:
            return None
        if not node.attrs and not self.sheet.rules:
            return None if node.tag == "dialog" else seen
        if (node.tag == "dialog" and "open" not in node.attrs) or (node.tag == "input" and node.attrs.get("type", "text").lower() not in _VALUED):
            return None
        said = self.sheet.of(node.tag, node.attrs)
        if said.get("display") == "none":
            return None
        way = said.get("visibility", "inherit")
        return False if way in ("hidden", "collapse") else True if way == "visible" else seen

    def lines(self, node: Node, seen: bool, children: list | None = None) -> Step:
        """The lines that the inside of an element shows."""
        out = _Lines()
        yield self.flow(node.tag, node.children if children is None else children, node.tag == "pre", seen, out)
        out.end()
        lines = [x.rstrip() for x in out.lines]
        first = next((k for k, x in enumerate(lines) if x), len(lines))
        while lines and not lines[-1]:
            lines.pop()
        return lines[first:]

    def flow(self, parent: str, children: list, pre: bool, seen: bool, out: _Lines) -> Step:
        for c in children:
            if isinstance(c, str):
                if not seen:
                    continue
                if pre:
                    first, *more = c.expandtabs(8).replace("\r\n", "\n").split("\n")
                    if first:
                        out.now.append(first)
                        out.started = True
                    for line in more:
                        out._put("".join(out.now))
                        out.now, out.started = [line] if line else [], bool(line)
                else:
                    out.text(c)
                continue
            if (here := self.shown(c, seen)) is None:
                continue
            tag = c.tag
            if tag == "br":
                if out.started:
                    out.end()
                elif out.lines and not out.gap:
                    out._put("")
            elif tag == "input":
                if here:
                    out.text(f" {c.attrs.get('value', '')} ")
            elif tag == "svg":  # shapes show no text but that of their text elements
                texts, ways = [], [(c, here)]
                while ways:
                    x, way = ways.pop()
                    if isinstance(x, str) or way is None:
                        continue
                    if x.tag in ("text", "foreignobject"):
                        texts.append((x, way))
                    else:
                        ways += [(y, y if isinstance(y, str) else self.shown(y, way)) for y in reversed(x.children)]
                for x, way in texts:
                    out.text(" ")
                    yield self.flow(x.tag, x.children, False, way, out)
                    out.text(" ")
            elif tag not in BLOCKS:
                yield self.flow(tag, c.children, pre or tag == "textarea", here, out)
            else:
                spaced = tag in SPACED and not (tag in ("ul", "ol") and parent == "li")
                (out.blank if spaced else out.end)()
                if tag in ("ul", "ol", "menu", "dir"):
                    out.block((yield self.items(c, here)))
                elif tag == "table":
                    caption, lines = yield self.table(c, here)
                    out.block(caption)
                    out.block(lines)
                elif tag in ("dd", "blockquote"):
                    out.block(_indented((yield self.lines(c, here)), "  "))
                elif tag == "pre":
                    inside = list(c.children)
                    if inside and isinstance(inside[0], str):
                        inside[0] = inside[0].removeprefix("\n")
                    yield self.flow(tag, inside, True, here, out)
                elif tag == "details" and "open" not in c.attrs:
                    label = [x for x in c.children if isinstance(x, Node) and x.tag == "summary"][:1]
                    yield self.flow(tag, label, pre, here, out)
                elif tag != "hr":
                    yield self.flow(tag, c.children, pre, here, out)
                (out.blank if spaced else out.end)()

    def table(self, node: Node, seen: bool) -> Step:
        """Caption lines, and the rows with their cells aligned."""
        rows: list[list[tuple[list[str], int, int]]] = []
        caption: list[str] = []
        loose: list = []
        parts: list[tuple[object, bool]] = [(x, seen) for x in reversed(node.children)]
        while parts:
            c, way = parts.pop()
            if isinstance(c, str):
                if c.strip():
                    loose.append(c)
            elif (here := self.shown(c, way)) is None:
                continue
            elif c.tag == "tr":
                cells = []
                for d in c.children:
                    if isinstance(d, str):
                        loose += [d] if d.strip() else []
                    elif (inner := self.shown(d, here)) is not None:
                        cells.append(((yield self.lines(d, inner)), _span(d, "colspan", 1000), _span(d, "rowspan", 65534)))
                rows.append(cells)
            elif c.tag in ("thead", "tbody", "tfoot"):
                parts += [(x, here) for x in reversed(c.children)]
            elif c.tag == "caption":
                caption += yield self.lines(c, here)
            else:
                loose.append(c)
        if loose:
            caption = (yield self.lines(Node("div"), seen, loose)) + caption
        return caption, _aligned(rows)

    def items(self, node: Node, seen: bool) -> Step:
        out: list[str] = []
        number = _number(node.attrs.get("start"), 1)
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    out += yield self.lines(node, seen, [c])
            elif (here := self.shown(c, seen)) is None:
                continue
            elif c.tag == "li":
                mark = "- "
                if node.tag == "ol":
                    number = _number(c.attrs.get("value"), number)
                    mark = f"{number}. "
                    number += 1
                lines = yield self.lines(c, here)
                if here or lines:
                    out += _indented(lines, mark) or [mark.rstrip()]
            else:
                out += _indented((yield self.lines(node, seen, [c])), "  ")
        return out


def html_text(page: str) -> str:
    root = parse(page)
    renderer = Renderer(Sheet(root.css))
    seen = renderer.shown(root, True)
    return "" if seen is None else "\n".join(finished(renderer.lines(root, seen)))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The rows of pages without the html column, with `text`: what the page shows.

    Null and empty pages give an empty text; broken HTML is read as far as it goes, however deep it nests. Style-sheet
    rules count if they select by a tag, classes and an id of the element itself and stand outside of @ blocks. Rows are independent: repeated rows give equal texts, an empty table none. A column of pages
    named text is replaced.
    """
    names = [c for c in pages.columns if c not in (column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page"):
            text = pa.array([html_text(x) for x in batch.column("page").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "text"])

    # Columns go through Arrow by number: their names may hold anything.
    source = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), whole(column).alias("page"))
    schema = type(pages.schema)()
    for f in source.schema.fields[:-1]:
        schema = schema.add(f.name, f.dataType, True)
    return source.mapInArrow(run, schema.add("text", "string")).toDF(*names, "text")
