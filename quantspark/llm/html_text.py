"""HTML extraction by layout-aware rendering.

Markup is read into a tree with the implied tags of HTML (paragraphs, list items, table parts and
rows end where the next one starts), elements that a reader does not see are left out, and the rest
is rendered: blocks on lines of their own, blank lines between paragraphs, list markers with
indentation, preformatted text as it stands, and table cells padded to the width of their column.

Parsing and rendering keep their own stacks, so pages may nest to any depth.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Generator, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_id, restored_id

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object canvas audio video datalist noembed noframes title "
    "desc metadata defs symbol annotation annotation-xml".split()  # the last are parts of drawings and formulas that are not shown
)
#: Inputs whose value a reader sees as text, or as a button's label.
SHOWN_INPUT = frozenset("text search tel url email number date time month week datetime-local submit button reset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tr ul".split()
)
#: Blocks with a layout of their own.
LAID_OUT = frozenset("ul ol menu dir table li dd blockquote".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
#: A start tag of the first kind ends an open element of the second, up to the given borders.
TABLE_PARTS = frozenset("thead tbody tfoot".split())
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "td": (frozenset("td th caption".split()), frozenset("tr table".split())),
    "th": (frozenset("td th caption".split()), frozenset("tr table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
ENDS_P = (BLOCK - frozenset("body html li dd dt tr caption".split())) | frozenset("li dd dt".split())
SCOPE = frozenset("table td th caption button object html body".split())

#: Lists and quotations nested deeper than this are not indented further.
INDENTED = 100

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
_KEEPS_SPACE = re.compile(r"white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\s*(?:;|!|\Z)", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict:
    found = {}
    for m in _ATTR.finditer(text):
        value = m[2] or ""
        found.setdefault(m[1].lower(), html.unescape(value.strip("\"'")))
    return found


def parse(source: str) -> Node:
    """The tree of ``source``.  End tags without an open element are ignored; open ones end with the text."""
    root = Node("#root")
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by name

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_from(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close_until(tags, borders) -> None:
        i = last(tags)
        if i > last(borders):
            close_from(i)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places["p"]:
                stack[-1].children.append(Node("p"))
            i = last((tag,))
            if i and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or i >= last(("table", "td", "th"))):
                close_from(i)
            continue
        if tag in ENDS_P:
            close_until(frozenset(["p"]), SCOPE)
        if tag in IMPLIED_END:
            tags, borders = IMPLIED_END[tag]
            while True:  # a row also ends the open cell below it
                before = len(stack)
                close_until(tags, borders)
                if len(stack) == before or tag not in ("tr", "thead", "tbody", "tfoot"):
                    break
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /") else None)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
            inside = source[at : end.start() if end else size]
            if inside:
                node.children.append(inside if tag in ("script", "style") else html.unescape(inside))
            at = end.end() if end else size
        elif tag not in VOID:
            places[tag].append(len(stack))
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    """Whether a reader sees the element.  What is only kept from screen readers (``aria-hidden``) is seen."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _NOT_DISPLAYED.search(a["style"]))


def _drop_invisible(root: Node) -> None:
    """Remove what ``visibility`` hides: it is inherited, and an element inside may be shown again."""
    todo = [(root, True)]
    while todo:
        node, shown = todo.pop()
        said = _VISIBILITY.findall(node.attrs.get("style", ""))
        shown = said[-1].lower() == "visible" if said else shown
        if not shown:
            node.attrs.pop("alt", None), node.attrs.pop("value", None)
            node.children = [x for x in node.children if not isinstance(x, str)]
        todo += [(x, shown) for x in node.children if not isinstance(x, str)]


def _width(text: str) -> int:
    """Columns a line takes: wide and full-width characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Collects lines; a block starts a new line, a spaced block also leaves a blank one."""

    def __init__(self, depth: int = 0):
        self.lines: list[str] = []
        self.line, self.gap, self.depth = "", 0, depth

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.line or self.line.endswith((" ", "\n")):
            text = text.lstrip(" ")
        self.line += text

    def flush(self) -> None:
        line = self.line.rstrip(" ").removesuffix("\n")  # a break at the end of a block shows nothing
        if line:
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            self.lines += line.split("\n")
        self.line = ""

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap |= spaced

    def paste(self, lines: list[str], lead: str, rest: str) -> None:
        self.flush()
        if lines:
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            if self.depth >= INDENTED:
                self.lines += lines
                return
            self.lines += [(lead if i == 0 else rest) + x if x else "" for i, x in enumerate(lines)]

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _finish(work: Generator):
    """Run a renderer.  Renderers yield the renderers of their parts instead of calling them."""
    stack, result = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


def _lines(node: Node, depth: int = 0) -> Generator:
    page = Page(depth)
    yield _render(node, page)
    return page.done()


def _pre_text(node: Node) -> str:
    out = []
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif visible(x):
            todo += reversed(x.children)
    return "".join(out)


def _list(node: Node, page: Page) -> Generator:
    try:
        number = int(node.attrs.get("start", "1"))
    except ValueError:
        number = 1
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            yield _render_one(child, page)
        elif visible(child):
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.paste((yield _lines(child, page.depth + 1)), mark, " " * len(mark))


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    captions, rows, loose = [], [], []
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append(x)
        elif not visible(x):
            continue
        elif x.tag in TABLE_PARTS:
            todo += reversed(x.children)
        elif x.tag == "tr":
            cells = [c for c in x.children if not isinstance(c, str) and c.tag in ("td", "th") and visible(c)]
            captions += [c for c in x.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th"))]
            if cells:
                rows.append(cells)
        elif x.tag in ("td", "th"):
            loose.append(x)
        elif x.tag not in ("colgroup", "col"):
            captions.append(x)
    return captions, rows + ([loose] if loose else [])


def _closed_details(node: Node) -> Node:
    """A closed ``details`` shows its first summary only."""
    short = Node("div")
    short.children = [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
    return short


def _chosen_options(select: Node) -> list[Node]:
    """The options marked as selected, the last one where only one can be.  Without a mark a list of choices shows nothing."""
    chosen, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or not visible(x):
            continue
        if x.tag == "option":
            chosen += [x] * ("selected" in x.attrs)
        else:
            todo += reversed(x.children)
    return chosen if "multiple" in select.attrs else chosen[-1:]


def _span(cell: Node, name: str) -> int:
    text = cell.attrs.get(name, "1")
    return min(1000, int(text)) if text.isascii() and text.isdigit() else 1


def _columns(rows: list[list[Node]]) -> list[list[tuple[Node, int, int]]]:
    """(cell, first column, columns) by row; a cell that spans rows keeps its columns in those below."""
    taken: dict[int, int] = {}  # column: the row from which it is free
    out = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for cell in row:
            while taken.get(at, 0) > r:
                at += 1
            columns, high = max(1, _span(cell, "colspan")), _span(cell, "rowspan") or len(rows)  # 0: all rows below
            placed.append((cell, at, columns))
            if high > 1:
                taken.update((at + k, r + high) for k in range(columns))
            at += columns
        out.append(placed)
    return out


def _table(node: Node, page: Page) -> Generator:
    """Captions and stray content first; then cells in columns, cells of several lines over as many."""
    outside, rows = _rows(node)
    page.block(True)
    for x in outside:
        yield _render_one(x, page)
        page.flush()
    texts, widths = [], {}
    for row in _columns(rows):
        cells = []
        for cell, at, columns in row:
            lines = yield _lines(cell, page.depth)
            cells.append((lines, at, columns))
            if columns == 1:
                widths[at] = max(widths.get(at, 0), max(map(_width, lines), default=0))
        texts.append(cells)
    used = sorted(widths)
    starts = dict(zip(used, accumulate((widths[k] + 2 for k in used), initial=0)))  # an empty column takes no room
    for row in texts:
        for i in range(max((len(lines) for lines, _, _ in row), default=0)):
            out = ""
            for lines, at, _ in row:
                if i < len(lines) and lines[i]:
                    place = starts[used[k]] if (k := bisect_left(used, at)) < len(used) else 0
                    out = out + " " * (place - _width(out)) if _width(out) <= place else out.rstrip(" ") + "  "
                    out += lines[i]
            if out.strip():
                page.paste([out.rstrip()], "", "")
    page.block(True)


def _render_one(x, page: Page) -> Generator:
    if isinstance(x, str):
        page.inline(x)
        return
    if not visible(x):
        return
    tag = x.tag
    if tag == "br":
        page.line = page.line.rstrip(" ") + "\n"
    elif tag == "hr":
        page.block(False)
    elif tag == "img":
        page.inline(x.attrs.get("alt", ""))
    elif tag == "input":
        if (x.attrs.get("type", "").lower() or "text") in SHOWN_INPUT:
            page.inline(x.attrs.get("value", ""))
    elif tag == "select":
        for option in _chosen_options(x):
            page.inline(" ")
            yield _render(option, page)
        page.inline(" ")
    elif tag == "details" and "open" not in x.attrs:
        page.block(False)
        yield _render(_closed_details(x), page)
        page.block(False)
    elif tag == "pre" or (tag in BLOCK - LAID_OUT and _KEEPS_SPACE.search(x.attrs.get("style", ""))):
        page.block(True)
        page.paste(_pre_text(x).strip("\n").replace("\r\n", "\n").split("\n"), "", "")
        page.block(True)
    elif tag in ("ul", "ol", "menu", "dir"):
        page.block(True)
        yield _list(x, page)
        page.block(True)
    elif tag == "table":
        yield _table(x, page)
    elif tag in ("blockquote", "dd"):
        page.block(tag in SPACED)
        page.paste((yield _lines(x, page.depth + 1)), "  ", "  ")
        page.block(tag in SPACED)
    elif tag == "li":
        page.block(False)
        page.paste((yield _lines(x, page.depth + 1)), "- ", "  ")
    elif tag in ("td", "th"):  # a cell outside a table
        yield _render(x, page)
        page.inline(" ")
    elif tag in BLOCK:
        page.block(tag in SPACED)
        yield _render(x, page)
        page.block(tag in SPACED)
    else:
        yield _render(x, page)


def _render(node: Node, page: Page) -> Generator:
    for x in node.children:
        if isinstance(x, str):
            page.inline(x)
        else:
            yield _render_one(x, page)


def render(source: str | None) -> tuple[str, str]:
    """(title, visible text) of a page; both empty for null or empty input."""
    if not source:
        return "", ""
    root = parse(source)
    title, todo = "", [root]
    while todo and not title:
        x = todo.pop()
        if x.tag == "title":
            title = _SPACE.sub(" ", "".join(c for c in x.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    if _VISIBILITY.search(source):
        _drop_invisible(root)
    return title, "\n".join(_finish(_lines(root)))


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, title, text, n_chars``.

    Null and empty pages give empty strings; text without markup is rendered as one paragraph;
    repeated rows are rendered each.  Other columns are ignored.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [render(x) for x in pdf["html"]]
            texts = [t for _, t in found]
            yield pdf[["doc_id", "nameless"]].assign(title=[t for t, _ in found], text=texts, n_chars=list(map(len, texts)))

    rows = pages.select(*carried_id(id_col), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInPandas(extract, "doc_id long, nameless boolean, title string, text string, n_chars long")
    return restored_id(found).withColumnRenamed("doc_id", "page_id")
