"""Visible text of web pages, laid out as it would be read.

A tolerant tree builder closes what HTML lets authors leave open (paragraphs, list items, cells, rows, options) and
ignores stray end tags; a renderer walks the tree, leaves out what is not shown, and keeps what layout says: blank lines
between blocks, line breaks, list markers and their indentation, preformatted text, and tables with their columns
aligned. Both walk with their own stacks, so depth is no matter; time and space are linear in the page. Columns are
padded to at most WIDEST characters and lines indented by at most DEEPEST; longer cells are written whole and only
push what follows."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.words import slices

WIDEST, NESTED_TABLES, DEEPEST = 40, 20, 80

# Element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg "
                   "math datalist meta link base area param source track map colgroup col".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form "
                            "header html legend li main nav option section summary search tr thead tbody tfoot caption td th".split())
ENDS_P = SPACED | frozenset("address article aside center details dialog div fieldset figcaption footer form header main "
                            "nav section summary search".split())
#: Start tags that end open ones, up to the elements that bound the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
#: End tags look no further than these.
WALLS = frozenset("table td th caption body html template".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANK = re.compile(r"[ \t\n\f\r]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
            for m in reversed(list(_ATTR.finditer(text)))}


def parse(page: str) -> list:
    """The tree: a node is [tag, attribute text, children]; a child is a node or a string."""
    root: list = ["html", "", []]
    stack = [root]
    live: Counter = Counter()

    def drop(i: int) -> None:
        for gone in stack[i:]:
            live[gone[0]] -= 1
        del stack[i:]

    at, size, loose = 0, len(page), False
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            stack[-1][2].append(html.unescape(page[at:lt]) if "&" in page[at:lt] else page[at:lt])
        if lt == size:
            break
        after = page[lt + 1:lt + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    end, skip = page.find(">", lt + 4), 1
                else:
                    end, skip = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                end, skip = page.find("]]>", lt), 3
            else:
                end, skip = page.find(">", lt), 1
            at = size if end < 0 else end + skip
            continue
        m = None
        if after.isalpha() or after == "/":
            m = (_LOOSE if loose else _TAG).match(page, lt)
            if m is None and not loose:
                loose = True  # a quote that is never closed: from here on quotes do not count
                m = _LOOSE.match(page, lt)
        if m is None:
            if after == "/" and page[lt + 2:lt + 3]:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                stack[-1][2].append("<")
                at = lt + 1
            continue
        tag, at = m[1].lower(), m.end()
        if after == "/":
            if tag == "br" or tag == "p" and not live["p"]:
                stack[-1][2].append([tag, "", []])
                continue
            if not live[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    drop(i)
                    break
                if stack[i][0] in WALLS and tag not in WALLS and tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ENDS and any(live[c] for c in ENDS[tag][0]):
            closed, walls = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in walls:
                    break
                if stack[i][0] in closed:
                    drop(i)
                    if tag not in ("tr", "thead", "tbody", "tfoot", "dt", "dd", "optgroup"):
                        break
                    if tag in ("dt", "dd"):
                        break
        elif tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1) if live["p"] else ():
                if stack[i][0] == "p":
                    drop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                drop(len(stack) - 1)
        node = [tag, m[2], []]
        stack[-1][2].append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else size
            node[2].append(html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            close = page.find(">", stop)
            at = size if not end or close < 0 else close + 1
        elif tag not in VOID and not m[2].endswith("/") or tag in ("p", "div", "li"):
            stack.append(node)
            live[tag] += 1
    return root


def shown(tag: str, attrs: dict[str, str]) -> bool:
    return not ("hidden" in attrs or _NOT_SHOWN.search(attrs.get("style", ""))
                or tag == "input" and attrs.get("type", "").lower() == "hidden"
                or tag == "dialog" and "open" not in attrs)


class Page:
    """Lines of text in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.indent, self.marker = "", ""

    def text(self, text: str) -> None:
        words = _BLANK.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = words.endswith(" ")
        self.now.append(words[:-1] if self.space else words)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.marker + line).rstrip())
        self.marker = " " * len(self.marker) if not self.marker.isspace() else self.marker

    def end_line(self, force: bool = False) -> None:
        if self.now or force:
            self.put("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: bool) -> None:
        self.end_line()
        self.gap = self.gap or gap


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def render(root: list, depth: int = 0) -> str:
    """The visible text below a node."""
    page = Page()
    # entries: (node or string) to open, or a function to call when the children are done
    work: list = [root]
    pre = 0
    lists: list[list] = []

    def restore(indent, marker):
        def back():
            page.end_line()
            if page.marker and not page.marker.isspace():
                page.put("")
            page.indent, page.marker = indent, marker
        return back

    while work:
        node = work.pop()
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            if pre:
                first, *more = node.split("\n")
                page.now.append(first)
                for line in more:
                    page.end_line(True)
                    page.now.append(line)
            else:
                page.text(node)
            continue
        tag, attr_text, children = node
        if tag in UNSEEN:
            continue
        attrs = attributes(attr_text) if attr_text and not attr_text.isspace() else {}
        if attrs and not shown(tag, attrs) or tag == "dialog" and "open" not in attrs:
            continue
        if tag == "br":
            page.end_line(True)
        elif tag == "input":
            if attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search"):
                page.text(" " + attrs.get("value", "") + " ")
        elif tag == "table" and depth < NESTED_TABLES:
            page.block(True)
            for line in table_lines(node, depth):
                page.put(line)
            page.gap = True
        elif tag in BLOCKS or tag == "textarea":
            gap = tag in SPACED and not (tag in ("ul", "ol", "menu") and lists)
            page.block(gap)
            work.append(lambda gap=gap: page.block(gap))
            if tag == "pre" or tag == "textarea":
                pre += 1

                def leave():
                    nonlocal pre
                    pre -= 1
                work.append(leave)
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag, _number(attrs.get("start", ""), 1)])
                work.append(lists.pop)
            elif tag == "li":
                own = lists[-1] if lists else ["ul", 1]
                number = _number(attrs.get("value", ""), own[1])
                own[1] = number + 1
                work.append(restore(page.indent, page.marker))
                if page.marker and not page.marker.isspace():
                    page.put("")
                page.indent = (page.indent + page.marker)[:DEEPEST]
                page.marker = f"{number}. " if own[0] == "ol" else "- "
            elif tag in ("dd", "blockquote"):
                work.append(restore(page.indent, page.marker))
                page.indent, page.marker = (page.indent + page.marker + "  ")[:DEEPEST], ""
            elif tag == "details" and "open" not in attrs:
                children = [c for c in children if not isinstance(c, str) and c[0] == "summary"][:1]
            work.extend(reversed(children))
        else:
            if tag in ("button", "select", "optgroup"):
                page.space = True
            work.extend(reversed(children))
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def _rows(table: list):
    """(captions, rows): rows hold the cells of the table itself, those of head, body and foot in their order."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    captions, todo = [], [(c, "tbody") for c in reversed(table[2])]
    loose: list | None = None
    while todo:
        node, part = todo.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(node)
            continue
        tag, attr_text, children = node
        if tag in UNSEEN or attr_text and not shown(tag, attributes(attr_text)):
            continue
        if tag in parts:
            todo += [(c, tag) for c in reversed(children)]
        elif tag == "tr":
            loose = None
            parts[part].append([c for c in children if not isinstance(c, str) or c.strip()])
        elif tag in ("td", "th"):
            if loose is None:
                loose = []
                parts[part].append(loose)
            loose.append(node)
        else:
            captions.append(node)
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"]


def table_lines(table: list, depth: int) -> list[str]:
    captions, rows = _rows(table)
    lines = [x for c in captions for x in render(["div", "", [c]], depth + 1).split("\n") if x]
    grid: list[list[tuple[int, int, list[str]]]] = []
    below: dict[int, int] = {}
    for row in rows:
        column, out = 0, []
        for cell in row:
            while below.get(column, 0):
                column += 1
            if isinstance(cell, str) or cell[0] not in ("td", "th"):
                cell = ["td", "", [cell]]
            attrs = attributes(cell[1]) if cell[1] else {}
            if attrs and not shown(cell[0], attrs):
                continue
            wide = min(max(1, _number(attrs.get("colspan", ""), 1)), 1000)
            high = min(max(1, _number(attrs.get("rowspan", ""), 1)), 65534)
            out.append((column, wide, render(["div", "", cell[2]], depth + 1).split("\n")))
            for c in range(column, column + wide):
                below[c] = high
            column += wide
        below = {c: n - 1 for c, n in below.items() if n > 1}
        grid.append(out)
    widths: dict[int, int] = {}
    for row in grid:
        for column, wide, text in row:
            if wide == 1:
                longest = max(map(len, text))
                if longest <= WIDEST:
                    widths[column] = max(widths.get(column, 0), longest)
    used = sorted(widths)
    for row in grid:
        for k in range(max((len(t) for _, _, t in row), default=0)):
            line, at = [], 0
            for column, _, text in row:
                pad = sum(widths[c] + 2 for c in used[:_below(used, column)])
                line.append(" " * max(pad - at, 2 if line else 0))
                part = text[k] if k < len(text) else ""
                line.append(part)
                at = max(pad, at + 2 if len(line) > 2 else 0) + len(part)
            lines.append("".join(line).rstrip())
    return lines


def _below(values: list[int], x: int) -> int:
    low, high = 0, len(values)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if values[middle] < x else (low, middle)
    return low


def visible_text(page: str | None) -> str:
    """Text of one page; a null or empty page has none."""
    return render(parse(page)) if page else ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, text, n_chars, n_lines, text_sha256. Null and empty pages give the empty text with no
    lines; ids may be null or repeated."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [visible_text(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
                names=[id_col, "text", "n_chars", "n_lines", "text_sha256"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html")).mapInArrow(
        of, f"`{id_col}` {kind}, text string, n_chars long, n_lines long, text_sha256 string")
