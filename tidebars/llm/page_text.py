"""Visible text of web pages, laid out as it is seen."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebars.llm.texts import keyed_texts

# Elements by how they are laid out.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "iframe", "noembed", "noframes", "datalist", "object", "svg", "math", "audio", "video", "canvas", "meta", "link"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "blockquote", "table", "figure", "fieldset", "hr", "form", "menu"}
BLOCK = SPACED | {"html", "body", "div", "article", "section", "nav", "header", "footer", "main", "aside", "address", "li", "dt", "dd", "figcaption", "details", "summary",
                  "center", "legend", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "dialog", "hgroup", "search"}
# An opening tag ends open elements of the second set, down to one of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
# Block elements end an open paragraph within the same cell or item.
ENDS_P = (BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}) | {"li", "dt", "dd"}
HOLDS_P = {"td", "th", "table", "caption", "button", "object", "template", "html", "body"}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}

WIDEST = 60
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<(!--|[!?/])")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(\s*=\s*)?")
_HIDING = re.compile(r"(display\s*:\s*none|visibility\s*:\s*(hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place after the tag's end."""
    found: dict[str, str] = {}
    n = len(page)
    while at < n:
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        if not m:
            at += 1
            continue
        at, value = m.end(), ""
        if m[2] and at < n:
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return found, n  # an open quote takes the rest
                value, at = page[at + 1:end], end + 1
            else:
                end = at
                while end < n and page[end] not in " \t\n\r\f>":
                    end += 1
                value, at = page[at:end], end
        found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return found, n


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text" | "open" | "close", text or name, attributes)."""
    at, n = 0, len(page)
    lower = None
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", page[at:m.start()], {}
        if m[3]:
            end = page.find("-->", m.end()) if m[3] == "!--" else page.find(">", m.end())
            at = n if end < 0 else end + (3 if m[3] == "!--" else 1)
            continue
        name = m[2].lower()
        if m[1]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            yield "close", name, {}
            continue
        attributes, at = ({}, m.end() + 1) if page[m.end():m.end() + 1] == ">" else _attributes(page, m.end())
        yield "open", name, attributes
        if name in RAW:
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = lower.find(f"</{name}", at) if name != "plaintext" else -1
            end = n if end < 0 else end
            yield "text", page[at:end], {}
            at = end
    if at < n:
        yield "text", page[at:], {}


def _unseen(name: str, a: dict[str, str]) -> bool:
    return (name in UNSEEN or "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or (name == "dialog" and "open" not in a)
            or ("style" in a and _HIDING.search(a["style"]) is not None))


def tree_events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The element tree as opening, text and closing events, properly nested: elements
    that tags imply are opened and closed, stray closing tags are left out."""
    stack: list[str] = []
    count: Counter[str] = Counter()  # open elements by name

    def push(name: str) -> None:
        stack.append(name)
        count[name] += 1

    def close_to(depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(stack) > depth:
            count[stack[-1]] -= 1
            yield "close", stack.pop(), {}

    def last(names: set[str], stop: set[str]) -> int:
        if not any(count[x] for x in names):
            return -1
        for d in range(len(stack) - 1, -1, -1):
            if stack[d] in names:
                return d
            if stack[d] in stop:
                return -1
        return -1

    for kind, name, a in _tokens(page):
        if kind == "text":
            if stack and stack[-1] == "head" and name.strip():
                yield from close_to(len(stack) - 1)
            yield kind, name, a
            continue
        if kind == "close":
            if name in ("html", "body"):
                continue  # what follows still belongs to the body
            stop = {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th", "caption"} if name != "table" else set()
            d = last({name}, stop - {name})
            if d >= 0:
                yield from close_to(d)
            elif name == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            continue
        if stack and stack[-1] == "head" and name not in HEAD_ONLY:
            yield from close_to(len(stack) - 1)
        if name in ("html", "body") and count[name]:
            continue
        if name in ENDS_P and (d := last({"p"}, HOLDS_P)) >= 0:
            yield from close_to(d)
        if name in IMPLIED_ENDS:
            ends, stop = IMPLIED_ENDS[name]
            if "table" in stop and last({"table"}, set()) < 0:
                continue  # a cell or row outside a table is no element
            while (d := last(ends, stop)) >= 0:
                yield from close_to(d)
            if name in ("td", "th") and last({"tr"}, {"table"}) < 0:
                push("tr")
                yield "open", "tr", {}
        yield "open", name, a
        if name in VOID:
            yield "close", name, {}
        else:
            push(name)
    yield from close_to(0)


class _Flow:
    """Lines of one flow of text: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = True  # the line so far ends in white space, or is empty
        self.blank = False

    def text(self, s: str, pre: bool, start: str) -> None:
        if pre:
            for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end(keep=True)
                if line:
                    self._put(line, start)
            return
        s = _SPACE.sub(" ", s)
        if self.gap:
            s = s.lstrip(" ")
        if s:
            self._put(s, start)

    def _put(self, s: str, start: str) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.now.append(start)
        self.now.append(s)
        self.gap = s[-1] == " "

    def end(self, keep: bool = False, blank: bool = False) -> None:
        """The line ends; ``keep``: also an empty one; ``blank``: a space follows."""
        if self.now or keep:
            self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.gap = [], True
        self.blank = self.blank or blank

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells (lines each) as lines with columns one under the other. A cell wider
    than ``WIDEST`` sets no column's width, so lines don't grow with the longest cell."""
    widths: dict[int, int] = {}
    for row in rows:
        for k, cell in enumerate(row):
            widths[k] = max([widths.get(k, 0), *[len(x) for x in cell if len(x) <= WIDEST]])
    out = []
    for row in rows:
        for i in range(max((len(c) for c in row), default=0)):
            line = [(c[i] if i < len(c) else "").ljust(widths[k]) for k, c in enumerate(row)]
            out.append(" | ".join(line).rstrip(" ") if len(row) > 1 else line[0].rstrip(" "))
    return out


def visible_text(page: str) -> str:
    """All text of a page that is seen. Blocks have lines of their own, paragraphs,
    headings, lists and tables blank lines around them; list items are marked and
    indented, numbered ones numbered; table cells stand in aligned columns."""
    flows = [_Flow()]
    lists: list[list] = []  # [kind, next number]
    tables: list[list[list[list[str]]]] = []
    opened: list[tuple[str, bool]] = []
    unseen = pre = 0
    folded: list[int] = []  # depths of closed details
    marker = ""

    def start() -> str:
        nonlocal marker
        depth = "  " * max(len(lists) - 1, 0) if len(flows) == 1 or not tables else ""
        s, marker = (depth + marker, "") if marker else (depth + "  " * bool(lists), "")
        return s

    for kind, name, a in tree_events(page):
        if kind == "text":
            if not unseen and (name.strip(" \t\n\r\f") or not flows[-1].gap):
                if folded and not (opened and any(n == "summary" for n, _ in opened[folded[-1]:])):
                    continue
                s = unescape(name) if "&" in name else name
                flow = flows[-1]
                flow.text(s, pre > 0, start() if not flow.now and s.strip(" \t\n\r\f") else "")
            continue
        if kind == "open":
            hide = _unseen(name, a)
            opened.append((name, hide))
            unseen += hide
            if unseen:
                continue
            flow = flows[-1]
            if name == "br":
                flow.end(keep=True)
            elif name in ("ul", "ol", "menu"):
                flow.end(blank=not lists)
                number = a.get("start", "1").strip()
                lists.append([name, int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1])
            elif name == "li":
                flow.end()
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    marker = "- "
            elif name == "table":
                flow.end(blank=True)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables and tables[-1]:
                flows.append(_Flow())
            elif name in BLOCK:
                flow.end(blank=name in SPACED)
            pre += name in ("pre", "textarea", "xmp", "plaintext")
            if name == "details" and "open" not in a:
                folded.append(len(opened))
            continue
        name, hide = opened.pop()
        if unseen:
            unseen -= hide
            continue
        flow = flows[-1]
        pre -= name in ("pre", "textarea", "xmp", "plaintext")
        if folded and folded[-1] > len(opened):
            folded.pop()
        if name in ("ul", "ol", "menu"):
            lists.pop()
            flow.end(blank=not lists)
        elif name in ("td", "th") and tables and tables[-1] and len(flows) > 1:
            tables[-1][-1].append(flows.pop().done())
        elif name == "table" and tables:
            rows = tables.pop()
            for line in _aligned(rows):
                flow.end()
                flow._put(line, "") if line else flow.end(keep=True)
            flow.end(blank=True)
        elif name in BLOCK and name != "tr":
            flow.end(blank=name in SPACED)
    return "\n".join(flows[0].done())


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``text`` of every page: all its visible text, laid out.

    The project stores no web pages, so this is general. Missing and empty pages have
    an empty text, keys may be missing or repeat, other columns are left out. No page
    needs another, so nothing is shuffled; work grows with a page's length.
    """
    rows = keyed_texts(pages, key, html)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                texts = pa.array([visible_text(x.as_py()) for x in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["key", "text"])

    return rows.mapInArrow(each, T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])).withColumnRenamed("key", key)
