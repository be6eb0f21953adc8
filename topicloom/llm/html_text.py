"""Layout-aware text of HTML pages.

A tree is built with the tags that authors leave out (ends of paragraphs, list items, cells, rows, options), then
rendered as a reader would see it: hidden parts go, blocks stand on lines of their own with blank lines around
paragraphs and headings, list items are marked and indented, table cells are padded to columns, preformatted text
keeps its spaces.

Scale: one pass over the pages, no shuffle; a task holds a few MB of pages. Both the builder and the
renderer keep their own stacks, so that depth is bounded by memory only, and take time in proportion to the page.

Defined results: null or empty HTML gives an empty text; unclosed tags, comments and quotes end with the page;
stray end tags are ignored; style sheets count by the cascade for display and visibility (importance, inline styles, specificity, order),
at top level or in @media blocks for all media or screens without further conditions; selectors may join tags, classes and
ids, and chain them as descendants or children - all others and all other at-rules hide nothing, so that text is rather
kept; visibility is inherited, so that a visible part of a hidden one is shown; cells span at most 1000 columns, as the
standard has it; repeated rows are rendered each; an empty table gives an empty table; other
columns pass through, except the output name.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from topicloom.llm._common import text_slices

#: Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title datalist noframes noembed iframe object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form fieldset legend figcaption details summary dt dd li center tr caption dialog menu hgroup select option optgroup".split())
#: A start tag ends open elements of these names, looked for up to the named borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["thead"]
#: Fixed value: columns that a cell may span.
SPAN = 1000
#: A block's start tag ends an open paragraph, unless one of these stands between.
P_BORDERS = frozenset("button td th caption table object applet marquee".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)|["'])*+)(>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s/=>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"^\s*(display|visibility)\s*:\s*([a-z-]+)\b[^!]*+(!\s*important)?", re.I)
_CSS = re.compile(r"""/\*(?:.*?\*/|.*)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[{};]""", re.S)
_MEDIA = re.compile(r"@media\b(.*)", re.I | re.S)
_COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*+)?((?:[.#][\w-]++)*+)$", re.I)
_CHAIN = re.compile(r"\s*(>)\s*|\s+")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attributes, self.parent, self.children, self.visible = tag, attributes, parent, [], True


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _on_screens(prelude: str) -> bool:
    """Whether an at-rule's block holds on screens whatever their size: @media with all or screen among its list."""
    m = _MEDIA.match(prelude)
    return bool(m) and any(x.strip().lower() in ("", "all", "screen", "only screen", "only all") for x in m[1].split(","))


def declarations(parts: Iterable[str]) -> dict[str, tuple[bool, str]]:
    """Whether display and visibility are important, and their values; the last one counts, an important one before all."""
    out: dict[str, tuple[bool, str]] = {}
    for part in parts:
        if m := _STYLE.match(part):
            name, mine = m[1].lower(), (bool(m[3]), m[2].lower())
            if mine[0] or not out.get(name, (False,))[0]:
                out[name] = mine
    return out


class Styles:
    """The rules of a page's style sheets that set display or visibility, by what the last part of their selectors needs."""

    def __init__(self) -> None:
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        self.count = 0

    def add(self, prelude: str, body: list[str]) -> None:
        if not (found := declarations(body)):
            return
        for selector in prelude.split(","):
            steps, weight = [], [0, 0, 0]
            parts = _CHAIN.split(selector.strip())  # compounds with the combinators between them
            for k in range(0, len(parts), 2):
                m = _COMPOUND.match(parts[k])
                if not parts[k] or not m:
                    break
                names = re.findall(r"[.#][\w-]+", m[2])
                tag = (m[1] or "*").lower()
                steps.append((parts[k - 1] if k else None, tag, frozenset(names)))
                for n in names:
                    weight[n[0] == "."] += 1
                weight[2] += tag != "*"
            else:
                self.count += 1
                _, tag, names = steps[-1]
                key = next((n for n in sorted(names)), tag)
                self.rules[key].append((tuple(weight), self.count, steps, found))

    def read(self, sheet: str) -> None:
        """The rules of a sheet, read with their nesting."""
        text: list[str] = []  # since the last brace or semicolon
        blocks: list[tuple[str, bool]] = []  # open blocks: their preludes, whether rules in them count
        declared: list[list[str]] = []
        at = 0

        def end(prelude: str, counts: bool, body: list[str]) -> None:
            if counts and not prelude.startswith("@"):
                self.add(prelude, body)

        for m in _CSS.finditer(sheet):
            text.append(sheet[at : m.start()])
            at = m.end()
            mark = m[0]
            if mark not in ("{", "}", ";"):
                text.append("" if mark.startswith("/*") else mark)
                continue
            words = "".join(text).strip()
            text = []
            if mark == "{":
                outer = not blocks or (blocks[-1][1] and blocks[-1][0].startswith("@"))
                blocks.append((words, outer and (not words.startswith("@") or _on_screens(words))))
                declared.append([])
            elif blocks:
                declared[-1].append(words)
                if mark == "}":
                    end(*blocks.pop(), declared.pop())
        if blocks:  # a sheet that ends within a rule
            declared[-1].append("".join([*text, sheet[at:]]).strip())
            end(*blocks[-1], declared[-1])

    def of(self, node: Node) -> dict[str, str]:
        """The values of display and visibility that win for the node."""
        won: dict[str, tuple] = {}
        if self.rules:
            for key in _names(node) | {node.tag, "*"}:
                for weight, order, steps, found in self.rules.get(key, ()):
                    if _matches(node, steps):
                        for name, (important, value) in found.items():
                            won[name] = max(won.get(name, (False,)), (important, False, weight, order, value))
        if style := node.attributes.get("style"):
            for name, (important, value) in declarations(style.split(";")).items():
                won[name] = max(won.get(name, (False,)), (important, True, (), 0, value))
        return {name: x[-1] for name, x in won.items()}


def _names(node: Node) -> set[str]:
    """The node's classes and id as selectors name them."""
    a = node.attributes
    out = {"." + c for c in a["class"].split()} if "class" in a else set()
    if "id" in a:
        out.add("#" + a["id"])
    return out


def _matches(node: Node | None, steps: list[tuple]) -> bool:
    """Whether a chain of compounds, each a descendant or child of the one before, ends at the node."""
    fits = lambda x, step: x.tag != "#root" and step[1] in ("*", x.tag) and step[2] <= _names(x)
    if not fits(node, steps[-1]):
        return False
    # Of several ancestors that fit a descendant step the nearest is taken, unless a child step before it fails there.
    states = [(node, len(steps) - 1)]
    while states:
        x, k = states.pop()
        if k == 0:
            return True
        up, child = x.parent, steps[k][0] == ">"
        while up is not None:
            if fits(up, steps[k - 1]):
                states.append((up, k - 1))
                if steps[k - 1][0] != ">":
                    break
            if child:
                break
            up = up.parent
    return False


def parse(page: str) -> tuple[Node, Styles]:
    """The tree, and the rules of its style sheets."""
    root = Node("#root", {})
    stack, open_tags, styles = [root], Counter(), Styles()
    at, n = 0, len(page)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def close(names, borders) -> None:
        """End open elements of ``names`` down to the nearest border."""
        if not any(open_tags[x] for x in names):
            return
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders:
                break
            if stack[i].tag in names:
                lowest = i
        if lowest is not None:
            pop_to(lowest)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if lt > at:
            stack[-1].children.append(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in VOID and tag != "br":
                continue
            if tag == "br":
                stack[-1].children.append(Node("br", {}, stack[-1]))
            elif open_tags[tag]:
                border = {"table"} if tag not in ("table", "html", "body", "div", "section", "article", "main") else set()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if stack[i].tag in border:
                        break
            continue
        if rule := CLOSES.get(tag):
            close(*rule)
        if tag in BLOCK and tag not in ("html", "body", "li", "dt", "dd", "tr", "caption", "select", "option", "optgroup"):
            close({"p"}, P_BORDERS)
        node = Node(tag, _attributes(m[3]), stack[-1])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "style":
                styles.read(page[at:stop])
            else:
                node.children.append(page[at:stop] if tag in ("xmp",) else html.unescape(page[at:stop]))
            gt = page.find(">", stop) if end else -1
            at = n if gt < 0 else gt + 1
            continue
        stack.append(node)
        open_tags[tag] += 1
    return root, styles


def is_hidden(node: Node, styles: Styles) -> bool:
    """Whether the node and all in it is left out; sets whether the node's own text is visible."""
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "input":
        return True
    won = styles.of(node) if styles.rules or "style" in a else {}
    own = won.get("visibility", "inherit")
    node.visible = own in ("visible", "initial") or (own not in ("hidden", "collapse") and (node.parent is None or node.parent.visible))
    if "display" in won:
        return won["display"] == "none"
    return "hidden" in a or (node.tag == "dialog" and "open" not in a)


def shown_width(text: str) -> int:
    """Columns on a screen: wide East Asian characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of one flow of blocks; ``gap`` is the number of blank lines due before the next text."""

    __slots__ = ("gap", "line", "lines", "space")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, text: str) -> None:
        if not (words := _SPACE.sub(" ", text)):
            return
        if words[0] == " ":
            self.space = bool(self.line)
            words = words[1:]
        if words:
            if self.space:
                self.line.append(" ")
            self.space = words[-1] == " "
            self.line.append(words[:-1] if self.space else words)

    def end_line(self, blank: int = 0, force: bool = False) -> None:
        if self.line or force:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, blank)

    def add(self, lines: list[str], blank: int = 0) -> None:
        self.end_line(blank)
        if lines:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.lines.extend(lines)
            self.gap = blank

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _table(rows: list[list[list[str]]]) -> list[str]:
    """Cells padded to columns, two spaces between; a cell may have several lines."""
    rows = [r for r in rows if any(any(c) for c in r)]
    width = [0] * max((len(r) for r in rows), default=0)
    for r in rows:
        for i, c in enumerate(r):
            width[i] = max([width[i], *map(shown_width, c)])
    out = []
    for r in rows:
        for k in range(max(map(len, r), default=0)):
            cells = [c[k] if k < len(c) else "" for c in r]
            out.append("  ".join(c + " " * (w - shown_width(c)) for c, w in zip(cells, width, strict=False)).rstrip())
    return out


def render(root: Node, styles: Styles) -> str:
    flows: list[_Flow] = [_Flow()]
    tables: list[list[list[list[str]]]] = []
    counters: list[int | None] = []
    pre = 0
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if pre:
                for k, part in enumerate(node.split("\n")):
                    if k:
                        flow.end_line(force=True)
                    if part:
                        flow.line.append(part)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if is_hidden(node, styles):
                continue
            if tag == "br":
                flow.end_line(force=node.visible)
                continue
            if tag == "hr":
                flow.add(["---"] if node.visible else [], 1)
                continue
            if tag in VOID:
                continue
            if tag in ("td", "th"):
                if not tables:
                    flow.end_line()
                flows.append(_Flow())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("li", "dd"):
                flow.end_line()
                flows.append(_Flow())
            elif tag in BLOCK:
                flow.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 0)
            if tag == "table":
                tables.append([])
            elif tag in ("blockquote", "caption"):
                flows.append(_Flow())
            elif tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                counters.append(int(start) if tag == "ol" and start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 10 else 1 if tag == "ol" else None)
            elif tag == "pre":
                pre += 1
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children) if node.visible or not isinstance(c, str))
            continue
        if tag in ("td", "th"):
            lines = flows.pop().done()
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                span = node.attributes.get("colspan", "1")
                tables[-1][-1].append(lines)
                tables[-1][-1].extend([] for _ in range(min(int(span), SPAN) - 1 if span.isascii() and span.isdigit() and len(span) < 10 else 0))
            else:
                flows[-1].add(lines)
        elif tag == "li":
            lines = flows.pop().done()
            mark = "- "
            if counters and counters[-1] is not None:
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            flows[-1].add([(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(lines)])
        elif tag == "dd":
            flows[-2].add(["    " + x if x else x for x in flows.pop().done()])
        elif tag == "table":
            flows[-1].add(_table(tables.pop()))
            flows[-1].gap = max(flows[-1].gap, 1)
        elif tag == "blockquote":
            flows[-2].add(["> " + x if x else ">" for x in flows.pop().done()], 1)
        elif tag == "caption":
            flows[-2].add(flows.pop().done())
        else:
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag == "pre":
                pre -= 1
            if tag in BLOCK:
                flow.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 0)
    return "\n".join(flows[0].done()).strip("\n")


def page_text(page: str | None) -> str:
    """All visible text of a page."""
    return render(*parse(page)) if page else ""


def _render(html_col: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, html_col):
                columns = {n: part.column(n) for n in part.schema.names if n != out}
                columns[out] = pa.array([page_text(x.as_py()) for x in part.column(html_col)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` in column ``out`` (last)."""
    fields = [f for f in pages.schema.fields if f.name != out]
    return pages.mapInArrow(_render(html_col, out), T.StructType([*fields, T.StructField(out, T.StringType())]))
