"""HTML extraction: a tree builder with implied tags, then layout-aware rendering of visible text.

The builder closes paragraphs, list items, table parts and options where HTML implies it,
ignores stray end tags, and keeps raw text elements whole. Rendering walks the tree
without recursion: hidden elements (script, style, head, hidden attribute, display:none,
visibility:hidden, ...) give nothing; blocks begin on lines of their own, with a blank
line around paragraphs, headings, lists, quotes and tables; list items get their bullet
or number and indent; preformatted text keeps its white space; table cells are padded to
aligned columns, but none for a cell of over WIDEST characters, which bounds the padding.

Defined cases: null and empty HTML give ''; text without tags is returned with collapsed
white space; unclosed tags and comments end with the page; each row is rendered for
itself, repeated page_ids too; an empty table gives an empty result; other columns are
not read. Nesting of any depth and pages of any length are handled.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# fixed values: classes of elements after the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe object audio video canvas svg math noembed noframes param source track area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: start tag: (elements it closes, elements beyond which it doesn't look)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
#: characters of the widest cell that a column is aligned to
WIDEST = 80
P_SCOPE = frozenset("table td th caption button object".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_HIDING = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: up to the next semicolon outside quotes and brackets
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))+")
_START = re.compile(r"\bstart\s*=\s*[\"']?(-?\d+)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")


def attributes(source: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def hides(tag: str, source: str) -> bool:
    """Whether an element's own attributes hide it: hidden, an input's type, or CSS display and visibility."""
    if not _HIDING.search(source):
        return False
    own = attributes(source)
    if "hidden" in own or tag == "input" and own.get("type", "").strip().lower() == "hidden":
        return True
    rules: dict[str, tuple[bool, str]] = {}
    for part in _DECLARATION.findall(_COMMENT.sub(" ", own.get("style", ""))):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name = name.strip().lower()
        # the last counts, but for important ones
        if mark or not rules.get(name, (False, ""))[0]:
            rules[name] = bool(mark), value.strip().lower()
    return rules.get("display", (False, ""))[1] == "none" or rules.get("visibility", (False, ""))[1] in ("hidden", "collapse")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Open:
    """The open elements, and where the last of each name and of all blocks stand, so that no search walks them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, [0]).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these; 0 without any."""
        return max((self.places[t][-1] for t in tags if t in self.places), default=0)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tags, scope) -> None:
        at = self.last(tags)
        if at and at >= self.last(scope):
            self.cut(at)


def build_tree(source: str) -> Node:
    root = Node("#root")
    open_ = _Open(root)
    stack, close = open_.stack, open_.close
    at, end = 0, len(source)

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if slash:
            # td and the like don't end what stands outside their table
            k = open_.last([tag])
            bar = max(open_.last(["table"]), 0 if tag in BLOCK else open_.blocks[-1])
            if k and k >= bar:
                open_.cut(k)
            elif not bar and tag == "p":
                stack[-1].children.append(Node("p"))
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), P_SCOPE)
        if tag in IMPLIED:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close(frozenset(["td", "th"]), frozenset(["table"]))
                if tag != "tr":
                    close(frozenset(["tr"]), frozenset(["table"]))
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            open_.push(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
            node.children.append(source[at : stop.start()])
            at = stop.end()
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            open_.push(node)
    return root


class _Flow:
    """Lines of one flow of blocks; a table cell has a flow of its own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str) -> None:
        pieces = _WHITE.split(s)
        if len(pieces) == 1 and not s:
            return
        if pieces[0] == "" and len(pieces) > 1:
            self.space = True
        words = [p for p in pieces if p]
        if words:
            self.parts.append((" " if self.space and self.parts else "") + " ".join(words))
            self.space = pieces[-1] == ""

    def end_line(self, force: bool = False) -> None:
        if self.parts or force:
            self.put("".join(self.parts))
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append((self.indent + self.mark + line).rstrip())
        self.mark = " " * len(self.mark) if self.mark.strip() else self.mark

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to their column's width; a cell over WIDEST counts for no column and isn't padded, nor cut."""
    width: list[int] = []
    for r in rows:
        for i, c in enumerate(r):
            if i == len(width):
                width.append(0)
            if len(c) <= WIDEST:
                width[i] = max(width[i], len(c))
    return ["  ".join(c.ljust(w) for c, w in zip(r, width, strict=False)).rstrip() for r in rows]


def render(root: Node) -> str:
    flow = _Flow()
    flows: list[_Flow] = []
    tables: list[list[list[str]]] = []
    lists: list[list] = []
    pre = 0
    work: list = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            s = html.unescape(node) if "&" in node else node
            if pre:
                head, *more = s.replace("\r\n", "\n").split("\n")
                if head:
                    flow.parts.append(head)
                for x in more:
                    flow.end_line(force=True)
                    if x:
                        flow.parts.append(x)
            else:
                flow.text(s)
            continue
        tag = node.tag
        if not leaving:
            if tag in HIDDEN or node.attrs and hides(tag, node.attrs):
                continue
            if tag == "br":
                flow.end_line(force=True)
                continue
            if tag in BLOCK:
                flow.end_line()
                if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                    flow.blank = True
            if tag in ("td", "th") and tables:
                flows.append(flow)
                flow = _Flow()
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu"):
                start = _START.search(node.attrs)
                lists.append([tag == "ol", int(start[1]) if start else 1, flow.indent, flow.mark])
                flow.indent, flow.mark = flow.indent + " " * len(flow.mark), ""
            elif tag == "li":
                own = lists[-1] if lists else [False, 1, "", ""]
                flow.mark = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
            elif tag in ("blockquote", "dd"):
                flow.indent += "  "
            elif tag == "pre":
                pre += 1
            elif tag == "q":
                flow.text('"')
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag in BLOCK:
            flow.end_line()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1):
                flow.blank = True
        if tag in ("td", "th") and tables and flows:
            cell = " ".join(flow.done().split())
            flow = flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(cell)
        elif tag == "table":
            for line in _aligned([r for r in tables.pop() if any(r)]):
                flow.put(line)
            flow.blank = True
        elif tag in ("ul", "ol", "menu"):
            _, _, flow.indent, flow.mark = lists.pop()
            flow.mark = " " * len(flow.mark)
        elif tag == "li":
            flow.mark = ""
        elif tag in ("blockquote", "dd"):
            flow.indent = flow.indent[:-2]
        elif tag == "pre":
            pre -= 1
        elif tag == "q":
            flow.parts.append('"')
    return flow.done().strip("\n")


def html_to_text(source: str | None) -> str:
    return render(build_tree(source)) if source else ""


def _extract(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array([html_to_text(x) for x in part["html"].to_pylist()], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, html): page_id, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, text string")
