"""HTML extraction by layout: a small tree builder, visibility rules and a text renderer.

Tags are read as browsers do in the common cases: void elements, raw text in
script and style, and end tags implied by what follows (p, li, dt, dd, option,
table parts). Invisible are head parts, scripts, styles, templates, comments,
closed dialogs, and elements hidden by attribute, inline style or the page's own
style rules on tags, classes and ids; what is made visible again inside an element
of hidden visibility is emitted. Everything else is emitted in
order: blocks on their own lines, paragraphs and headings apart by an empty
line, list items with bullets or numbers (from the list's start or their own
value) indented by nesting, preformatted text as it is, text of svg and math, and
tables with their cells aligned in columns, cells that span columns or rows
included. A cell of more than ALIGNED characters in a line goes over its column's
edge, so that no line is padded to it; its text is whole.

Nulls: a null page has a null text and 0 blocks; an empty one an empty text. An
empty table gives no rows. Pages of any length and depth are rendered whole: lists,
quotes and tables within LEVELS others of their kind get no further marks and
columns, but each block, item and cell still has lines of its own. NUL characters
go, as in browsers. Repeated rows are rendered alike; columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

#: Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript meta link iframe object audio video canvas datalist noembed noframes annotation annotation-xml".split()
)
SVG_HIDDEN = frozenset("desc defs metadata symbol".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = APART | frozenset("html body div article section nav header footer aside main address li dt dd form details summary figcaption center tr caption legend menu dir hgroup option optgroup svg:text".split())
CLOSES_P = BLOCK - frozenset("html body tr caption legend option optgroup svg:text".split())
#: An opening tag ends these open elements, up to a border.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPES = frozenset("table td th html body button".split())
LEVELS = 60
ALIGNED = 120
#: Fixed limits of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|([^<]++)|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_INTEGER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_SHOWS = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STYLE_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:[.#][a-zA-Z_-][\w-]*)*)\Z")


def _declared(style: str) -> dict[str, tuple[bool, bool]]:
    """display and visibility of a style's declarations: whether they show, and whether they are important."""
    return {k.lower(): (v.lower() not in (("none",) if k.lower() == "display" else ("hidden", "collapse")), bool(strong)) for k, v, strong in _SHOWS.findall(style)}


class Styles:
    """The rules of a page's style elements that show or hide, for selectors of one element: a tag, classes, an id.

    Rules within at-rules (other media) and for elements within others are left out.
    """

    def __init__(self):
        self.rules: list[tuple[str, frozenset[str], frozenset[str], dict, tuple]] = []

    def read(self, text: str) -> None:
        text, kept, depth, at_rule = _COMMENT.sub(" ", text), [], 0, False
        for piece in re.split(r"([{}])", text):
            if piece == "{":
                depth += 1
            elif piece == "}":
                depth = max(depth - 1, 0)
            elif not depth:
                head = piece.rpartition(";")[2] if "@" in piece else piece
                at_rule = head.lstrip().startswith("@")
            if not at_rule:
                kept.append(piece if depth or piece in "{}" else head)
        for selectors, body in _STYLE_RULE.findall("".join(kept)):
            if declared := _declared(body):
                for selector in selectors.split(","):
                    if (m := _SELECTOR.match(selector.strip())) and m[0]:
                        names = re.findall(r"[.#][^.#]+", m[2])
                        ids, classes = (frozenset(n[1:] for n in names if n[0] == c) for c in "#.")
                        tag = (m[1] or "*").lower()
                        self.rules.append((tag, ids, classes, declared, (len(ids), len(classes), tag != "*", len(self.rules))))

    def of(self, node: Node) -> dict[str, bool]:
        """display and visibility of an element, where a rule or its own style sets them."""
        found: dict[str, tuple] = {}
        if self.rules:
            ids, classes = {node.attribute("id")}, set((node.attribute("class") or "").split())
            for tag, its_ids, its_classes, declared, weight in self.rules:
                if tag in ("*", node.tag) and its_ids <= ids and its_classes <= classes:
                    for k, (shows, strong) in declared.items():
                        found[k] = max(found.get(k, ()), (strong, False, weight, shows))
        for k, (shows, strong) in _declared(node.attribute("style") or "").items() if node.attributes else ():
            found[k] = max(found.get(k, ()), (strong, True, (), shows))
        return {k: v[-1] for k, v in found.items()}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        for key, value in _ATTRIBUTE.findall(self.attributes) if name in self.attributes.lower() else ():
            if key.lower() == name:
                return unescape(value.strip("\"'"))
        return None

    def number(self, name: str) -> int | None:
        found = _INTEGER.match(self.attribute(name) or "")
        return int(found[1]) if found else None

    def shown(self, styles: Styles) -> tuple[bool, bool | None]:
        """Whether the element is displayed, and whether its text is made visible or hidden (None: as around it)."""
        if self.tag in HIDDEN:
            return False, None
        if not self.attributes and not styles.rules:
            return self.tag != "dialog", None
        if self.attribute("hidden") is not None or self.tag == "dialog" and self.attribute("open") is None:
            return False, None
        set_ = styles.of(self)
        return set_.get("display", True), set_.get("visibility")


def parse(html: str) -> tuple[Node, Styles]:
    """The element tree of a page, and its own style rules."""
    root, styles = Node("#root"), Styles()
    stack, at = [root], 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # by tag: where in the stack it is open

    def drop(i: int) -> None:
        for node in reversed(stack[i:]):
            places[node.tag].pop()
        del stack[i:]

    def last(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def close(names, borders) -> None:
        """Ends all open elements of these names up to a border."""
        border, first = last(borders), 0
        while (i := last(names)) > border:
            first = i
            drop(first)

    while m := _TOKEN.match(html, at):
        at = m.end()
        end, tag, attributes, text = m.groups()
        if text is not None:
            stack[-1].children.append(text)
        elif tag is None:
            if m[0] == "<":
                stack[-1].children.append("<")
        elif end:
            tag = tag.lower()
            if tag == "text" and places["svg:text"]:
                tag = "svg:text"
            if places[tag] and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or places[tag][-1] >= last(("table", "td", "th"))):
                drop(places[tag][-1])
        else:
            tag = tag.lower()
            if tag in CLOSES_P:
                close({"p"}, SCOPES)
            if tag in IMPLIED_END:
                close(*IMPLIED_END[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
            if (tag in SVG_HIDDEN or tag == "text") and places["svg"]:
                attributes, tag = (attributes, "svg:text") if tag == "text" else (f" hidden {attributes}", tag)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                stop = re.compile(f"</{tag}", re.I).search(html, at)
                node.children.append(html[at : stop.start() if stop else len(html)])
                at = stop.start() if stop else len(html)
                if tag == "style":
                    styles.read(node.children[0])
                push(node)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                push(node)
    return root, styles


class Renderer:
    """Lines of text; a block break starts a new line, an apart break also leaves one empty."""

    def __init__(self, styles: Styles, level: int = 0, seen: bool = True):
        self.styles, self.level, self.seen = styles, level, seen
        self.lines: list[str] = []
        self.inline: list[str | None] = []  # None is a line break
        self.gap = False
        self.blocks = 0

    def flush(self) -> None:
        if not self.inline:
            return
        parts: list[list[str]] = [[]]
        for x in self.inline:
            if x is None:
                parts.append([])
            else:
                parts[-1].append(x)
        self.inline = []
        lines = [_SPACES.sub(" ", "".join(p).replace("\0", "")).strip(" ") for p in parts]
        filled = [i for i, line in enumerate(lines) if line]
        if filled:
            self.add(lines[filled[0] : filled[-1] + 1])

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.blocks += 1
        self.lines += lines

    def nested(self, node: Node, seen: bool) -> list[str]:
        inner = Renderer(self.styles, self.level + 1, seen)
        inner.walk(node)
        inner.flush()
        self.blocks += inner.blocks
        return inner.lines

    def walk(self, top: Node) -> None:
        """Renders what is in an element; plain blocks and inline elements of any depth need no recursion."""
        # Open elements: the node, its children, the next number of a list, whether text is visible, and the break after it.
        open_ = [(top, iter(top.children), _first_number(top), self.seen, None)]
        deep = self.level >= LEVELS
        while open_:
            node, children, number, seen, after = open_[-1]
            child = next(children, None)
            if child is None:
                open_.pop()
                if after is not None:
                    self.flush()
                    self.gap |= after
                continue
            if isinstance(child, str):
                if seen:
                    self.inline.append(unescape(child) if "&" in child else child)
                continue
            tag = child.tag
            displayed, visible = child.shown(self.styles)
            if not displayed:
                continue
            visible = seen if visible is None else visible
            if tag == "br":
                self.inline.append(None)
            elif tag == "img":
                self.inline.append((child.attribute("alt") or "") if visible else "")
            elif tag == "input":
                if visible and (child.attribute("type") or "").lower() in ("submit", "button", "reset"):
                    self.inline.append(child.attribute("value") or "")
            elif tag not in BLOCK and not (deep and tag in ("td", "th")):
                open_.append((child, iter(child.children), None, visible, None))
            else:
                self.flush()
                apart = tag in APART and not (tag in ("ul", "ol", "dl") and node.tag == "li")
                self.gap |= apart
                if tag == "pre":
                    self.raw(child, visible)
                elif tag == "hr":
                    self.whole(["---"])
                elif deep or tag not in ("table", "li", "dd", "blockquote"):
                    open_.append((child, iter(child.children), _first_number(child), visible, apart))
                    continue
                elif tag == "table":
                    self.whole(self.aligned(child, visible))
                elif tag == "li":
                    own = child.number("value")
                    now = number if own is None and number is not None else own or 0
                    if number is not None:
                        step = -1 if node.attribute("reversed") is not None else 1
                        open_[-1] = (node, children, now + step, seen, after)
                    mark = f"{now}. " if node.tag == "ol" else "- "
                    lines = self.nested(child, visible)
                    self.whole([(mark if i == 0 else " " * len(mark)) + line if line else line for i, line in enumerate(lines)])
                else:
                    self.whole(["    " + line if line else line for line in self.nested(child, visible)])
                self.flush()
                self.gap |= apart

    def whole(self, lines: list[str]) -> None:
        """Adds lines whose indentation stays."""
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.blocks += 1
            self.lines += [line.rstrip(" ") for line in lines]

    def raw(self, node: Node, seen: bool) -> None:
        """Preformatted text as it is; blocks within it have lines of their own."""
        text: list[str] = []
        open_ = [(iter(node.children), seen, False)]

        def fresh_line() -> None:
            if text and not next((t for t in reversed(text) if t), "\n").endswith("\n"):
                text.append("\n")

        while open_:
            children, visible, block = open_[-1]
            x = next(children, None)
            if x is None:
                open_.pop()
                if block:
                    fresh_line()
            elif isinstance(x, str):
                text.append(unescape(x).replace("\0", "") if visible else "")
            elif x.tag == "br":
                text.append("\n")
            else:
                displayed, own = x.shown(self.styles)
                own = visible if own is None else own
                if displayed and x.tag == "img":
                    text.append((x.attribute("alt") or "") if own else "")
                elif displayed:
                    if x.tag in BLOCK:
                        fresh_line()
                    open_.append((iter(x.children), own, x.tag in BLOCK))
        self.whole("".join(text).replace("\r\n", "\n").strip("\n").split("\n"))

    def aligned(self, table: Node, seen: bool) -> list[str]:
        rows, captions = [], []
        # What lies between the parts of a table comes before it, as in browsers.
        stray = Node("#stray")

        def leave(visible: bool) -> None:
            if stray.children:
                captions.extend(self.nested(stray, visible))
                stray.children = []

        def cell(node: Node, visible: bool) -> tuple[list[str], int, int]:
            """The cell's lines and how many columns and rows it spans."""
            columns, down = (min(max(node.number(k) or 1, 1), most) for k, most in (("colspan", MOST_COLUMNS), ("rowspan", MOST_ROWS)))
            return self.nested(node, visible), columns, down

        # Parts of the table that are open: their children, whether text is visible, and the row that cells go to.
        open_: list[tuple[Iterator, bool, list | None]] = [(iter(table.children), seen, None)]
        while open_:
            children, around, row = open_[-1]
            child = next(children, None)
            if child is None:
                open_.pop()
                continue
            if isinstance(child, str):
                stray.children.append(child if around else "")
                continue
            displayed, visible = child.shown(self.styles)
            visible = around if visible is None else visible
            if not displayed:
                continue
            if child.tag in ("td", "th"):
                if row is None:  # in a form outside rows
                    rows.append([cell(child, visible)])
                else:
                    row.append(cell(child, visible))
            elif child.tag == "form":
                open_.append((iter(child.children), visible, row))
            elif row is None and child.tag == "tr":
                rows.append([])
                open_.append((iter(child.children), visible, rows[-1]))
            elif row is None and child.tag == "caption":
                leave(around)
                captions.extend(self.nested(child, visible))
            elif row is None and child.tag in ("tbody", "thead", "tfoot"):
                open_.append((iter(child.children), visible, None))
            else:
                stray.children.append(child)

        leave(seen)
        placed, held = [], {}  # held: for a column, how many rows a cell above still takes
        for r in rows:
            at, line = 0, []
            for lines, columns, down in r:
                while held.get(at, 0) > 0:
                    at += 1
                line.append((at, columns, lines))
                at += columns
            for c in [c for c in held if held[c] > 0]:
                held[c] -= 1
            for (c, columns, _), (_, _, down) in zip(line, r):
                if down > 1:
                    held.update({x: max(held.get(x, 0), down - 1) for x in range(c, c + columns)})
            placed.append(line)
        width: Counter[int] = Counter()
        for line in placed:
            for c, columns, lines in line:
                if columns == 1:
                    width[c] = max(width[c], max((len(x) for x in lines if len(x) <= ALIGNED), default=0))
        edge = [0]
        for c in range(max((c + columns for line in placed for c, columns, _ in line), default=0)):
            edge.append(edge[-1] + (width[c] + 2 if width[c] else 0))
        out = list(captions)
        for line in placed:
            for i in range(max((len(lines) for _, _, lines in line), default=0)):
                text: list[str] = []
                end = 0
                for c, _, lines in line:
                    if i < len(lines) and lines[i]:
                        # At its column's edge, or two blanks after what goes over it.
                        begin = max(edge[c], end + 2 if end else 0)
                        text.append(" " * (begin - end) + lines[i])
                        end = begin + len(lines[i])
                out.append("".join(text))
        return out


def _first_number(node: Node) -> int | None:
    """The number of a list's first item."""
    if node.tag not in ("ol", "ul", "menu", "dir"):
        return None
    start = node.number("start")
    if start is None and node.attribute("reversed") is not None:
        return sum(not isinstance(x, str) and x.tag == "li" for x in node.children)
    return 1 if start is None else start


def rendered(html: str) -> tuple[str, int]:
    """The visible text of a page and its number of blocks."""
    root, styles = parse(html)
    renderer = Renderer(styles)
    renderer.walk(root)
    renderer.flush()
    return "\n".join(renderer.lines), renderer.blocks


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())]


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without its html, with text and n_blocks."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [(None, 0) if h is None else rendered(h) for h in batch.column(html_col).to_pylist()]
            return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())]

        return compute

    return append_columns(df, FIELDS, make).drop(html_col)


def op8_html_extraction(spark, sf_dir):
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", "n_blocks", F.length("text").cast("long").alias("n_chars"))
