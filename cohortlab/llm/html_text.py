"""Layout-aware HTML rendering: all visible text of a page with the layout a reader sees.

A tree builder adds what HTML leaves implied (ends of paragraphs, list items, cells, rows and options; rows
around loose cells; what is loose in a table goes before it; a form there opens nothing) and ignores stray end tags. Visibility rules
drop elements that a browser does not render: the head, scripts, styles, templates, closed parts of details,
``hidden`` elements, and those for which the winning declaration (importance, inline before #id before .class
before tag, then order) of the inline style and of simple selectors in the page's style sheets says
``display: none`` or ``visibility: hidden``. Sheets and ``@media`` blocks count if they hold on a screen
``SCREEN`` pixels wide; other at-rules, nested rules and sheets of noscript and templates do not count. Of SVG the text
elements and foreign objects are shown (where they stand, not where ``use`` repeats them), of MathML all but
annotations and phantoms. Rendering collapses blanks as CSS does, separates
blocks by line breaks or blank lines, marks and indents list items, keeps preformatted text and lays
tables out in aligned columns with spans.

Defined cases: null or empty html gives an empty title and text; unclosed or crossed tags never fail; nesting
may be as deep as it likes (tables below ``NESTED`` levels of tables are laid out as plain blocks); repeated
rows give one row each; other columns are ignored.
"""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlab.llm.common import map_arrow

NESTED = 20
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist".split())
#: Elements of SVG and MathML that show nothing by themselves.
FOREIGN_HIDDEN = frozenset("annotation annotation-xml mphantom defs desc metadata symbol clippath mask pattern marker filter lineargradient radialgradient".split())
#: Elements of SVG and MathML whose content is HTML again, and tags that end SVG and MathML elsewhere.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split())
#: Width of the screen for media queries, in pixels; pixels of a unit; media types and display values that count.
SCREEN = 1280
UNITS = {"px": 1, "em": 16, "rem": 16}
MEDIA = frozenset(("", "all", "screen"))
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group "
    "table-footer-group table-column table-column-group table-caption list-item contents flow flow-root ruby ruby-text math -webkit-box "
    "-webkit-inline-box -webkit-flex -webkit-inline-flex initial inherit unset revert revert-layer".split())
VISIBILITIES = frozenset("visible hidden collapse initial inherit unset revert revert-layer".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
ENDS_P = BLOCKS - frozenset("body html li dd dt td th tr thead tbody tfoot caption option optgroup legend summary".split())
#: Element -> (open elements that it ends, elements that shield those).
IMPLIED = {
    "li": ({"li"}, LISTS | {"table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption button".split())
IN_TABLE = frozenset("table tbody thead tfoot tr".split())
#: Parts of a table that end what is open between them and the table's innermost open part; where the search for that ends.
PARTS = frozenset("td th tr tbody thead tfoot caption colgroup".split())
CELLS = frozenset("td th caption template button".split())
#: Elements whose content is text up to their end tag; references count in the second set only.
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
#: A comment, a tag with its attributes, or other markup; what the end of the page cuts off is dropped.
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?)*+)>"
    r"|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*\Z)", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_BLANK = " \t\n\r\f"
_RUNS = re.compile(r"[ \t\n\r\f]+")
_DECIDES = re.compile(r"display|visibility", re.I)
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|url\([^\"')]*\)|[{};]", re.S | re.I)
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:([^!]*)(!\s*important\s*)?", re.I)
_FEATURE = re.compile(r"\(\s*(min-|max-)?width\s*:\s*(\d+(?:\.\d+)?)(px|r?em)\s*\)")
_SIMPLE = re.compile(r"[.#]?[A-Za-z_][\w-]*")


class Node:
    __slots__ = ("tag", "attrs", "kids", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.tag, self.attrs, self.kids, self.foreign = tag, attrs, [], foreign


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def on_screen(media: str) -> bool:
    """Does a list of media queries hold on a screen ``SCREEN`` pixels wide? Unknown features do not hold."""
    for query in media.lower().split(","):
        kind, *features = re.split(r"\band\b", query)
        kind = kind.strip()
        if kind.startswith("("):
            kind, features = "", [kind, *features]
        flipped = kind.startswith("not ")
        known = [_FEATURE.fullmatch(f.strip()) for f in features]
        if not all(known):
            continue
        kind = re.sub(r"^(?:not|only)\s+", "", kind)
        if flipped and kind.startswith("("):
            continue
        holds = kind in MEDIA
        for m in known:
            wide = float(m[2]) * UNITS[m[3]]
            holds = holds and (SCREEN >= wide if m[1] == "min-" else SCREEN <= wide if m[1] else SCREEN == wide)
        if holds != flipped:
            return True
    return False


def declared(declarations) -> list[tuple[str, bool, bool]]:
    """(property, important, hides) of the valid declarations of display and visibility."""
    out = []
    for x in declarations:
        if m := _DECLARATION.fullmatch(x):
            name, value = m[1].lower(), m[2].lower()
            words = value.split()
            valid = "var(" in value or words and all(w in (DISPLAYS if name == "display" else VISIBILITIES) for w in words)
            if valid:
                out.append((name, bool(m[3]), words == ["none"] if name == "display" else words in (["hidden"], ["collapse"])))
    return out


def sheet_rules(css: str):
    """(selectors, declarations) of the rules that count on screen, in order."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S)
    todo: list[tuple[bool, str | None, list[str]]] = [(True, None, [])]  # open blocks: counts, selectors of a rule, its declarations
    at = 0
    for m in _CSS.finditer(css):
        if m[0] not in "{};":
            continue
        counts, names, body = todo[-1]
        text, at = css[at : m.start()], m.end()
        if m[0] == "{":
            text = text.strip()
            if names is not None or text[:1] == "@":
                media = names is None and re.match(r"@media\b", text, re.I)
                todo.append((bool(counts and media and on_screen(text[6:])), None, []))
            else:
                todo.append((counts, text, []))
        else:
            if names is not None:
                body.append(text)
            if m[0] == "}" and len(todo) > 1:
                todo.pop()
                if names is not None and counts:
                    yield names, body
    if todo[-1][0] and todo[-1][1] is not None:  # the end of the sheet ends its last rule
        yield todo[-1][1], [*todo[-1][2], css[at:]]


class Builder:
    """Builds the tree; ``hiding`` gathers what style sheets declare of simple selectors: property -> (important, order, hides)."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.hiding: dict[str, dict[str, tuple[bool, int, bool]]] = {}
        self.order = 0

    def feed(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if not m:
                return
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.handle_endtag(tag)
                    continue
                self.handle_starttag(tag, attributes(m[3]) if m[3] else {})
                if m[3] and m[3][-1] == "/" and self.open[-1].foreign and self.open[-1].tag == tag and [a.end() for a in _ATTR.finditer(m[3])][-1:] != [len(m[3])]:
                    self.open.pop()  # <path/> ends at once
                    continue
                if tag in RAW or tag in TEXT_ONLY:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    text = html[at : end.start() if end else size]
                    at = end.start() if end else size
                    if text:
                        self.handle_data(unescape(text) if tag in TEXT_ONLY else text)

    def _end(self, tags, shields) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in shields:
                return

    def _push(self, node: Node) -> None:
        self.open[-1].kids.append(node)
        self.open.append(node)

    def handle_starttag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        foreign = self.open[-1].foreign and self.open[-1].tag not in INTEGRATION
        if foreign and tag in BREAKOUT:
            foreign = False
            while self.open[-1].foreign and self.open[-1].tag not in INTEGRATION:
                self.open.pop()
        if foreign or tag == "svg" or tag == "math":
            node = Node(tag, attrs, True)
            self._parent(tag).append(node)
            self.open.append(node)
            return
        if tag in ENDS_P:
            self._end({"p"}, SCOPE)
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.open.pop()
        if tag == "table" and self.open[-1].tag in IN_TABLE:
            self._end({"table"}, ())
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in PARTS and self.open[-1].tag not in IN_TABLE:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in IN_TABLE:
                    del self.open[i + 1 :]
                    break
                if self.open[i].tag in CELLS:
                    break
        if tag in ("td", "th") and self.open[-1].tag in IN_TABLE and self.open[-1].tag != "tr":
            self._push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            self._parent(tag).append(node)
        elif tag == "form" and self.open[-1].tag in IN_TABLE:
            self.open[-1].kids.append(node)
        else:
            if self.open[-1].tag in IN_TABLE and tag not in IN_TABLE and tag not in ("td", "th", "caption", "colgroup", "script", "style", "template"):
                self._parent(tag).append(node)
                self.open.append(node)
            else:
                self._push(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].kids.append(Node("p", {}))
            return
        if tag == "br":
            self.open[-1].kids.append(Node("br", {}))
            return
        if tag not in ("html", "body"):
            # inline elements end within their block only
            shields = {"table"} if tag in IN_TABLE else SCOPE if tag in BLOCKS or tag in ("svg", "math", "foreignobject") else BLOCKS
            self._end({tag}, shields - {tag})

    def _parent(self, tag: str) -> list:
        """Where loose content of a table goes: before the table."""
        if self.open[-1].tag in IN_TABLE and tag not in ("col",):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    kids, table = self.open[i - 1].kids, self.open[i]
                    if kids and kids[-1] is table:
                        kids.pop()
                        spare = Node("span", {})
                        kids += [spare, table]
                        return spare.kids
        return self.open[-1].kids

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "style" and _DECIDES.search(data):
            self._sheet(top, data)
        if top.tag == "colgroup" and data.strip(_BLANK):
            top = self.open[-2]
            self.open.pop()
        if top.tag in IN_TABLE:
            if data.strip(_BLANK):
                self._parent("").append(data)
        else:
            top.kids.append(data)


    def _sheet(self, style: Node, css: str) -> None:
        if style.attrs.get("type", "text/css").strip().lower() not in ("", "text/css") or not on_screen(style.attrs.get("media", "")):
            return
        if any(n.tag in ("noscript", "template") for n in self.open):
            return
        for names, body in sheet_rules(css):
            for prop, important, hides in declared(body):
                self.order += 1
                for name in names.split(","):
                    name = name.strip()
                    if _SIMPLE.fullmatch(name):
                        own = self.hiding.setdefault(name if name[0] in ".#" else name.lower(), {})
                        own[prop] = max(own.get(prop, (False, 0, False)), (important, self.order, hides))


def visible(node: Node, hiding: dict[str, dict[str, tuple[bool, int, bool]]]) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in HIDDEN or node.foreign and tag in FOREIGN_HIDDEN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False
    if not attrs and tag not in hiding:
        return True
    style = attrs.get("style")
    if style is not None and not _DECIDES.search(style):
        style = None
    if style is None and not (hiding and (tag in hiding or "#" + attrs.get("id", "") in hiding or any("." + c in hiding for c in attrs.get("class", "").split()))):
        return "hidden" not in attrs
    # of each property the largest (important, rank of the origin, order) wins
    won = {"display": ((False, -1, 0), "hidden" in attrs), "visibility": ((False, -1, 0), False)}
    if hiding:
        matching = [(0, tag), *[(1, "." + c) for c in attrs.get("class", "").split()], (2, "#" + attrs.get("id", ""))]
        for rank, name in matching:
            for prop, (important, order, hides) in hiding.get(name, {}).items():
                won[prop] = max(won[prop], ((important, rank, order), hides))
    if style is not None:
        parts, at = [], 0
        for m in _CSS.finditer(style):
            if m[0] == ";":
                parts.append(style[at : m.start()])
                at = m.end()
        for order, (prop, important, hides) in enumerate(declared([*parts, style[at:]])):
            won[prop] = max(won[prop], ((important, 3, order), hides))
    return not (won["display"][1] or won["visibility"][1])


def svg_shown(svg: Node, hiding: dict) -> list:
    """The text elements and foreign objects of an SVG image, apart from each other."""
    out, todo = [" "], list(reversed(svg.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or not visible(x, hiding):
            continue
        if x.tag in ("text", "foreignobject"):
            out += [x, " "]
        else:
            todo += reversed(x.kids)
    return out


class Page:
    """Lines of text under way."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.blank = "", 0, False
        self.indent, self.marker = "", ""

    def gap_of(self, lines: int) -> None:
        if lines:
            self.gap, self.blank = max(self.gap, lines), False

    def _break(self) -> None:
        if self.gap:
            if self.now:
                self.lines.append(self.now.rstrip(_BLANK))
                self.now = ""
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def text(self, data: str) -> None:
        words = _RUNS.sub(" ", data)
        if words == " " or not words:
            self.blank = self.blank or bool(words)
            return
        lead = words[0] == " " or self.blank
        self._break()
        if not self.now:
            self.now, self.marker = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent, ""
        elif lead and not self.now.endswith(" "):
            self.now += " "
        self.now += words.strip(" ")
        self.blank = words[-1] == " "

    def line(self, data: str) -> None:
        """A line as it is."""
        self._break()
        if self.now:
            self.lines.append(self.now.rstrip(_BLANK))
        head, self.marker = (self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent), ""
        self.now = ""
        self.lines.append((head + data).rstrip(_BLANK))
        self.blank = False

    def newline(self) -> None:
        self._break()
        self.lines.append(self.now.rstrip(_BLANK))
        self.now, self.blank = "", False

    def done(self) -> list[str]:
        out = self.lines + ([self.now.rstrip(_BLANK)] if self.now else [])
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def rendered(root: Node, hiding: dict, depth: int = 0) -> list[str]:
    """Lines of a node's content."""
    page, pre = Page(), 0
    counters: list[int | None] = []
    todo: list[tuple[str, object]] = [("in", k) for k in reversed(root.kids)]
    while todo:
        step, x = todo.pop()
        if step == "out":
            node, indent, counted = x
            page.indent, page.marker = indent, ""
            if counted:
                counters.pop()
            pre -= node.tag in ("pre", "textarea")
            page.gap_of(2 if node.tag in SPACED and not (node.tag in LISTS and counters) else 1 if node.tag in BLOCKS else 0)
            continue
        if isinstance(x, str):
            if pre:
                parts = x.split("\n")
                for i, part in enumerate(parts):
                    if i:
                        page.newline()
                    if part:
                        page._break()
                        page.now = (page.now or page.indent) + part
            else:
                page.text(x)
            continue
        if not visible(x, hiding):
            continue
        tag = x.tag
        if tag == "br":
            page.newline()
            continue
        if tag == "hr":
            page.gap_of(2)
            continue
        if tag == "img":
            page.text(x.attrs.get("alt", ""))
            continue
        if tag == "input":
            if x.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", ""):
                page.text(x.attrs.get("value", ""))
            continue
        if tag in BLOCKS:
            page.gap_of(2 if tag in SPACED and not (tag in LISTS and counters) else 1)
        if tag == "table" and depth < NESTED:
            for line in table_lines(x, hiding, depth + 1):
                page.line(line)
            page.gap_of(2)
            continue
        kids = x.kids
        if tag == "details" and "open" not in x.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        elif x.foreign and tag == "svg":
            kids = svg_shown(x, hiding)
        elif x.foreign and tag in ("mtr", "mtd"):
            page.text(" ")
        before, counted = page.indent, tag in LISTS
        if counted:
            counters.append(_number(x.attrs.get("start"), 1) if tag == "ol" else None)
        elif tag == "li":
            if counters and counters[-1] is not None:
                n = _number(x.attrs.get("value"), counters[-1])
                counters[-1] = n + 1
                page.marker = f"{n}. "
            else:
                page.marker = "- "
            page.indent += " " * len(page.marker)
        elif tag in ("dd", "blockquote"):
            page.indent += "  "
        pre += tag in ("pre", "textarea")
        todo.append(("out", (x, before, counted)))
        todo += [("in", k) for k in reversed(kids)]
    return page.done()


def table_lines(table: Node, hiding: dict, depth: int) -> list[str]:
    """Captions and what is loose in the table, then its rows; cells may lie below any wrapper."""
    rows, captions = [], []
    todo = list(reversed(table.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip(_BLANK):
                captions.append(_RUNS.sub(" ", x).strip(_BLANK))
            continue
        if not visible(x, hiding):
            continue
        if x.tag in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append(x)
        elif x.tag == "caption":
            captions += rendered(x, hiding, depth)
        elif x.tag == "table" or x.tag in VOID:
            loose = Node("div", {})
            loose.kids.append(x)
            captions += rendered(loose, hiding, depth)
        else:
            if x.tag == "tr":
                rows.append([])
            todo += reversed(x.kids)
    taken: dict[tuple[int, int], bool] = {}
    cells: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, span, lines
    for r, row in enumerate(rows):
        c, out = 0, []
        for cell in row:
            while (r, c) in taken:
                c += 1
            wide, tall = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000), min(max(_number(cell.attrs.get("rowspan"), 1), 1), len(rows) - r)
            for i in range(tall):
                for j in range(wide):
                    taken[r + i, c + j] = True
            out.append((c, wide, rendered(cell, hiding, depth)))
            c += wide
        cells.append(out)
    width: dict[int, int] = {}
    for spanning in (False, True):
        for row in cells:
            for c, wide, lines in row:
                if (wide > 1) == spanning:
                    spare = sum(width.get(c + j, 0) + 2 for j in range(wide - 1))  # of the columns before the span's last
                    width[c + wide - 1] = max(width.get(c + wide - 1, 0), max(map(len, lines), default=0) - spare)
    start, at = {}, 0
    for c in range(max(width, default=-1) + 2):
        start[c] = at
        at += width.get(c, 0) + 2
    out = captions
    for row in cells:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(start.get(c, len(line))) + lines[i]
            out.append(line)
    return out


def parsed(html: str) -> Builder:
    builder = Builder()
    builder.feed(html)
    return builder


def elements(root: Node):
    """All elements in document order."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]


def title_of(root: Node) -> str:
    for x in elements(root):
        if x.tag == "title":
            return _RUNS.sub(" ", "".join(k for k in x.kids if isinstance(k, str))).strip(_BLANK)
    return ""


def text_of(builder: Builder) -> str:
    return "\n".join(rendered(builder.root, builder.hiding))


def render(html: str) -> tuple[str, str]:
    """(title, visible text)."""
    builder = parsed(html)
    return title_of(builder.root), text_of(builder)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text of every row of pages (page_id, html)."""

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            both = [render(h or "") for h in some.column(1).to_pylist()]
            yield pa.record_batch([some.column(0), pa.array([t for t, _ in both], type=pa.string()), pa.array([x for _, x in both], type=pa.string())], ["page_id", "title", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return map_arrow(pages.select("page_id", "html"), run, f"page_id {kind}, title string, text string")
