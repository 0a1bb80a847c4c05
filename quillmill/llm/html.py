"""Layout-aware HTML rendering.

A tree is built from the tags (implied end tags, void elements, raw text elements, stray end tags), visibility rules
drop what a browser would not show, and the rest is written as text: blocks start on lines of their own, paragraphs,
headings, lists, tables and quotes keep a blank line around them, list items get bullets or numbers and an indent for
each level, preformatted text keeps its white space, and table cells are padded to the widths of their columns
(colspan and rowspan kept). Cells without a row get one, rows within other elements (forms) count as the table's, and
text or elements misplaced between cells are written before their table, as browsers do.

Null pages give null text, empty ones empty text. Broken markup never fails: what can't be a tag is text. Repeated
rows give repeated results; an empty table gives an empty one. The tree and the renderer use no recursion, tables
within tables included, so depth is bounded by memory alone.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from collections.abc import Generator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import map_batches, table

# Fixed values of the HTML standard: void elements, raw text elements, elements that are not rendered.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video object canvas svg param source track area base link meta rp".split())
# Elements that stand on lines of their own: with a blank line around them, or with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav option search section summary tr caption thead tbody tfoot textarea".split())
CLOSES_P = (BLOCKS - {"body", "html", "option", "textarea", "tr", "caption", "thead", "tbody", "tfoot"}) | {"plaintext"}
# What a start tag ends: open elements of these names, looked for up to the nearest of the bounding names.
CELL, ROW, GROUP = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELL | {"caption"}, frozenset(("tr", "table"))),
    "th": (CELL | {"caption"}, frozenset(("tr", "table"))),
    "tr": (CELL | ROW | {"caption"}, frozenset(("table",))),
    **{g: (CELL | ROW | GROUP | {"caption", "colgroup"}, frozenset(("table",))) for g in GROUP},
    "table": (frozenset(("table",)), CELL | {"caption"}),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small strike strong sub sup tt u var".split())
SCOPES = frozenset(("table", "td", "th", "caption", "html", "template", "button"))

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)>""", re.S)
HIDES = re.compile(r"""(?:^|[\s"'/])hidden(?!\s*=\s*["']?until-found)(?=[\s=/]|$)""", re.I)
STYLE = re.compile(r"""(?:^|[\s"'/])style\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", re.I)
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
SPACES = re.compile(r"[ \t\n\r\f]+")


def attribute(attrs: str, name: str) -> str | None:
    """The value of an attribute ('' where it stands alone), or None."""
    m = re.search(rf"""(?:^|[\s"'/]){name}(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", attrs, re.I)
    return None if m is None else unescape(next((g for g in m.groups() if g is not None), ""))


def whole(attrs: str, name: str, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", attribute(attrs, name) or "")
    return max(least, min(most, int(m[1]))) if m else default


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def build(html: str) -> Node:
    root = Node("#root")
    stack, open_tags, pos, n = [root], {}, 0, len(html)

    def pop_to(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    def find(names, bounds) -> int:
        """The depth of the nearest open element of these names above any of bounds, or 0."""
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in names:
                return d
            if stack[d].tag in bounds:
                return 0
        return 0

    while pos < n:
        m = TOKEN.search(html, pos)
        at = m.start() if m else n
        if at > pos:
            stack[-1].kids.append(html[pos:at])
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif open_tags.get(tag):
                d = find((tag,), () if tag in SCOPES or tag in ("tr", "body") else ("table",) if tag in GROUP else SCOPES)
                if d and not (tag in INLINE and any(x.tag in BLOCKS for x in stack[d:])):  # a mark that ends within a block doesn't end the block
                    pop_to(d)
            elif tag == "p":
                stack[-1].kids.append(Node("p"))
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if rule := ENDS.get(tag):
            names, bounds = rule
            while d := find(names, bounds):
                pop_to(d)
        if tag in CLOSES_P and open_tags.get("p") and (d := find(("p",), SCOPES)):
            pop_to(d)
        if tag == "body" and open_tags.get("head") and (d := find(("head",), ())):
            pop_to(d)
        if tag in ("a", "button") and open_tags.get(tag) and (d := find((tag,), SCOPES - {"button"})):
            pop_to(d)
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = None if tag == "plaintext" else RAW_END[tag].search(html, pos)
            end = close.start() if close else n
            if end > pos:
                node.kids.append(html[pos:end])
            close = html.find(">", end)
            pos = n if close < 0 else close + 1
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def declared(css: str, name: str) -> str | None:
    """The value that holds of a property's declarations in a style (lower-case, no spaces): the last important one, else
    the last."""
    found = re.findall(rf"(?:^|;){name}:([\w-]+)(!important)?", css)
    return next((v for v, important in reversed(found) if important), found[-1][0] if found else None)


def hidden(node: Node) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in UNSEEN:
        return True
    if not attrs:
        return tag == "dialog"
    if "idden" in attrs.lower() and HIDES.search(re.sub(r"""=\s*("[^"]*"|'[^']*')""", "=", attrs)):
        return True
    if tag == "dialog":
        return attribute(attrs, "open") is None
    if tag == "input":
        return (attribute(attrs, "type") or "").lower() == "hidden"
    if (m := STYLE.search(attrs)) and (css := (m[1] or m[2] or m[3] or "").lower().replace(" ", "")):
        return declared(css, "display") == "none"
    return False


def unseen_text(node: Node, unseen: bool) -> bool:
    """Whether visibility hides the text of node; children may turn it on again."""
    if "visibility" in node.attrs.lower() and (m := STYLE.search(node.attrs)):
        found = declared((m[1] or m[2] or m[3] or "").lower().replace(" ", ""), "visibility")
        if found:
            return found in ("hidden", "collapse")
    return unseen


class Writer:
    """Text with collapsed white space, pending line breaks and indents."""

    def __init__(self):
        self.out, self.breaks, self.space, self.indent, self.marker, self.fresh = [], 0, False, "", "", True

    def gap(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def lead(self) -> None:
        if self.breaks or self.fresh:
            if not self.fresh:
                self.out.append("\n" * self.breaks)
            mark, self.marker = self.marker, ""
            self.out.append(self.indent[: len(self.indent) - len(mark)] + mark if mark else self.indent)
            self.breaks, self.fresh, self.space = 0, False, False

    def text(self, s: str) -> None:
        if "&" in s:
            s = unescape(s)
        words = SPACES.sub(" ", s)
        body = words.strip(" ")
        if not body:
            self.space = self.space or (bool(words) and not self.breaks and not self.fresh)
            return
        glued = words[0] != " " and not self.space
        started = not (self.breaks or self.fresh)
        self.lead()
        if started and not glued:
            self.out.append(" ")
        self.out.append(body.replace("\xa0", " "))
        self.space = words[-1] == " "

    def lines(self, lines: list[str]) -> None:
        for i, line in enumerate(lines):
            if i:
                self.breaks = max(self.breaks, 1)
                if not line.strip():
                    self.breaks += 1
                    continue
            if line.strip():
                self.lead()
                self.out.append(line.rstrip())

    def value(self) -> str:
        return "".join(self.out)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def number(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        return letters(n).upper() if kind == "A" else letters(n)
    if kind in ("i", "I") and 0 < n < 4000:
        return roman(n).upper() if kind == "I" else roman(n)
    return str(n)


def columns(s: str) -> int:
    """Columns that s takes: wide characters take two, combining marks none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def table_parts(table: Node, unseen: bool) -> tuple[list, list, list]:
    """What stands before the table, its captions and its rows (head, body, foot), each with its row group, and each cell
    with whether visibility hides it. Cells without a row make one; rows and cells are found through other elements, such as forms; all else within
    the table but outside of its cells and captions is misplaced and goes before the table."""
    before, captions, groups, implied = [], [], {"thead": [], "tbody": [], "tfoot": []}, None
    todo = [(k, before, ("tbody", table), None, unseen) for k in reversed(table.kids)]
    while todo:
        node, out, group, row, unseen = todo.pop()
        if isinstance(node, str):
            if out is not before or node.strip(" \t\n\r\f"):
                out.append(node)
            continue
        tag = node.tag
        part = tag in groups or tag == "tr" or tag in CELL or tag == "caption"
        if tag in UNSEEN or (part and hidden(node)):
            continue
        if tag == "caption":
            captions.append((node, unseen_text(node, unseen)))
        elif tag in CELL:
            if row is None:
                if implied is None or implied[0] is not group[1]:
                    implied = (group[1], [])
                    groups[group[0]].append(implied)
                row = implied[1]
            row.append((node, unseen_text(node, unseen)))
        elif part:
            implied = None
            if tag == "tr":
                row = []
                groups[group[0]].append((group[1], row))
            else:
                group, row = (tag, node), None
            todo += [(k, before, group, row, unseen_text(node, unseen)) for k in reversed(node.kids)]
        elif tag == "table" or tag in VOID or tag in RAW:
            out.append(node)
        else:
            rest = Node(tag, node.attrs)
            if tag != "colgroup":
                out.append(rest)
            todo += [(k, before if tag == "colgroup" else rest.kids, group, row, unseen) for k in reversed(node.kids)]
    return before, captions, groups["thead"] + groups["tbody"] + groups["tfoot"]


def worked(job: Generator) -> str:
    """Runs a job that yields the jobs whose results it needs, however deep they are nested."""
    stack, result = [job], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as done:
            stack.pop()
            result = done.value
    return result


def table_lines(captions: list, rows: list) -> Generator:
    grid, held, group = [], {}, None  # held: rows that a cell above still takes, by column
    for of, row in rows:
        if of is not group:  # no cell reaches beyond its row group
            group, held = of, {}
        cells, col = [], 0
        for cell, unseen in row:
            while held.get(col):
                col += 1
            wide, high = whole(cell.attrs, "colspan", 1, 1, 1000), whole(cell.attrs, "rowspan", 1, 0, 65534) or 1 << 30  # 0: to the end of the group
            text = yield render(cell, unseen)
            cells.append((col, wide, text.split("\n")))
            for c in range(col, col + wide):
                held[c] = max(held.get(c, 0), high)
            col += wide
        grid.append(cells)
        held = {c: h - 1 for c, h in held.items() if h > 1}
    width: dict[int, int] = {}
    for cells in grid:
        for col, wide, lines in cells:
            if wide == 1:
                width[col] = max(width.get(col, 0), *map(columns, lines))
    for cells in grid:
        for col, wide, lines in cells:
            if wide > 1:  # what a spanning cell needs beyond its columns goes to the last of them
                short = max(map(columns, lines)) - sum(width.get(c, 0) for c in range(col, col + wide)) - 2 * (wide - 1)
                if short > 0:
                    width[col + wide - 1] = width.get(col + wide - 1, 0) + short
    used = sorted(c for c, w in width.items() if w)
    out = []
    for caption, unseen in captions:
        text = yield render(caption, unseen)
        out += text.split("\n")
    at, x = {}, 0
    for c in used:
        at[c] = x
        x += width[c] + 2
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, taken = [], 0
            for col, wide, lines in cells:
                if k < len(lines) and lines[k].strip():
                    start = next((at[c] for c in range(col, col + wide) if c in at), taken)
                    line.append(" " * (start - taken) + lines[k].rstrip())
                    taken = max(start, taken) + columns(lines[k].rstrip())
            out.append("".join(line))
    return [line for line in out if line.strip()]


def render(root: Node, unseen: bool = False) -> Generator:
    w = Writer()
    stack: list[tuple] = [(k, unseen, False, None) for k in reversed(root.kids)]
    while stack:
        node, unseen, pre, arg = stack.pop()
        if isinstance(node, str):
            if unseen:
                continue
            if pre:
                parts = (unescape(node) if "&" in node else node).replace("\r\n", "\n").expandtabs(4).split("\n")
                if len(parts) > 1 or not w.fresh:
                    for i, part in enumerate(parts):
                        if i:
                            w.breaks += 1
                        if part.strip():
                            w.lead()
                            w.out.append(part.rstrip() if i < len(parts) - 1 else part)
                else:
                    w.lead()
                    w.out.append(parts[0])
            else:
                w.text(node)
            continue
        tag = node.tag
        if tag == "#end":
            w.indent = arg[0]
            w.gap(arg[1])
            continue
        if tag == "#grid":
            w.gap(2)
            w.lines((yield table_lines(*arg)))
            w.gap(2)
            continue
        if hidden(node):
            continue
        above, unseen = unseen, unseen_text(node, unseen)
        if tag == "br":
            w.breaks, w.space = w.breaks + 1, False
            continue
        if tag == "wbr":
            continue
        if tag == "img":
            if not unseen and (alt := attribute(node.attrs, "alt")):
                w.text(alt)
            continue
        if tag == "input":
            if not unseen and (attribute(node.attrs, "type") or "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
                w.text(attribute(node.attrs, "value") or "")
            continue
        if tag == "hr":
            w.gap(2)
            if not unseen:
                w.lead()
                w.out.append("-" * 20)
            w.gap(2)
            continue
        if tag == "table":
            before, captions, rows = table_parts(node, unseen)
            stack.append((Node("#grid"), unseen, pre, (captions, rows)))
            stack += [(k, above, pre, None) for k in reversed(before)]
            continue
        kids = node.kids
        if tag == "details" and attribute(node.attrs, "open") is None:
            kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
        if tag == "q":
            kids = ["“", *kids, "”"]
        if tag in BLOCKS or tag in CELL:
            gap, old = 2 if tag in SPACED else 1, w.indent
            if tag in ("ul", "ol", "menu", "dir"):
                gap = 1 if arg else 2  # a list within an item follows it without a blank line
                count = sum(not isinstance(k, str) and k.tag == "li" for k in kids)
                down = tag == "ol" and attribute(node.attrs, "reversed") is not None
                n, kind, marked = whole(node.attrs, "start", count if down else 1, -(10**8), 10**8), attribute(node.attrs, "type") or "1", []
                for k in kids:
                    mark = None
                    if not isinstance(k, str) and k.tag == "li" and not hidden(k):
                        n = whole(k.attrs, "value", n, -(10**8), 10**8) if tag == "ol" and k.attrs else n
                        mark = f"{number(n, kind)}. " if tag == "ol" else "- "
                        n += -1 if down else 1
                    marked.append((k, mark))
                w.gap(gap)
                stack.append((Node("#end"), unseen, pre, (old, gap)))
                stack += [(k, unseen, pre, m or "list") for k, m in reversed(marked)]
                continue
            w.gap(gap)
            inner = None
            if tag == "li":
                mark = arg if arg and arg != "list" else "- "
                w.indent, w.marker, inner = old + " " * len(mark), mark, "item"
            elif tag in ("blockquote", "dd"):
                w.indent = old + "  "
            pre = pre or tag in ("pre", "xmp", "textarea", "plaintext")
            if pre and kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids = [kids[0][1:], *kids[1:]]
            stack.append((Node("#end"), unseen, pre, (old, gap)))
            stack += [(k, unseen, pre, inner) for k in reversed(kids)]
            continue
        stack += [(k, unseen, pre, arg) for k in reversed(kids)]
    return w.value().strip("\n").rstrip()


def to_text(html: str | None) -> tuple[str | None, str | None]:
    """A page's title and its visible text."""
    if html is None:
        return None, None
    root = build(html)
    title, todo = None, [root]
    while todo and title is None:
        node = todo.pop()
        if node.tag == "title":
            title = SPACES.sub(" ", unescape("".join(k for k in node.kids if isinstance(k, str)))).strip()
        elif node.tag in ("#root", "html", "head"):
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return title, worked(render(root))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, title, text of each page, in one pass without a shuffle."""

    def make():
        def each(ids, pages):
            done = [to_text(h) for h in pages]
            return [ids, [d[0] for d in done], [d[1] for d in done]]

        return each

    return map_batches(pages.select(F.col(id_col).cast("long"), F.col(html_col)), "id long, title string, text string", make)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "title", "text", F.length("text").cast("long").alias("n_chars"))
