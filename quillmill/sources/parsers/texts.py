"""Text formats: plain, Markdown, CSV, JSON, YAML, XML, TOML, HTML, SQL, subtitles, LaTeX, mail, RTF."""

from __future__ import annotations

import codecs
import csv
import email
import email.policy
import html
import io
import json
import re
from collections import Counter
from html.parser import HTMLParser
from xml.etree import ElementTree

from quillmill.schema import HEADER_WORDS
from quillmill.sources.parsers.charsets import multi_byte, single_byte

BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
DEEPEST, MOST_ITEMS = 50, 50
ATTACHMENT_CAP = 8 << 20


class Page:
    """Elements of a page, numbered as they come."""

    def __init__(self, number: int = 1, numbered: bool = True):
        self.number, self.elements, self.raw, self.numbered = number, [], [], numbered

    def add(self, kind: str, content: str, meta: dict | None = None, ident: str | None = None, raw: str | None = None) -> None:
        self.elements.append({"element_id": f"elem_{self.number}_{ident if ident is not None else len(self.elements)}", "element_type": kind, "content": content, "meta": meta})
        self.raw.append(content if raw is None else raw)

    def done(self, joint: str = "\n", raw: str | None = None, **more) -> dict:
        kinds = {e["element_type"] for e in self.elements}
        page = {"page_number": self.number, "elements": self.elements, "raw_text": joint.join(self.raw) if raw is None else raw, "has_image": "image" in kinds, "has_table": "table" in kinds}
        return page | more


def decode(data: bytes, encoding: str | None = None) -> tuple[str, dict]:
    """Text, and how it was read: a mark at the start, then strict UTF-8, then a multi-byte encoding whose rules and
    common signs the whole text keeps to, then a guess among single-byte ones, which is marked as unverified; latin-1,
    the last resort, is marked as lossy too."""
    if encoding:
        return data.decode(encoding, "replace").lstrip("\ufeff"), {"encoding": encoding}
    for bom, name in BOMS:
        if data.startswith(bom):
            return data.decode(name, "replace"), {"encoding": name}
    try:
        return data.decode("utf-8"), {"encoding": "utf-8"}
    except UnicodeDecodeError:
        pass
    if name := multi_byte(data):
        return data.decode(name), {"encoding": name}
    name = single_byte(data)
    return data.decode(name, "replace"), {"encoding": name, "encoding_verified": False} | ({"lossy_decode": True} if name == "latin-1" else {})


def loose(data: bytes) -> str:
    return data.decode("utf-8", "ignore").lstrip("\ufeff")


def kind_of(paragraph: str) -> str:
    t = paragraph.strip()
    first = t.split("\n", 1)[0]
    if len(t) < 100 and t.endswith((":", "：")):
        return "heading"
    if t.startswith("#") and len(first) < 100:
        return "heading"
    if t.startswith("```"):
        return "code"
    if first.startswith(("•", "-", "*", "1.", "2.", "（", "(")):
        return "list"
    return "quote" if first.startswith(">") else "text"


def plain(data: bytes, options: dict) -> list[dict]:
    text, how = decode(data, options.get("encoding"))
    page = Page()
    for part in text.replace("\r\n", "\n").split("\n\n"):
        if part.strip():
            page.add(kind_of(part), part.strip())
    return [page.done("\n\n", has_image=False, has_table=False, meta=how)]


# Markdown: one pattern for each block that a line can start, tried in this order.
MD_BLOCKS = (
    ("heading", re.compile(r"(#{1,6})\s+(.+)$")), ("code", re.compile(r"(```|~~~)(.*)$")), ("quote", re.compile(r">\s*(.*)$")), ("divider", re.compile(r"(?:-{3,}|\*{3,}|_{3,})\s*$")),
    ("task", re.compile(r"[-*+]\s+\[([ xX])\]\s+(.+)$")), ("bullet", re.compile(r"[-*+]\s+(.+)$")), ("number", re.compile(r"(\d+)\.\s+(.+)$")), ("table", re.compile(r"\|.*\|")),
    ("image", re.compile(r"!\[(.*?)\]\((.*?)(?:\s+\"(.*?)\")?\)\s*$")), ("footnote", re.compile(r"\[\^(.+?)\]:\s+(.+)$")), ("reference", re.compile(r"\[(.+?)\]:\s*(\S+)(?:\s+\"(.*)\")?$")),
)
INLINE = ((re.compile(r"!\[([^\]]*)\]\(([^)]+)\)"), "image"), (re.compile(r"\[([^\]]+)\]\(([^)]+)\)"), "link"), (re.compile(r"`([^`]+)`"), "code"))
PLAIN_MARKS = [re.compile(p) for p in (r"\*\*(.*?)\*\*", r"__(.*?)__", r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", r"(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", r"~~(.*?)~~", r"\[\^([^\]]+)\]")]


def front_matter(text: str) -> tuple[str, str | None, str, int]:
    """The rest, the front matter, its kind and its number of lines."""
    for fence, kind in (("---", "yaml"), ("+++", "toml")):
        f = re.escape(fence)
        if m := re.match(rf"{f}\s*\n(.*?)\n{f}\s*(?:\n|$)", text, re.S):
            return text[m.end() :], m[1].strip(), kind, m[0].count("\n")
    if text.startswith("{"):
        try:
            data, end = json.JSONDecoder().raw_decode(text)
        except ValueError:
            return text, None, "", 0
        if isinstance(data, dict):
            field = next((k for k in ("content", "body", "markdown") if isinstance(data.get(k), str)), None)
            rest = data.pop(field) if field else text[end:].lstrip("\r\n")
            return rest, json.dumps(data, ensure_ascii=False, indent=2), "json", text[:end].count("\n") + 1
    return text, None, "", 0


def inline(text: str) -> tuple[str, list[dict]]:
    tokens: list[dict] = []
    for pattern, kind in INLINE:
        def note(m, kind=kind):
            tokens.append({"type": kind, "text": m[1], **({"url": m[2]} if kind != "code" else {})})
            return m[1] or "[图片]"

        text = pattern.sub(note, text)
    for pattern in PLAIN_MARKS:
        text = pattern.sub(r"\1", text)
    return text.strip(), tokens


def table_cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def markdown(data: bytes, options: dict) -> list[dict]:
    text, front, kind, offset = front_matter(loose(data).replace("\r\n", "\n"))
    page = Page()
    if front is not None:
        page.add("front_matter", front, {"type": kind}, raw=f"[Front Matter]\n{front}")
    lines = text.split("\n")

    def block(line: str):
        bare = line.strip()
        return next(((name, m) for name, p in MD_BLOCKS if (m := p.match(bare))), (None, None)) if bare else (None, None)

    def run(i: int, name: str) -> int:
        """The end of the lines from i on that are of the same block."""
        while i < len(lines) and block(lines[i])[0] == name:
            i += 1
        return i

    i = 0
    while i < len(lines):
        at, (name, m) = offset + i, block(lines[i])
        if not lines[i].strip():
            i += 1
            continue
        end = i + 1
        if name == "heading":
            page.add("heading", re.sub(r"\s+#+\s*$", "", m[2]).strip(), {"level": len(m[1]), "line": at})
        elif name == "code":
            while end < len(lines) and not lines[end].strip().startswith(m[1]):
                end += 1
            body, language = "\n".join(lines[i + 1 : end]).rstrip("\n"), m[2].strip()
            page.add("code", body, {"language": language, "line_start": at, "line_end": offset + end - 1}, raw=f"[{language} code] {body[:100]}" if language else body)
            end += 1
        elif name == "quote":
            end = run(i, name)
            page.add("quote", "\n".join(re.sub(r"^>\s*", "", x.strip()) for x in lines[i:end]), {"line_start": at, "line_end": offset + end})
        elif name == "divider":
            page.add("divider", "---", {"line": at}, raw="")
        elif name == "task":
            done = m[1] in "xX"
            page.add("task", m[2], {"checked": done, "line": at}, raw=f"[{'x' if done else ' '}] {m[2]}")
        elif name in ("bullet", "number"):
            end = run(i, name)
            found = [(x, block(x)[1]) for x in lines[i:end]]
            items = [{"text": b[b.lastindex].rstrip(), "indent": len(x) - len(x.lstrip()), "line": at + k, **({"number": int(b[1])} if name == "number" else {})} for k, (x, b) in enumerate(found)]
            page.add("list", "\n".join(x["text"] for x in items), {"ordered": name == "number", "items": items, "depth": items[0]["indent"], "line_start": at})
        elif name == "table":
            end = run(i, name)
            rows = [table_cells(x) for x in lines[i:end]]
            body = [r for r in rows[1:] if not all(re.fullmatch(r":?-+:?", c) for c in r if c)]
            page.add("table", "\n".join(x.strip() for x in lines[i:end]), {"header": rows[0], "rows": body, "row_count": len(body), "col_count": len(rows[0]), "line_start": at})
        elif name == "image":
            page.add("image", m[1] or "[图片]", {"alt": m[1], "url": m[2], "title": m[3] or "", "line": at}, raw=f"[图片] {m[1]} ({m[2]})")
        elif name == "footnote":
            page.add("footnote", m[2], {"name": m[1], "line": at})
        elif name == "reference":
            page.add("reference", f"{m[1]}: {m[2]}", {"name": m[1], "url": m[2], "title": m[3] or "", "line": at}, raw=m[2])
        else:
            while end < len(lines) and lines[end].strip() and block(lines[end])[0] is None:
                end += 1
            clean, tokens = inline(" ".join(x.strip() for x in lines[i:end]))
            page.add("text", clean, {"line_start": at, "inline": tokens or None})
        i = end
    return [page.done()]


def sniff_delimiter(text: str, name: str = "") -> str:
    if name.lower().endswith((".tsv", ".tab")):
        return "\t"
    lines, best = [x.strip() for x in text.split("\n")[:10]], (0, ",")
    for d in (",", "\t", ";", "|", ":"):
        counts = Counter(n for x in lines if (n := x.count(d)))
        if counts:
            n, often = counts.most_common(1)[0]
            if n * often > best[0]:
                best = (n * often, d)
    return best[1]


def number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def header_row(rows: list[list[str]]) -> bool:
    if len(rows) < 2:
        return False
    text = all(c.strip() and not number(c.strip()) for c in rows[0])
    words = " ".join(rows[0]).lower()
    return (text and any(number(c.strip()) for c in rows[1])) or any(w in words for w in HEADER_WORDS)


def padded(rows: list[list[str]]) -> tuple[list[list[str]], int]:
    """Rows as wide as the widest, and how many were not."""
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows], sum(len(r) < width for r in rows)


def csv_table(data: bytes, options: dict) -> list[dict]:
    try:
        data[:1024].decode("utf-8")
        encoding = "utf-8-sig"
    except UnicodeDecodeError as e:
        encoding = "utf-8-sig" if e.start > 1020 else "gbk"
    text = data.decode(encoding, "ignore")
    delimiter = options.get("delimiter") or sniff_delimiter(text, options.get("name", ""))
    rows, ragged = padded([r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)])
    lines = [delimiter.join(c.strip() for c in r) for r in rows]
    page = Page()
    page.add("table", "\n".join(lines), {"rows": len(rows), "cols": len(rows[0]) if rows else 0, "delimiter": delimiter, "has_header": header_row(rows), "ragged_rows": ragged, "grid": rows}, "table")
    for i, (line, r) in enumerate(zip(lines, rows, strict=True)):
        page.add("table_row", line, {"row_index": i, "cols": len(r)}, str(i))
    return [page.done(raw="\n".join(lines), has_table=bool(rows))]


def flatten(page: Page, value, prefix: str, depth: int = 0) -> None:
    """Elements of nested data: keys of maps (to 50 levels), the first 50 items of lists."""
    if isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            nested = isinstance(v, (dict, list))
            page.add("table" if isinstance(v, list) else "heading" if nested else "text", f"{k}: [{type(v).__name__}]" if nested else f"{k}: {v}", {"key": str(k), "value_type": type(v).__name__}, f"{prefix}_{i}")
            if isinstance(v, dict) and depth >= DEEPEST:
                if v:
                    page.add("text", f"… 子树超出深度上限 {DEEPEST}，已省略 {len(v)} 个直接键", {"depth": depth, "depth_capped": True}, f"{prefix}_{k}_capped")
            elif nested:
                flatten(page, v, f"{prefix}_{k}", depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value[:MOST_ITEMS]):
            if isinstance(v, dict):
                page.add("table_row", " | ".join(f"{k}={x}" for k, x in v.items()), {"index": i}, f"{prefix}_item{i}")
            else:
                page.add("list", str(v), {"index": i}, f"{prefix}_item{i}")


def data_page(value, formatted: str, fmt: str) -> list[dict]:
    page = Page()
    top = list(map(str, value))[:10] if isinstance(value, dict) else None
    page.add("code", formatted, {"format": fmt, "type": type(value).__name__, "top_keys": top, "item_count": len(value) if isinstance(value, list) else None}, fmt)
    flatten(page, value, "root")
    return [page.done(raw=formatted, has_image=False, has_table=isinstance(value, list) and bool(value))]


def json_data(data: bytes, options: dict) -> list[dict]:
    value = json.loads(loose(data))
    return data_page(value, json.dumps(value, ensure_ascii=False, indent=2), "json")


def yaml_data(data: bytes, options: dict) -> list[dict]:
    import yaml

    value = yaml.safe_load(loose(data))
    return data_page(value, yaml.dump(value, allow_unicode=True, default_flow_style=False), "yaml")


def safe_xml(data: bytes) -> ElementTree.Element:
    """The tree; documents that declare entities are refused, as they can grow without bound."""
    if b"<!ENTITY" in data[: 1 << 20]:
        raise ValueError("entity declarations are not read")
    return ElementTree.fromstring(data)


def xml_data(data: bytes, options: dict) -> list[dict]:
    root = safe_xml(data)
    page = Page()
    whole = ElementTree.tostring(root, encoding="unicode")
    page.add("code", whole, {"format": "xml", "root_tag": root.tag, "root_attribs": dict(root.attrib)}, "xml")
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        page.add("heading", f"<{node.tag}>" + (f" attribs={dict(node.attrib)}" if node.attrib else ""), {"tag": node.tag, "attribs": dict(node.attrib), "depth": depth}, f"xml_{node.tag}_{depth}")
        if node.text and node.text.strip():
            page.add("text", node.text.strip(), {"depth": depth}, f"xml_text_{depth}")
        if depth < DEEPEST:
            todo += [(c, depth + 1) for c in reversed(node)]
        elif len(node):
            page.add("text", f"… 子树超出深度上限 {DEEPEST}，已省略 {len(node)} 个直接子元素", {"depth": depth, "depth_capped": True}, f"xml_capped_{depth}")
    return [page.done(raw=whole, has_image=False, has_table=False)]


def auto_data(data: bytes, options: dict) -> list[dict]:
    for parser in (json_data, yaml_data, xml_data):
        try:
            return parser(data, options)
        except Exception:  # noqa: BLE001
            continue
    raise ValueError("neither JSON nor YAML nor XML")


def toml_value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        items = [toml_value(x) for x in v]
        return f"[{', '.join(items)}]" if len(items) <= 5 else f"[{', '.join(items[:5])}, ... ({len(items)} items)]"
    return f"{{...}} ({len(v)} keys)" if isinstance(v, dict) else str(v)


def toml_data(data: bytes, options: dict) -> list[dict]:
    import tomllib

    page = Page()

    def tables(v) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)

    def walk(table: dict, path: str) -> None:
        at = lambda k: f"{path}.{k}" if path else k
        for k, v in table.items():
            if not isinstance(v, dict) and not tables(v):
                page.add("key_value", f"{k}: {toml_value(v)}", {"key": at(k), "type": "array" if isinstance(v, list) else type(v).__name__}, raw=f"{k} = {toml_value(v)}")
        for k, v in table.items():
            if isinstance(v, dict):
                page.add("section", k, {"path": at(k), "type": "table"}, raw=f"\n[{at(k)}]")
                walk(v, at(k))
        for k, v in table.items():
            for i, item in enumerate(v) if tables(v) else ():
                page.add("section", f"{k}[{i}]", {"path": f"{at(k)}[{i}]", "type": "array_of_tables", "index": i}, raw=f"\n[[{at(k)}]]")
                walk(item, at(k))

    walk(tomllib.loads(data.decode("utf-8-sig")), "")
    return [page.done(has_image=False, has_table=False)]


class Extractor(HTMLParser):
    SKIP = frozenset("script style nav footer header aside".split())
    BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr".split())
    KIND = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), "li": "list", "td": "table", "th": "table", "a": "link", "blockquote": "quote", "code": "code"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.tag, self.depth = [], [], None, 0

    def flush(self):
        text, self.text = "".join(self.text).strip(), []
        if text:
            self.found.append((self.KIND.get(self.tag, "text"), text, self.tag))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif not self.depth:
            if tag in self.BREAKS:
                self.flush()
            self.tag = tag
            if tag == "br":
                self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif not self.depth:
            self.flush()
            self.tag = None

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def bare_html(s: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", s)).split())


def html_page(data: bytes, options: dict) -> list[dict]:
    text = loose(data)
    page, title = Page(), ""
    for tag in ("title", "h1"):
        if m := re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", text, re.I | re.S):
            title = bare_html(m[1])
            break
    if title:
        page.add("title", title)
    e = Extractor()
    e.feed(text)
    e.close()
    e.flush()
    for kind, content, tag in e.found:
        page.add(kind, content, {"tag": tag})
    low = text.lower()
    return [page.done(has_image="<img" in low, has_table="<table" in low)]


# SQL: quoted text, comments and the end of a statement, in the order in which they are tried at a place.
SQL_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)|;|[(),]|[^'\"`\-#/;(),]+|.", re.S)
SQL_KIND = (
    ("create_table", r"CREATE\s+(?:TEMPORARY\s+|TEMP\s+)?TABLE\b"), ("create_index", r"CREATE\s+(?:UNIQUE\s+)?INDEX\b"), ("create_view", r"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\b"),
    ("insert", r"INSERT\b"), ("update", r"UPDATE\b"), ("delete", r"DELETE\b"),
)
SQL_NAME = r"((?:[`\"\[]?[\w$]+[`\"\]]?\.)*[`\"\[]?[\w$]+[`\"\]]?)"


def sql_statements(text: str) -> list[list[str]]:
    """Statements as lists of tokens, comments left out."""
    out: list[list[str]] = [[]]
    for m in SQL_TOKEN.finditer(text):
        t = m[0]
        if t == ";":
            out.append([])
        elif not t.startswith(("--", "#", "/*")):
            out[-1].append(t)
    return [s for s in out if "".join(s).strip()]


def split_top(tokens: list[str]) -> tuple[list[str], str]:
    """The parts between commas of the first bracket's content, and what follows it."""
    depth, parts, rest = 0, [""], ""
    started = ended = False
    for t in tokens:
        if ended:
            rest += t
            continue
        if t == "(":
            depth += 1
            if not started:
                started = True
                continue
        elif t == ")":
            depth -= 1
            if depth == 0:
                ended = True
                continue
        if started:
            if t == "," and depth == 1:
                parts.append("")
            else:
                parts[-1] += t
    return [p.strip() for p in parts if p.strip()], rest


def sql_column(part: str) -> dict | None:
    if re.match(r"(?i)(?:PRIMARY|UNIQUE|FOREIGN|CONSTRAINT|KEY|INDEX|CHECK|FULLTEXT)\b", part):
        return None
    m = re.match(rf"{SQL_NAME}\s+([\w$]+(?:\s*\([^)]*\))?(?:\s+unsigned)?)", part, re.I)
    if not m:
        return None
    up = part.upper()
    default, comment = re.search(r"(?i)\bDEFAULT\s+('(?:[^']|'')*'|[^\s,]+)", part), re.search(r"(?i)\bCOMMENT\s+'((?:[^']|'')*)'", part)
    return {
        "name": m[1].strip('`"[]'), "type": m[2], "primary_key": "PRIMARY KEY" in up, "not_null": "NOT NULL" in up, "unique": "UNIQUE" in up,
        "auto_increment": bool(re.search(r"AUTO_?INCREMENT|\bSERIAL\b", up)), "default": default[1] if default else None, "comment": comment[1] if comment else None,
    }


def sql_dump(data: bytes, options: dict) -> list[dict]:
    text, how = decode(data, options.get("encoding"))
    page, stats = Page(), Counter()
    for tokens in sql_statements(text):
        whole = "".join(tokens).strip()
        kind = next((k for k, p in SQL_KIND if re.match(p, whole, re.I)), "other")
        stats[kind] += 1
        if kind == "create_table":
            name = re.match(rf"(?is)CREATE\s+(?:TEMPORARY\s+|TEMP\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{SQL_NAME}", whole)
            parts, _ = split_top(tokens)
            columns = [c for p in parts if (c := sql_column(p))]
            keys = [k.strip(' `"') for p in parts if (m := re.match(r"(?is)(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\(([^)]*)\)", p)) for k in m[1].split(",")]
            for c in columns:
                c["primary_key"] = c["primary_key"] or c["name"] in keys
            title = name[1].strip('`"[]') if name else ""
            page.add("table", f"{title}: " + ", ".join(f"{c['name']} {c['type']}" for c in columns), {"statement_type": kind, "table_name": title, "columns": columns})
        elif kind == "insert":
            name = re.match(rf"(?is)INSERT\s+(?:IGNORE\s+)?(?:INTO\s+)?{SQL_NAME}", whole)
            after = re.search(r"(?i)\bVALUES?\b", "".join(t if not t.startswith(("'", '"')) else " " * len(t) for t in tokens))
            depth = rows = 0
            for t in SQL_TOKEN.findall("".join(tokens)[after.end() :]) if after else ():
                depth += (t == "(") - (t == ")")
                rows += t == "(" and depth == 1
            title = name[1].strip('`"[]') if name else ""
            page.add("text", f"INSERT INTO {title}: {rows} rows", {"statement_type": kind, "table_name": title, "row_count": rows})
        else:
            page.add("text", whole, {"statement_type": kind})
    counts = {k: stats[k] for k in (*(k for k, _ in SQL_KIND), "other")}
    return [page.done("\n\n", has_image=False, meta=how | {"statistics": counts})]


CUE_TIME = re.compile(r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")


def subtitles(data: bytes, options: dict) -> list[dict]:
    """SRT and WebVTT: one element for each cue; settings after the times are dropped, tags too in WebVTT."""
    text = decode(data)[0].replace("\r\n", "\n").replace("\r", "\n")
    vtt = text.lstrip("\ufeff \n").startswith("WEBVTT")
    page = Page()
    for block in re.split(r"\n\s*\n", text.strip()):
        lines = block.strip().split("\n")
        k = next((i for i, x in enumerate(lines) if CUE_TIME.search(x)), None)
        if k is None:
            continue
        m = CUE_TIME.search(lines[k])
        body = "\n".join(x.strip() for x in lines[k + 1 :] if x.strip())
        if vtt:
            body = re.sub(r"</?(?:c|v|i|b|u|ruby|rt|lang)\b[^>]*>|<[\d:.]+>", "", body).strip()
        if body:
            label = lines[k - 1].strip() if k else ""
            page.add("text", body, {"cue_id" if vtt else "index": label if vtt else int(label) if label.isdigit() else 0, "start_time": m[1], "end_time": m[2]})
    return [page.done(has_image=False, has_table=False)]


# LaTeX: level of each section command; commands whose argument is kept; environments that are mathematics.
SECTIONS = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
LATEX_MATH = r"\$\$.*?\$\$|\\\[.*?\\\]|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)\*?\}.*?\\end\{\1\*?\}|\\\(.*?\\\)|(?<!\\)\$[^$]+\$"


def latex_text(s: str) -> str:
    s = re.sub(LATEX_MATH, "[公式]", s, flags=re.S)
    s = re.sub(r"\\(?:documentclass|usepackage|label|bibliographystyle|bibliography|input|include|pagestyle|thispagestyle|vspace|hspace|setlength|newcommand|renewcommand)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\}){1,2}", "", s)
    s = re.sub(r"\\(?:cite[pt]?|ref|eqref|autoref|pageref)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"[\1]", s)
    s = re.sub(r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}", r"[图片: \1]", s)
    s = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\item(?:\[([^\]]*)\])?\s*", lambda m: f"- {m[1]} " if m[1] else "- ", s)
    s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*", "", s)
    for _ in range(6):  # arguments nest a few levels
        new = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
        if new == s:
            break
        s = new
    s = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", s)
    s = re.sub(r"\\([%&$#_{}])", r"\1", s)
    s = re.sub(r"\\[a-zA-Z]+\*?\s?", "", s).replace("~", " ").replace("``", "“").replace("''", "”")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"[{}]", "", s))).strip()


def latex(data: bytes, options: dict) -> list[dict]:
    text = re.sub(r"(?<!\\)%[^\n]*", "", loose(data).replace("\r\n", "\n"))
    parts = re.split(r"\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)(\*?)\{([^}]*)\}", text)
    page = Page()
    if clean := latex_text(parts[0]):
        page.add("text", clean, {"section": "preamble"})
    for cmd, star, title, body in zip(*(parts[i::4] for i in (1, 2, 3, 4)), strict=True):
        if title:
            page.add("heading", title, {"level": SECTIONS[cmd], "command": f"\\{cmd}{star}"})
        for p in re.split(r"\n\s*\n", latex_text(body)):
            if p.strip():
                page.add("text", p.strip(), {"section": title})
    return [page.done("\n\n", has_image=False, has_table=False)]


def mail(data: bytes, options: dict) -> list[dict]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    page = Page()
    for name in ("Subject", "From", "To", "Cc", "Date"):
        if value := str(m.get(name) or "").strip():
            page.add("header", f"{name}: {value}", {"header": name.lower()})
    plain_, rich, attached = None, None, []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            payload = part.get_payload()
            if str(part.get("Content-Transfer-Encoding", "")).lower() == "base64" and isinstance(payload, str):
                bare = re.sub(r"\s", "", payload)
                size = len(bare) * 3 // 4 - bare[-2:].count("=")
            else:
                size = len(payload.encode("utf-8", "replace")) if isinstance(payload, str) else 0
            attached.append({"name": part.get_filename() or "", "type": part.get_content_type(), "size": min(size, ATTACHMENT_CAP), "capped": size > ATTACHMENT_CAP})
        elif part.get_content_type() in ("text/plain", "text/html"):
            raw = part.get_payload(decode=True) or b""
            try:
                text = raw.decode(part.get_content_charset() or "utf-8")
            except (LookupError, UnicodeDecodeError):
                text = decode(raw)[0]
            if part.get_content_type() == "text/plain":
                plain_ = text if plain_ is None else plain_
            else:
                rich = text if rich is None else rich
    body = plain_
    if not (body or "").strip() and rich is not None:
        body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", rich)
        body = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|li)\s*>", "\n\n", body)))
    parts = [p.strip() for p in re.split(r"\n\s*\n", (body or "").replace("\r\n", "\n")) if p.strip()]
    for p in parts or ["[无正文内容]"]:
        page.add("text", p)
    if attached:
        page.add("text", "附件: " + ", ".join(a["name"] for a in attached), {"attachments": attached})
    return [page.done(has_image=False, has_table=False, meta={"attachments": len(attached)})]


RTF_TOKEN = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator listtable listoverridetable rsidtbl themedata datastore latentstyles xmlnstbl".split())
RTF_SIGN = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "cell": "\t", "row": "\n"}


def rtf(data: bytes, options: dict) -> list[dict]:
    """Text of the visible groups; \\u escapes and code page 1252 (or \\ansicpg's) bytes are read."""
    text, page_code = data.decode("latin-1"), "cp1252"
    if m := re.search(r"\\ansicpg(\d+)", text):
        try:
            page_code = codecs.lookup(f"cp{m[1]}").name
        except LookupError:
            pass
    out, stack, hidden, skip, after, pending = [], [], False, 0, 1, bytearray()

    def settle():
        if pending:
            out.append(bytes(pending).decode(page_code, "replace"))
            pending.clear()

    for m in RTF_TOKEN.finditer(text):
        word, arg, hexa, sign, brace, body = m.groups()
        if not hexa:
            settle()
        if brace == "{":
            stack.append((hidden, after))
        elif brace == "}":
            hidden, after = stack.pop() if stack else (False, 1)
        elif sign is not None:
            if sign == "*":
                hidden = True
            elif not hidden and sign in "~_\\{}-":
                out.append({"~": " ", "_": "-", "-": ""}.get(sign, sign))
        elif word:
            if word in RTF_HIDDEN:
                hidden = True
            elif word == "uc":
                after = int(arg or 1)
            elif word == "u" and not hidden:
                out.append(chr(int(arg or 0) % 65536))
                skip = after
            elif not hidden:
                out.append(RTF_SIGN.get(word, ""))
        elif hexa:
            if skip:
                skip -= 1
            elif not hidden:
                pending.append(int(hexa, 16))
        elif body and not hidden:
            out.append(body[skip:])
            skip = max(0, skip - len(body))
    settle()
    page = Page()
    for p in re.split(r"\n+", "".join(out)):
        if p.strip():
            page.add(kind_of(p), p.strip())
    return [page.done("\n\n", has_image=False, has_table=False)]
