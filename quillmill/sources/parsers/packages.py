"""Zip packages and SVG: DOCX, XLSX, PPTX, ODF, EPUB, archives, with the standard library alone.

Members are read up to a bound of uncompressed bytes, so a small file can't grow without limit."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree.ElementTree import Element

from quillmill.sources.parsers.texts import Page, bare_html, decode, header_row, kind_of, padded, safe_xml

MEMBER_CAP = 64 << 20
MOST_ENTRIES, MOST_MEMBERS, PREVIEW = 100, 20, 500
MOST_REPEAT = 10_000
MEMBER_EXTENSIONS = tuple(f".{e}" for e in "txt md csv tsv json yaml yml xml html htm log ini cfg conf py js ts java c cpp h go rs sql sh toml tex srt vtt".split())


def local(node: Element) -> str:
    return node.tag.rpartition("}")[2]


def attr(node: Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), default)


def each(node: Element, *names: str):
    return (x for x in node.iter() if local(x) in names)


def child(node: Element | None, *names: str) -> Element | None:
    """The first child along a path of local names."""
    for n in names:
        node = next((c for c in node if local(c) == n), None) if node is not None else None
    return node


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            data = f.read(MEMBER_CAP + 1)
        if len(data) > MEMBER_CAP:
            raise ValueError(f"{name} is larger than {MEMBER_CAP} bytes")
        return data

    def xml(self, name: str) -> Element | None:
        return safe_xml(self.read(name)) if name in self.names else None

    def relations(self, name: str) -> dict[str, str]:
        """Targets by relation id of a part."""
        folder, file = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{file}.rels")
        return {} if root is None else {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/") for r in root}


def grid_text(rows: list[list[str]]) -> str:
    """A Markdown table."""
    rows = [[c.replace("|", "\\|").replace("\n", "<br>") for c in r] for r in padded(rows)[0]]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows and rows[0] else ""


def add_table(page: Page, rows: list[list[str]], **meta) -> None:
    if rows:
        page.add("table", grid_text(rows), {"rows": len(rows), "cols": max(map(len, rows)), "has_header": header_row(rows), "grid": rows, **meta})


def docx(data: bytes, options: dict) -> list[dict]:
    """The body in order, content controls opened; inserted text is read, deleted text is not."""
    root = Package(data).xml("word/document.xml")
    body = child(root, "body")
    page = Page()

    def text(node: Element) -> tuple[str, bool]:
        out, changed = [], False
        todo = [node]
        while todo:
            x = todo.pop()
            name = local(x)
            if name in ("del", "moveFrom"):
                changed = True
                continue
            changed = changed or name in ("ins", "moveTo")
            out.append({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(name, "") if name in ("t", "tab", "br", "cr") else "")
            todo += reversed(x)
        return "".join(out).strip(), changed

    def cells(table: Element) -> list[list[str]]:
        rows = []
        for tr in (r for r in each(table, "tr")):
            row = []
            for tc in (c for c in tr if local(c) == "tc"):
                span = attr(child(tc, "tcPr", "gridSpan"), "val") if child(tc, "tcPr", "gridSpan") is not None else None
                value = "\n".join(t for p in each(tc, "p") if (t := text(p)[0]))
                row += [value] + [""] * (min(int(span or 1), 200) - 1)
            rows.append(row)
        return rows

    def walk(parent: Element) -> None:
        for node in parent:
            name = local(node)
            if name == "sdt" and child(node, "sdtContent") is not None:
                walk(child(node, "sdtContent"))
            elif name == "tbl":
                add_table(page, cells(node))
            elif name == "p":
                value, changed = text(node)
                image = any(True for _ in each(node, "drawing", "pict"))
                if image:
                    page.add("image", value or "[图片]")
                elif value:
                    style = (attr(child(node, "pPr", "pStyle"), "val") if child(node, "pPr", "pStyle") is not None else "") or ""
                    listed = child(node, "pPr", "numPr") is not None
                    low = style.lower()
                    level = re.search(r"(?:heading|标题)\s*(\d)", low)
                    kind = "heading" if level or low == "title" else "list" if listed or "list" in low else "quote" if "quote" in low else "code" if "code" in low else kind_of(value)
                    page.add(kind, value, {"style": style, **({"level": int(level[1])} if level else {}), **({"tracked_changes": True} if changed else {})})

    if body is not None:
        walk(body)
    return [page.done("\n\n")]


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx(data: bytes, options: dict) -> list[dict]:
    """A page and a table for each sheet; merged ranges hold their value in each cell; booleans and shared text read."""
    p = Package(data)
    shared = p.xml("xl/sharedStrings.xml")
    texts = ["".join(t.text or "" for t in each(si, "t")) for si in shared] if shared is not None else []
    book, rel, pages = p.xml("xl/workbook.xml"), p.relations("xl/workbook.xml"), []
    for number, sheet in enumerate(each(book, "sheet"), 1):
        root = p.xml(rel.get(attr(sheet, "id") or "", f"xl/worksheets/sheet{number}.xml"))
        page, rows = Page(number), []
        for r in each(root, "row") if root is not None else ():
            at = int(r.get("r") or len(rows) + 1)
            rows += [[] for _ in range(min(at, len(rows) + MOST_REPEAT) - len(rows))]
            for c in (x for x in r if local(x) == "c"):
                col = column_number(c.get("r", "")) or len(rows[-1]) + 1
                v, kind = child(c, "v"), c.get("t")
                raw = (v.text or "") if v is not None else ""
                value = texts[int(raw)] if kind == "s" and raw.isdigit() and int(raw) < len(texts) else "".join(t.text or "" for t in each(c, "t")) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw
                rows[-1] += [""] * (min(col, 16_384) - len(rows[-1]))
                rows[-1][col - 1] = value
        rows, ragged = padded(rows)
        merged = 0
        for m in each(root, "mergeCell") if root is not None else ():
            ends = re.match(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref", ""))
            if ends:
                top, left = int(ends[2]) - 1, column_number(ends[1]) - 1
                value = rows[top][left] if top < len(rows) and left < len(rows[top]) else ""
                merged += 1
                for i in range(top, min(int(ends[4]), len(rows))):
                    for j in range(left, min(column_number(ends[3]), len(rows[i]))):
                        rows[i][j] = value
        rows = [r for r in rows if any(c.strip() for c in r)]
        add_table(page, rows, sheet_name=sheet.get("name"), merged_cells=merged)
        pages.append(page.done(raw=f"Sheet: {sheet.get('name')}\n" + grid_text(rows), meta={"sheet_name": sheet.get("name")}))
    return pages


def pptx(data: bytes, options: dict) -> list[dict]:
    """A page for each slide: title, text, tables, pictures, notes; shapes that an animation shows are noted in order."""
    p = Package(data)
    show, rel = p.xml("ppt/presentation.xml"), p.relations("ppt/presentation.xml")
    slides = [rel[attr(s, "id")] for s in each(show, "sldId") if attr(s, "id") in rel] or sorted((n for n in p.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    pages = []
    for number, name in enumerate(slides, 1):
        root, page = p.xml(name), Page(number)
        if root is None:
            continue
        lines = lambda node: "\n".join(t for para in each(node, "p") if (t := "".join((x.text or "") if local(x) == "t" else "\n" for x in each(para, "t", "br")).strip()))
        for shape in each(root, "sp", "pic", "graphicFrame"):
            if local(shape) == "pic":
                info = next(each(shape, "cNvPr"), None)
                page.add("image", (info.get("descr") or info.get("name") or "[图片]") if info is not None else "[图片]")
            elif local(shape) == "graphicFrame":
                for t in each(shape, "tbl"):
                    add_table(page, [[lines(c) for c in r if local(c) == "tc"] for r in t if local(r) == "tr"])
            elif value := lines(shape):
                holder = next(each(shape, "ph"), None)
                title = holder is not None and holder.get("type") in ("title", "ctrTitle")
                page.add("title" if title else kind_of(value), value)
        order = list(dict.fromkeys(x.get("spid") for x in each(root, "spTgt")))
        note = next((t for t in p.relations(name).values() if "notesSlide" in t), None)
        if note and (body := p.xml(note)) is not None:
            said = "\n".join(lines(s) for s in each(body, "sp") if (h := next(each(s, "ph"), None)) is None or h.get("type") not in ("sldNum", "sldImg", "dt", "hdr", "ftr"))
            if said.strip():
                page.add("note", said.strip())
        pages.append(page.done(meta={"animation_order": order}))
    return pages


def odf_text(node: Element) -> str:
    out, todo = [], [(node, False)]
    while todo:
        x, tail = todo.pop()
        if tail:
            out.append(x.tail or "")
            continue
        name = local(x)
        out.append({"s": " " * min(int(attr(x, "c") or 1), 1000), "tab": "\t", "line-break": "\n"}.get(name, ""))
        if name not in ("annotation", "note"):
            out.append(x.text or "")
            for c in reversed(x):
                todo += [(c, True), (c, False)]
    return "".join(out).strip()


def odf_rows(table: Element) -> list[list[str]]:
    """Rows with repeats opened, up to 10,000 each; blank rows and cells at the end aren't repeated."""
    rows: list[list[str]] = []
    for tr in each(table, "table-row"):
        row: list[str] = []
        for c in (x for x in tr if local(x) in ("table-cell", "covered-table-cell")):
            times = int(attr(c, "number-columns-repeated") or 1) if (attr(c, "number-columns-repeated") or "1").isdigit() else 1
            value = "\n".join(t for x in c if local(x) in ("p", "h") and (t := odf_text(x)))
            row += [value] * min(times, MOST_REPEAT if value else 50)
        while row and not row[-1]:
            row.pop()
        times = int(attr(tr, "number-rows-repeated") or 1) if (attr(tr, "number-rows-repeated") or "1").isdigit() else 1
        rows += [row] * (min(times, MOST_REPEAT) if row else 1)
    return [r for r in rows if any(c.strip() for c in r)]


def odf_body(data: bytes, kind: str) -> Element | None:
    return child(Package(data).xml("content.xml"), "body", kind)


def odt(data: bytes, options: dict) -> list[dict]:
    page = Page()

    def walk(parent: Element) -> None:
        for node in parent:
            name = local(node)
            if name == "h":
                page.add("heading", odf_text(node), {"level": int(attr(node, "outline-level") or 1)})
            elif name == "p":
                for _ in each(node, "image"):
                    page.add("image", "[图片]")
                if value := odf_text(node):
                    page.add("text", value)
            elif name == "list":
                if items := [t for i in node if local(i) == "list-item" and (t := odf_text(i))]:
                    page.add("list", "\n".join(items), {"items": len(items)})
            elif name == "table":
                add_table(page, odf_rows(node))
            elif name in ("section", "text-box", "frame"):
                walk(node)

    body = odf_body(data, "text")
    if body is not None:
        walk(body)
    return [page.done("\n\n")]


def ods(data: bytes, options: dict) -> list[dict]:
    body, pages = odf_body(data, "spreadsheet"), []
    for number, sheet in enumerate((t for t in body if local(t) == "table") if body is not None else (), 1):
        page, rows = Page(number), odf_rows(sheet)
        page.add("heading", attr(sheet, "name") or f"Sheet{number}", {"level": 2})
        add_table(page, rows, sheet_name=attr(sheet, "name"))
        for i, r in enumerate(rows):
            page.add("table_row", " | ".join(r), {"row_index": i}, raw="")
        pages.append(page.done(meta={"sheet_name": attr(sheet, "name")}, raw="\n".join([attr(sheet, "name") or "", grid_text(rows)])))
    return pages


def odp(data: bytes, options: dict) -> list[dict]:
    body, pages = odf_body(data, "presentation"), []
    for number, slide in enumerate((s for s in body if local(s) == "page") if body is not None else (), 1):
        page = Page(number)
        page.add("heading", attr(slide, "name") or f"Slide {number}", {"level": 2})
        for frame in (f for f in slide if local(f) in ("frame", "custom-shape")):
            for x in frame:
                if local(x) == "image":
                    page.add("image", "[图片]")
                elif local(x) == "table":
                    add_table(page, odf_rows(x))
                else:
                    for para in each(x, "p"):
                        if value := odf_text(para):
                            page.add("text", value)
        pages.append(page.done())
    return pages


def epub(data: bytes, options: dict) -> list[dict]:
    """A page for each chapter in the order of the spine, with its title of the table of contents."""
    p = Package(data)
    box = p.xml("META-INF/container.xml")
    opf = next((r.get("full-path") for r in each(box, "rootfile")), None) if box is not None else next((n for n in p.names if n.endswith(".opf")), None)
    root, folder = p.xml(opf or ""), posixpath.dirname(opf or "")
    if root is None:
        raise ValueError("no package document")
    at = lambda href: posixpath.normpath(posixpath.join(folder, href.split("#")[0]))
    manifest = {i.get("id"): at(i.get("href", "")) for i in each(root, "item")}
    titles: dict[str, str] = {}
    if ncx := next((n for n in manifest.values() if n.endswith(".ncx")), None):
        for point in each(p.xml(ncx), "navPoint") if p.xml(ncx) is not None else ():
            label, src = next(each(point, "text"), None), next(each(point, "content"), None)
            if label is not None and src is not None:
                titles.setdefault(at(src.get("src", "")), (label.text or "").strip())
    book = next((x.text for x in each(root, "title")), "") or ""
    pages = []
    for ref in each(root, "itemref"):
        name = manifest.get(ref.get("idref"))
        if name not in p.names:
            continue
        raw = p.read(name)
        declared = re.search(rb"""(?:encoding=|charset=)["']?([\w-]+)""", raw[:1024])
        try:
            text = raw.decode(declared[1].decode()) if declared else decode(raw)[0]
        except (LookupError, UnicodeDecodeError):
            text = decode(raw)[0]
        page = Page(len(pages) + 1)
        if titles.get(name):
            page.add("heading", titles[name], {"level": 1})
        body = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", "", text)
        for part in re.split(r"(?i)</(?:p|div|h[1-6]|li|blockquote|tr)\s*>|<br\s*/?>", body):
            if value := bare_html(part):
                page.add("heading" if re.search(r"(?i)<h[1-6]\b", part) else "text", value)
        pages.append(page.done("\n\n", has_image="<img" in text.lower(), meta={"chapter": titles.get(name), "book": book, "href": name}))
    return pages


def archive(data: bytes, options: dict) -> list[dict]:
    """The first 100 entries, and a preview of the first 20 text members; a member is read no further than needed."""
    z = zipfile.ZipFile(io.BytesIO(data))
    page, shown = Page(), 0
    entries = z.infolist()
    page.add("text", f"ZIP: {len(entries)} entries", {"entries": len(entries)})
    for info in entries[:MOST_ENTRIES]:
        page.add("text", f"{info.filename} ({info.file_size} B)", {"name": info.filename, "size": info.file_size, "compressed": info.compress_size})
        if shown < MOST_MEMBERS and info.filename.lower().endswith(MEMBER_EXTENSIONS) and not info.flag_bits & 1:
            with z.open(info) as f:
                head = f.read(4 * PREVIEW)
            page.add("code", head.decode("utf-8", "ignore")[:PREVIEW], {"name": info.filename, "preview": True})
            shown += 1
    return [page.done(has_image=False, has_table=False)]


def svg(data: bytes, options: dict) -> list[dict]:
    root, page = safe_xml(data), Page()
    hidden = {id(x) for d in each(root, "defs", "symbol", "clipPath", "mask", "pattern") for x in d.iter()}
    meta = {k: root.get(k) for k in ("width", "height", "viewBox") if root.get(k)}
    if meta:
        page.add("header", ", ".join(f"{k}={v}" for k, v in meta.items()), meta)
    for name, kind in (("title", "heading"), ("desc", "text")):
        found = next(each(root, name), None)
        if found is not None and (value := "".join(found.itertext()).strip()):
            page.add(kind, value, {"level": 1} if kind == "heading" else None)
    for x in each(root, "text"):
        if id(x) not in hidden and (value := " ".join("".join(x.itertext()).split())):
            page.add("text", value, {"x": x.get("x"), "y": x.get("y")})
    counts: dict[str, int] = {}
    for x in each(root, "rect", "circle", "ellipse", "line", "polyline", "polygon", "path", "image", "use"):
        if id(x) not in hidden:
            counts[local(x)] = counts.get(local(x), 0) + 1
    if counts:
        page.add("text", ", ".join(f"{k}: {n}" for k, n in sorted(counts.items())), {"shapes": counts})
    for x in each(root, "image"):
        page.add("image", (attr(x, "href") or "")[:200] or "[图片]", {"href": (attr(x, "href") or "")[:200]})
    return [page.done(meta=meta)]
