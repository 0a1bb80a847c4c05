import io
import json
import struct
import wave
import zipfile
import zlib

from pyspark.sql import functions as F

from quillmill.plans.translate import to_index, translate
from quillmill.sources.files import check_output, files, raw
from quillmill.sources.parsers import elements, parse, parse_one, raw_pages
from quillmill.sources.parsers.texts import decode


def one(data, fmt, name="x", **options):
    pages, error = parse_one(data if isinstance(data, bytes) else data.encode(), fmt, name, options)
    assert error is None, error
    return pages


def kinds(page):
    return [e["element_type"] for e in page["elements"]]


def texts(page):
    return [e["content"] for e in page["elements"]]


def meta(element):
    return json.loads(element["meta"])


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_encodings():
    assert decode("é日".encode())[1]["encoding"] == "utf-8"
    assert decode("﻿x".encode())[0] == "x"
    assert decode("研发部的工作报告".encode("gbk")) == ("研发部的工作报告", {"encoding": "gb18030"})
    text, how = decode("café déjà".encode("latin-1"))
    assert text == "café déjà" and how["lossy_decode"]
    assert decode("x".encode("utf-16"))[0].strip("﻿") == "x"


def test_plain_text():
    p = one("Title:\n\n- a\n- b\n\n> q\n\n# h\n\n```\ncode\n```\n\nplain", "txt")[0]
    assert kinds(p) == ["heading", "list", "quote", "heading", "code", "text"] and not p["has_table"]


def test_markdown():
    text = "---\ntitle: x\n---\n# Head ##\n\npara **bold** [link](u) `c`\nmore\n\n- a\n  - b\n\n1. one\n2. two\n\n- [x] done\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![alt](p.png)\n\n```py\nx = 1\n```\n\n> quote\n\n---\n\n[^1]: note\n[ref]: http://x\n"
    p = one(text, "txt", "a.md")[0]
    assert kinds(p) == ["front_matter", "heading", "text", "list", "list", "task", "table", "image", "code", "quote", "divider", "footnote", "reference"]
    by = {e["element_type"]: e for e in p["elements"]}
    assert by["heading"]["content"] == "Head" and meta(by["heading"]) == {"level": 1, "line": 3}
    assert by["text"]["content"] == "para bold link c more" and meta(by["table"])["rows"] == [["1", "2"]] and meta(by["task"])["checked"]
    assert [i["indent"] for i in meta(p["elements"][3])["items"]] == [0, 2] and p["has_image"] and p["has_table"]


def test_csv_forms():
    p = one("id;name\n1;a\n\n2;b;c\n", "csv")[0]
    m = meta(p["elements"][0])
    assert m["delimiter"] == ";" and m["grid"] == [["id", "name", ""], ["1", "a", ""], ["2", "b", "c"]] and m["ragged_rows"] == 2 and m["has_header"]
    assert meta(one('a,"x,y"\n1,2\n', "csv")[0]["elements"][0])["grid"][0] == ["a", "x,y"]
    assert meta(one("a\tb\n1\t2", "csv", "t.tsv")[0]["elements"][0])["delimiter"] == "\t"
    assert not meta(one("a,b", "csv")[0]["elements"][0])["has_header"]


def test_data_formats():
    assert kinds(one('{"a": 1, "b": {"c": [1, {"d": 2}]}}', "json")[0]) == ["code", "text", "heading", "table", "list", "table_row"]
    assert one("[1, 2]", "json")[0]["has_table"] and kinds(one("a: 1\nb: [x]\n", "yaml")[0]) == ["code", "text", "table", "list"]
    assert texts(one("<r><a k='1'>t</a></r>", "xml")[0])[1:] == ["<r>", "<a> attribs={'k': '1'}", "t"]
    toml = one('n = 1\n[t]\nx = true\n[[a]]\ny = [1,2,3,4,5,6]\n', "toml")[0]
    assert texts(toml) == ["n: 1", "t", "x: true", "a[0]", "y: [1, 2, 3, 4, 5, ... (6 items)]"]
    deep = "{" + '"a":{' * 60 + "}" * 61
    assert any(meta(e).get("depth_capped") for e in one(deep, "json")[0]["elements"])
    assert parse_one(b"<!DOCTYPE x [<!ENTITY a 'b'>]><r>&a;</r>", "xml", "x", {})[1]["kind"] == "parse_failed"
    assert parse_one(b"{", "json", "x", {})[1]["kind"] == "parse_failed"


def test_html():
    p = one("<title>T &amp; U</title><nav>no</nav><h1>H</h1><p>a<br>b</p><ul><li>i</li></ul><table><tr><td>c</td></tr></table><script>x</script>", "html")[0]
    assert list(zip(kinds(p), texts(p), strict=True))[:2] == [("title", "T & U"), ("text", "T & U")] and "no" not in texts(p)
    assert ("heading", "H") in zip(kinds(p), texts(p), strict=True) and ("list", "i") in zip(kinds(p), texts(p), strict=True) and p["has_table"] and not p["has_image"]


def test_sql():
    p = one("-- c;\nCREATE TABLE `t` (id INT PRIMARY KEY AUTO_INCREMENT, n VARCHAR(9) NOT NULL DEFAULT 'a;b' COMMENT 'nm', PRIMARY KEY (id));\nINSERT INTO t VALUES (1, 'x);'), (2, 'y');\nDROP TABLE t;", "sql")[0]
    table = meta(p["elements"][0])
    assert table["table_name"] == "t" and [c["name"] for c in table["columns"]] == ["id", "n"] and table["columns"][1]["default"] == "'a;b'" and table["columns"][0]["primary_key"]
    assert meta(p["elements"][1])["row_count"] == 2 and json.loads(p["meta"])["statistics"]["other"] == 1


def test_subtitles_and_latex():
    p = one("1\n00:00:20,000 --> 00:00:24,400\nHello\nyou\n\nbad\n", "srt")[0]
    assert texts(p) == ["Hello\nyou"] and meta(p["elements"][0]) == {"index": 1, "start_time": "00:00:20,000", "end_time": "00:00:24,400"}
    v = one("WEBVTT\nKind: x\n\nid\n00:20.000 --> 00:24.000 align:start\n<v Bob>Hi <i>there</i>\n", "srt")[0]
    assert texts(v) == ["Hi there"] and meta(v["elements"][0])["cue_id"] == "id"
    t = one("pre % c\n\\section{A}\nx $y$ \\textbf{b} 5\\%\n\n\\subsection*{B}\n\\begin{itemize}\\item q\\end{itemize}", "latex")[0]
    assert kinds(t) == ["text", "heading", "text", "heading", "text"] and texts(t)[2] == "x [公式] b 5%" and texts(t)[4] == "- q"


def test_mail_and_rtf():
    m = one('Subject: =?utf-8?B?w6k=?=\nFrom: a@b\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\none\n\ntwo\n--B\nContent-Type: application/x\nContent-Disposition: attachment; filename=f.bin\nContent-Transfer-Encoding: base64\n\nQUJD\n--B--\n', "eml")[0]
    assert texts(m)[0] == "Subject: é" and "one" in texts(m) and meta(m["elements"][-1])["attachments"][0]["size"] == 3
    r = one(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364? x}", "rtf")[0]
    assert texts(r) == ["Hello bold", "café € x"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_office():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del></w:p></w:sdtContent></w:sdt><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    d = one(package({"word/document.xml": doc}), "docx")[0]
    assert kinds(d) == ["heading", "text", "table"] and texts(d)[:2] == ["H", "in"] and "a\\|b" in texts(d)[2]
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = f'<workbook {rel}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="2"><c r="A2"><v>001</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    x = one(package({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>"}), "xlsx")[0]
    assert meta(x["elements"][0])["grid"] == [["head", "head", "TRUE"], ["001", "", ""]]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>body</a:t></a:r></a:p></p:sp><p:pic><p:cNvPr descr="pic"/></p:pic></p:sld>'
    s = one(package({"ppt/presentation.xml": "<p:presentation xmlns:p='p'/>", "ppt/slides/slide1.xml": slide}), "pptx")[0]
    assert list(zip(kinds(s), texts(s), strict=True)) == [("title", "T"), ("text", "body"), ("image", "pic")]


def test_open_documents_books_and_archives():
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'
    odt = f'<office:c {ns}><office:body><office:text><text:h text:outline-level="2">H</text:h><text:p>a<text:s text:c="2"/>b</text:p></office:text></office:body></office:c>'
    assert texts(one(package({"content.xml": odt}), "odt")[0]) == ["H", "a  b"]
    ods = f'<office:c {ns}><office:body><office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="99999999"><table:table-cell/></table:table-row></table:table></office:spreadsheet></office:body></office:c>'
    assert meta(one(package({"content.xml": ods}), "ods")[0]["elements"][1])["grid"] == [["x", "x"]]
    book = package({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><title>B</title><item id="a" href="1.html"/><item id="n" href="t.ncx"/><itemref idref="a"/></p>', "O/t.ncx": '<n><navPoint><text>One</text><content src="1.html"/></navPoint></n>', "O/1.html": "<h1>One</h1><p>text</p>"})
    assert texts(one(book, "epub")[0]) == ["One", "One", "text"]
    z = one(package({"a.txt": "hello", "b.bin": b"\0"}), "zip")[0]
    assert kinds(z) == ["text", "text", "code", "text"] and texts(z)[2] == "hello"
    s = one('<svg xmlns="http://www.w3.org/2000/svg" width="5"><title>T</title><defs><rect/></defs><rect/><text>a <tspan>b</tspan></text></svg>', "svg")[0]
    assert texts(s)[:3] == ["width=5", "T", "a b"] and meta(s["elements"][3])["shapes"] == {"rect": 1}


def test_images_and_audio():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 64, 32, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))
    assert one(png, "png")[0]["elements"][0]["content"] == "[图片] PNG 64x32"
    assert meta(one(b"GIF89a" + struct.pack("<HH", 7, 9), "gif")[0]["elements"][0])["height"] == 9
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 32_000)
    m = meta(one(out.getvalue(), "audio")[0]["elements"][0])
    assert (m["channels"], m["sample_rate"], m["duration"]) == (2, 8000, 1.0)
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413
    assert meta(one(frame * 40, "audio")[0]["elements"][0])["bitrate"] == 128_000


def test_rows_errors_and_views(spark):
    src = raw(spark, {"a.md": "# H\n\ntext", "b.json": "{bad", "c.pdf": "%PDF-1.4", "d.csv": "a,b\n1,2\n", "e.txt": ""})
    p = parse(src)
    got = {r.name: r for r in p.select("name", "format", "error.kind", F.size("pages").alias("n")).collect()}
    assert got["a.md"].n == 1 and got["b.json"].kind == "parse_failed" and got["c.pdf"].kind == "unsupported_format" and got["d.csv"].format == "csv"
    assert elements(p).where("element_type = 'table_row'").count() == 2 and raw_pages(p).where("has_table").count() == 1


def test_translate_to_index(spark):
    out = translate(raw(spark, {"a.md": "# H\n\ntext", "d.csv": "name,b\n1,2\n", "c.pdf": "%PDF-1.4"}))
    rows = {r.name: r for r in out.collect()}
    assert rows["a.md"].strategy == "text_extraction" and rows["d.csv"].strategy == "table_extraction"
    assert json.loads(rows["c.pdf"].line)["error"]["kind"] == "unsupported_format" and json.loads(rows["c.pdf"].line)["code"] == 4003 and json.loads(rows["a.md"].line)["ok"]
    index = to_index(out, 5)
    assert index.where("status = 'completed'").count() == 2 and index.where("error_kind = 'unsupported_format'").count() == 1


def test_files_and_output_guard(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x" * 50)
    (tmp_path / "in" / "b.md").write_text("y")
    (tmp_path / "in" / "c.bin").write_text("z")
    got = {r.name: r for r in files(spark, f"{tmp_path}/in", extensions=["txt", ".md"], most_bytes=10).collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"].error.kind == "too_large" and got["a.txt"].content is None and bytes(got["b.md"].content) == b"y"
    assert check_output("/out/x/../a.md", ["/out"]) == "/out/a.md"
    for bad in ("/out/../etc/a.md", "/out/a.exe", "/outer/a.md"):
        try:
            check_output(bad, ["/out"])
        except ValueError:
            continue
        raise AssertionError(bad)
