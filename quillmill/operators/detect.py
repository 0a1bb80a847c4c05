"""Format detection as Column expressions over (content binary, name string): signatures, extension, content, and the
order in which they count. Only the first 2,048 bytes take part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import NOT_PRINTABLE, col

# Mime type of each format, then its extensions where the mime type differs by extension.
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain", "rtf": "application/rtf", "csv": "text/csv", "json": "application/json", "yaml": "application/yaml", "xml": "application/xml", "html": "text/html",
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "svg": "image/svg+xml",
    "zip": "application/zip", "7z": "application/x-7z-compressed", "rar": "application/x-rar", "toml": "application/toml",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "epub": "application/epub+zip", "srt": "text/srt", "latex": "application/x-tex", "sql": "application/sql",
}
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "txt": "txt text md markdown", "rtf": "rtf", "csv": "csv tsv", "json": "json", "yaml": "yaml yml", "xml": "xml",
    "html": "html htm", "png": "png", "jpeg": "jpg jpeg", "gif": "gif", "webp": "webp", "bmp": "bmp", "tiff": "tiff tif", "zip": "zip", "7z": "7z", "rar": "rar", "toml": "toml",
    "odt": "odt", "ods": "ods", "odp": "odp", "eml": "eml", "msg": "msg", "epub": "epub", "svg": "svg", "srt": "srt vtt", "latex": "tex latex ltx", "sql": "sql",
    "audio": "wav mp3 flac ogg m4a aiff aif",
}
EXTENSION_MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "tsv": "text/tab-separated-values", "vtt": "text/vtt",
    "wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4", "aiff": "audio/aiff", "aif": "audio/aiff",
}
# Signatures at the start of a file, in hexadecimal.
SIGNATURES = {
    "pdf": ("25504446",), "png": ("89504E47",), "jpeg": ("FFD8FF",), "gif": ("474946383761", "474946383961"), "bmp": ("424D",), "tiff": ("49492A00", "4D4D002A"),
    "7z": ("377ABCAF271C",), "rar": ("52617221",),
}
MAIL_HEADERS = "From: To: Subject: Date: Message-ID: MIME-Version: Content-Type:".split()


def told(fmt: str | None, confidence: float = 0.0, mime: str | None = None, extension: Column | None = None) -> Column:
    return F.struct(
        F.lit(fmt).cast("string").alias("format"), F.lit(mime or MIME.get(fmt or "")).cast("string").alias("mime"), F.lit(float(confidence)).alias("confidence"),
        (extension if extension is not None else F.lit(None).cast("string")).alias("extension"),
    )


def suffix(name: str | Column) -> Column:
    """The lower-case extension with its dot, or an empty text."""
    last = F.regexp_extract(F.coalesce(col(name), F.lit("")), r"[^/\\]*$", 0)
    return F.lower(F.regexp_extract(last, r".(\.[^./\\]+)$", 1))


def by_extension(name: str | Column) -> Column:
    ext = suffix(name)
    of = {e: f for f, names in EXTENSIONS.items() for e in names.split()}
    formats = F.create_map(*(F.lit(x) for e, f in of.items() for x in (f".{e}", f)))
    mimes = F.create_map(*(F.lit(x) for e, f in of.items() for x in (f".{e}", EXTENSION_MIME.get(e) or MIME[f])))
    fmt = F.try_element_at(formats, ext)
    return F.when(fmt.isNotNull(), F.struct(fmt.alias("format"), F.try_element_at(mimes, ext).alias("mime"), F.lit(0.7).alias("confidence"), ext.alias("extension")))


def by_signature(content: str | Column) -> Column:
    """Read as hexadecimal digits, so that binary content is compared without decoding."""
    head = F.hex(F.substring(col(content), 1, 2048))
    holds = lambda s: head.rlike(f"^(?:..)*?{s.encode().hex().upper()}")
    out = F.when(F.length(head) < 8, F.lit(None).cast("struct<format:string,mime:string,confidence:double,extension:string>"))
    riff, form = head.startswith("52494646"), F.substring(head, 17, 8)
    known = F.when(form == "57454250", told("webp", 0.95)).when(form == "57415645", told("audio", 0.95, "audio/wav")).when(form == "41564920", told("binary", 0.95, "video/x-msvideo"))
    out = out.when(riff & (F.length(head) < 24), F.lit(None)).when(riff, known.otherwise(told("binary", 0.6, "application/riff")))
    mimetype = F.substring(head, F.greatest(F.instr(head, b"mimetype".hex().upper()), F.lit(1)), 400)
    odf = lambda s: (holds("mimetype") | holds("content.xml")) & (F.instr(mimetype, f"opendocument.{s}".encode().hex().upper()) > 0)
    zipped = F.when(holds("word/"), told("docx", 0.9)).when(holds("ppt/"), told("pptx", 0.9)).when(holds("xl/"), told("xlsx", 0.9)).when(holds("META-INF/container.xml"), told("epub", 0.9))
    zipped = zipped.when(odf("text"), told("odt", 0.9)).when(odf("spreadsheet"), told("ods", 0.9)).when(odf("presentation"), told("odp", 0.9)).otherwise(told("zip", 0.85))
    out = out.when(head.startswith("504B0304"), zipped)
    for fmt, starts in SIGNATURES.items():
        for s in starts:
            out = out.when(head.startswith(s), told(fmt, 0.95))
    return out


def readable(content: str | Column, most: int) -> Column:
    """The first bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return F.decode(F.make_valid_utf8(F.substring(col(content), 1, most)).cast("binary"), "utf-8")


def by_content(content: str | Column) -> Column:
    t = F.regexp_replace(F.replace(readable(content, 1024), F.lit("�"), F.lit("")), r"(?U)^\s+|\s+$", "")
    low, lines = F.lower(t), F.split(t, "\n")
    start = F.substring(t, 1, 200)
    count = lambda n, test: F.size(F.filter(F.transform(F.slice(lines, 1, n), F.trim), test))
    json_ = t.rlike(r"^[{\[]") & F.try_parse_json(t).isNotNull()
    markup = t.startswith("<?xml") | (t.startswith("<") & F.substring(t, 1, 100).contains(">"))
    page = F.substring(low, 1, 200).rlike(r"<html|<head|<body|<div|<p>|<span")
    yaml = start.contains(":") & t.rlike(r"[\n\r]") & (count(10, lambda x: (x != "") & x.contains(":") & ~x.rlike(r"^[#\-*|>]")) >= 3)
    toml = start.contains("=") & t.rlike(r"^[#\[]")
    toml = toml & (2 * count(15, lambda x: x.rlike(r"^\[[\w.]+\]$")) + count(15, lambda x: x.contains("=") & ~x.rlike(r"^[#\-+*{\[]")) >= 3)
    mail = F.trim(lines[0]).rlike(r"^(?:From|Return-Path|Received):") & (sum((t.contains(h).cast("int") for h in MAIL_HEADERS), F.lit(0)) >= 3)
    svg = t.contains('xmlns="http://www.w3.org/2000/svg"') | F.substring(t, 1, 256).contains("<svg")
    has = lambda i, s: F.length(F.get(lines, F.lit(i))) - F.length(F.replace(F.get(lines, F.lit(i)), F.lit(s), F.lit("")))
    two = F.size(lines) >= 2
    return (
        F.when(t == "", F.lit(None).cast("struct<format:string,mime:string,confidence:double,extension:string>"))
        .when(json_, told("json", 0.85)).when(markup, told("xml", 0.7)).when(page, told("html", 0.8)).when(yaml, told("yaml", 0.6)).when(toml, told("toml", 0.7))
        .when(mail, told("eml", 0.8)).when(svg, told("svg", 0.8))
        .when(two & (has(0, ",") >= 1) & (F.abs(has(1, ",") - has(0, ",")) <= 2), told("csv", 0.6))
        .when(two & (has(0, "\t") >= 1), told("csv", 0.5, "text/tab-separated-values"))
    )


def is_text(content: str | Column) -> Column:
    t = F.replace(readable(content, 1 << 16), F.lit("�"), F.lit(""))
    return (F.length(t) > 0) & (F.length(t) - F.regexp_count(t, F.lit(NOT_PRINTABLE)) > 0.95 * F.length(t))


def detect(content: str | Column, name: str | Column) -> Column:
    """struct<format, mime, confidence, extension>."""
    sig, ext, body = by_signature(content), by_extension(name), by_content(content)
    own = F.when(suffix(name) != "", suffix(name))
    return (
        F.when(F.coalesce(F.octet_length(col(content)), F.lit(0)) == 0, told("unknown", 0.0, "application/octet-stream"))
        .when(sig["confidence"] >= 0.7, sig).when(body["confidence"] >= 0.8, body).when(ext.isNotNull(), ext)
        .when(sig.isNotNull(), sig).when(body.isNotNull(), body)
        .when(is_text(content), told("txt", 0.5, extension=own)).otherwise(told("binary", 0.3, "application/octet-stream", own))
    )
