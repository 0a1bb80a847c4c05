"""Text functions as Column expressions (JVM side; only text_similarity has Python in its plan, in Arrow batches)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How list items and new paragraphs of recognised text start (digits as Python's isdigit takes them).
OCR_LIST = r"^(?:[•*·-]|[0-9]\.|\([123]\)|[①②③]|[一二三四五]、)"
OCR_START = r"^(?:#|[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]|\p{IsUppercase}|[一二三四五六七八九十])"

# Java's classes for what Python calls printable and alphanumeric; see SURVEY 0.3 for where the two differ.
NOT_PRINTABLE = r"[\p{C}\p{Z}\x{FFFD}&&[^ \n\r\t]]"
ALNUM = r"[\p{L}\p{N}]"
FILE_SEPARATORS = ("\n\n---\n\n", "<!-- ff-file-sep -->")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once: within a lambda an expression is computed again for each element, while a
    lambda's variable is a value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams_of(text: Column, n: int | Column = 3) -> Column:
    """The distinct runs of n (1 to 3) characters of a text."""
    size = F.lit(n) if isinstance(n, int) else n

    def runs(chars: Column) -> Column:
        held = F.size(chars)
        run = lambda i: F.concat(F.get(chars, i), F.when(size > 1, F.get(chars, i + 1)).otherwise(F.lit("")), F.when(size > 2, F.get(chars, i + 2)).otherwise(F.lit("")))
        return F.when(held >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), held - size), run))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), runs)


def text_of(c: str | Column) -> Column:
    """The column with null as empty text."""
    return F.coalesce(col(c), F.lit(""))


def clean_controls(c: str | Column) -> Column:
    """Drops control characters but for tab, newline and carriage return; the mark of a lost byte becomes "?"."""
    return F.replace(F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit("ï¿½"), F.lit("?"))


def stride_sample(c: str | Column, most: int = 65_536) -> Column:
    """The text, or every k-th character of a longer one so that at most `most` are left."""
    t = text_of(c)
    # the stride is bound to a name of its own: within the filter it would be taken anew for every character
    bound = F.array(F.struct(F.ceil(F.length(t) / most).alias("k"), F.split(t, "").alias("chars")))
    each = F.transform(bound, lambda b: F.array_join(F.filter(b["chars"], lambda _, i: i % b["k"] == 0), ""))
    return F.when(F.length(t) <= most, t).otherwise(F.get(each, F.lit(0)))


def file_digest(content: str | Column, whole: int = 8 << 20, head: int = 1 << 20) -> Column:
    """SHA-256 of the content; of its first MiB, marked with the size, where it is larger than 8 MiB."""
    c, n = col(content), F.octet_length(col(content))
    return F.when(n <= whole, F.sha2(c, 256)).otherwise(F.concat(F.sha2(F.substring(c, 1, head), 256), F.lit(":head1mb:"), n.cast("string")))


def cache_key(content: str | Column, *params: str | Column) -> Column:
    """One key for content and all parameters, which are told apart from one another."""
    parts = [F.sha2(col(content).cast("binary"), 256), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("\0")) for p in params)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def path_hash(path: str | Column, salt: int = 0) -> Column:
    return F.substring(F.sha1(F.concat(col(path), F.lit(f"#{salt}" if salt else ""))), 1, 8)


def base64_size(c: str | Column) -> Column:
    """Bytes that a base64 text decodes to, by arithmetic alone."""
    bare = F.regexp_replace(col(c), r"\s", "")
    return F.floor(F.length(bare) * 3 / 4).cast("long") - F.when(bare.endswith("=="), 2).when(bare.endswith("="), 1).otherwise(0)


def escape_md_cell(c: str | Column) -> Column:
    """Newlines as <br>; a pipe gets a backslash unless an odd number of them stands before it."""
    t = F.regexp_replace(text_of(c), r"\r\n|\r|\n", "<br>")
    return F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)\|", r"$1\\|")


def slugify(c: str | Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(col(c))), r"(?U)\s+", "-")
    return F.regexp_replace(t, r"(?U)[^\w\x{4e00}-\x{9fff}-]", "")


def element_type(c: str | Column) -> Column:
    """The type of a paragraph of plain text."""
    raw = text_of(c)
    t = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    first = F.split(t, "\n")[0]
    return (
        F.when(t == "", "empty")
        .when((F.length(t) < 100) & (t.endswith(":") | t.endswith("：")), "heading")
        .when(t.startswith("#") & (F.length(first) < 100), "heading")
        .when(t.startswith("```"), "code")
        .when(first.rlike(r"^(?:[•*-]|1\.|2\.|（|\()"), "list")
        .when(first.startswith(">"), "quote")
        .otherwise("text")
    )


def paragraphs(c: str | Column) -> Column:
    """array<struct<idx, text, type>>: trimmed paragraphs (split at blank lines), blank ones left out, places kept."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    all_ = F.transform(F.split(text_of(c), "\n\n"), lambda x, i: F.struct(i.alias("idx"), strip(x).alias("text"), element_type(x).alias("type")))
    return F.filter(all_, lambda p: p["text"] != "")


def search_term(term: str) -> str:
    """A phrase for substring search."""
    return term.strip().replace('"', " ").strip()


def safe_message(c: str | Column, most: int = 400) -> Column:
    """Paths shortened to their last part, and at most 400 characters."""
    t = F.regexp_replace(text_of(c), r"(?:[A-Za-z]:\\|\\\\)(?:[^\\\s'\"]+\\)*([^\\\s'\"]+)", "$1")
    t = F.regexp_replace(t, r"(?<![\w.:/])/(?:[^/\s'\"]+/)+([^/\s'\"]+)", "$1")
    return F.substring(t, 1, most)


def human_size(c: str | Column) -> Column:
    """One decimal, ties to the even digit, and a unit of 1,024 steps."""
    n = col(c).cast("double")
    text = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))
    return F.when(n < 1024, text(0, "B")).when(n < 1 << 20, text(1, "KB")).when(n < 1 << 30, text(2, "MB")).when(n < 1 << 40, text(3, "GB")).otherwise(text(4, "TB"))


def human_duration(c: str | Column) -> Column:
    s = F.floor(col(c)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def new_id(prefix: str, at: Column | None = None) -> Column:
    """prefix, 14 digits of time, 6 hexadecimal digits."""
    return F.concat(F.lit(prefix), F.date_format(at if at is not None else F.current_timestamp(), "yyyyMMddHHmmss"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def id_time(c: str | Column) -> Column:
    """The time within an id, or null."""
    return F.try_to_timestamp(F.regexp_extract(col(c), r"^[a-z]+(\d{14})[0-9a-f]{6}$", 1), F.lit("yyyyMMddHHmmss"))


def looks_garbled(c: str | Column) -> Column:
    """Under 80 % printable, or mojibake marks where a tenth or less of the text is CJK."""
    t = text_of(c)
    n = F.length(t)
    cjk = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]"))
    marks = F.regexp_count(t, F.lit(r"[ÃÂâ€œ™ï¿½]"))
    return (n > 0) & ((n - F.regexp_count(t, F.lit(NOT_PRINTABLE)) < 0.8 * n) | ((cjk < 0.1 * n) & (marks > 0.05 * n)))


def strip_html(c: str | Column) -> Column:
    """Mail bodies: scripts and styles dropped, breaks and paragraph ends as newlines, tags off, common entities read."""
    t = F.regexp_replace(text_of(c), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p\s*>|</div\s*>|</tr\s*>|</li\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_cue(c: str | Column) -> Column:
    """Subtitle text without tags and braces' settings."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(c), r"<[^>]+>", ""), r"\{\\[^}]*\}", ""))


def inline_text(c: str | Column) -> Column:
    """Markdown's inline marks taken off."""
    t = text_of(c)
    for pattern, to in (
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"),
        (r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "$1"), (r"(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", "$1"), (r"~~(.*?)~~", "$1"), (r"\[\^([^\]]+)\]", "$1"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def cut(c: str | Column, most: int, mark: str = "...") -> Column:
    t = text_of(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(mark))).otherwise(t)


def summary_of_pages(pages: Column, each: int = 500, first: int = 3, most: int = 1500) -> Column:
    """Up to 500 characters of each of the first 3 pages, 1,500 in all."""
    parts = F.transform(F.slice(pages, 1, first), lambda p: F.substring(F.coalesce(p["raw_text"], F.lit("")), 1, each))
    return cut(F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n"), most)


def truncate_at(c: str | Column, most: int, start: Column | int = 0) -> Column:
    """struct<chunk, next>: a page of at most `most` characters from start, cut at a file separator, else at a blank
    line in its second half, else at a line's end, else hard; next is null at the end. Separators are dropped."""
    t = text_of(c)
    s = F.lit(start) if isinstance(start, int) else start
    n = F.length(t)
    window = F.substring(t, s + 1, F.lit(most))
    rfind = lambda sep: F.when(F.instr(window, sep) > 0, F.length(window) - F.locate(sep[::-1], F.reverse(window)) - len(sep) + 1).otherwise(-1)
    seps = [(rfind(x), len(x)) for x in FILE_SEPARATORS]
    at = F.greatest(*(x[0] for x in seps))
    width = F.when(seps[0][0] == at, seps[0][1]).otherwise(seps[1][1])
    para, line = rfind("\n\n"), rfind("\n")
    place = F.when(at >= 0, at).when(para >= most // 2, para).otherwise(line)
    gap = F.when(at >= 0, width).when(para >= most // 2, 2).otherwise(1)
    nxt = F.when(place <= 0, F.least(s + most, n)).otherwise(s + place + gap)
    return (
        F.when(s >= n, F.struct(F.lit("").alias("chunk"), F.lit(None).cast("int").alias("next")))
        .when(s + most >= n, F.struct(F.substring(t, s + 1, n).alias("chunk"), F.lit(None).cast("int").alias("next")))
        .otherwise(F.struct(F.when(place <= 0, window).otherwise(F.substring(window, F.lit(1), place)).alias("chunk"), F.when(nxt < n, nxt).cast("int").alias("next")))
    )


def format_output(content: str | Column, kind: str, structured: Column | None = None) -> Column:
    t = text_of(content)
    if kind == "json":
        return F.to_json(F.struct(t.alias("content"), *([structured.alias("structured")] if structured is not None else [])))
    if kind == "markdown":
        return F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("# 转换结果\n\n"), t))
    if kind == "html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n\n", "</p><p>"), ("\n", "<br>")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.concat(F.lit("<div class='converted-content'><p>"), t, F.lit("</p></div>"))
    return t


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_similarity(a: str | Column, b: str | Column) -> Column:
    """How alike two texts are without their case and spaces, by matching blocks: 0 to 1. Empty or null texts give 0."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    bare = lambda c: F.replace(F.lower(text_of(c)), F.lit(" "), F.lit(""))
    x, y = bare(a), bare(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(ratio(x, y))


def ocr_table_line(line: Column) -> Column:
    """Whether a line of recognised text looks like a row of a table: tabs, two pipes, or 2 to 10 parts between gaps."""
    parts = F.size(F.filter(F.split(line, "  "), lambda p: stripped(p) != ""))
    return F.contains(line, F.lit("\t")) | line.rlike(r"\|[^|]*\|") | parts.between(2, 10)


def ocr_table_row(line: Column) -> Column:
    cells = lambda by: F.transform(F.split(line, by), stripped)
    held = lambda by: F.filter(cells(by), lambda c: c != "")
    row = F.when(F.contains(line, F.lit("|")), held(r"\|")).when(F.contains(line, F.lit("\t")), cells("\t")).otherwise(held("  "))
    return F.array_join(row, " | ")


def ocr_paragraphs(c: str | Column) -> Column:
    """Recognised text with its broken lines joined: paragraphs, list items and tables apart by a blank line. One fold
    over the lines; null stays null."""
    listed = lambda s: s.rlike(OCR_LIST)
    # each line is looked at once, outside the fold
    lines = F.transform(
        F.split(col(c), "\n"),
        lambda raw: F.struct(
            stripped(raw).alias("s"), ocr_table_line(raw).alias("raw_table"), ocr_table_line(stripped(raw)).alias("table"),
            listed(stripped(raw)).alias("item"), (stripped(raw).rlike(OCR_START) | listed(stripped(raw))).alias("start"), ocr_table_row(stripped(raw)).alias("row"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        on, out = acc["on"], acc["out"]
        gap = F.when(acc["any"], "\n\n").otherwise("")
        state = lambda text, kind, some=True: F.struct(text.alias("out"), F.lit(kind).alias("on"), (F.lit(True) if some else acc["any"]).alias("any"))
        return (
            F.when((on == "table") & x["raw_table"], state(F.concat(out, F.lit("\n"), x["row"]), "table"))
            .when(x["s"] == "", state(out, "", False))
            .when((on == "text") & ~x["start"], state(F.concat(out, F.lit(" "), x["s"]), "text"))
            .when(x["table"], state(F.concat(out, gap, x["row"]), "table"))
            .when(x["item"], state(F.concat(out, gap, x["s"]), ""))
            .otherwise(state(F.concat(out, gap, x["s"]), "text"))
        )

    return F.aggregate(lines, F.struct(F.lit("").alias("out"), F.lit("").alias("on"), F.lit(False).alias("any")), step, lambda acc: acc["out"])
