"""Quality scores, grades, actions and enhance hints as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import ALNUM, NOT_PRINTABLE, col, stride_sample, text_of

# Expected share of text in a file by type; weights of the five scores by type.
DENSE_TYPES = "txt csv md text json xml html sql latex toml".split()
IMAGE_TYPES = "image jpg jpeg png gif bmp webp tiff".split()
TEXT_TYPES = "txt md markdown json yaml yml xml toml html tsv sql srt vtt latex tex log".split()
TABLE_TYPES = "csv xlsx xls ods".split()
SLIDE_TYPES = "pptx ppt".split()
# Signs of wrongly decoded text, and of text that was cut.
MOJIBAKE = (r"[\x{c0}-\x{ff}][\x{80}-\x{bf}]", r"Ã[©®\x{81}-\x{bf}]", r"â[\x{80}-\x{bf}]")
ENDINGS = (
    (r"\.\.\.$", 10), (r"[，,、;；:：]$", 5), (r"\b(?:and|or|the|a|an|在|和|或者|的|一个)\s*$", 5), (r"[(\{\[（【]\s*$", 10), (r"```\s*$", 8), (r"<[^>]*$", 8),
)
CUT_MARKS = r"\b(?:truncated|cut off|\.\.\.\s*more|continued\.\.\.)\b|内容已截断|以下内容省略|余下部分省略"
ASCII_EDGE = r"(?-iu:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def count(c: Column, pattern: str, width: int = 1) -> Column:
    """Matches of a pattern of fixed width, by what is left without them: a run of matches is one replacement."""
    return ((F.length(c) - F.length(F.regexp_replace(c, f"(?:{pattern})+", ""))) / width).cast("int")


def bound(value: Column, use) -> Column:
    """use(value), with value taken once for each row however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_evidence(c: str | Column) -> Column:
    """Printable share of a bounded sample, times 0.3 where under 5 % is alphanumeric; 0 for an empty text."""

    def share(s: Column) -> Column:
        n = F.length(s)
        return F.when(n == 0, 0.0).otherwise((n - count(s, NOT_PRINTABLE)) / n * F.when(count(s, ALNUM) / n < 0.05, 0.3).otherwise(1.0))

    return bound(stride_sample(c), share)


def half_up(c: Column) -> Column:
    return F.round(c, 1)


def coverage_expected(file_type: str | Column) -> Column:
    kind = F.lower(text_of(file_type))
    return F.when(kind.isin(DENSE_TYPES), 0.3).when(kind.isin(IMAGE_TYPES), 0.01).otherwise(0.05)


def text_coverage(c: str | Column, size: str | Column, file_type: str | Column) -> Column:
    t, n = text_of(c), col(size).cast("double")
    r, e = F.length(t) / n, coverage_expected(file_type)
    s = F.when(r >= e, 100.0).when(r >= e / 2, 50 + (r / e - 0.5) * 100).when(r > 0, r / (e / 2) * 50).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0.0)) <= 0, 0.0).otherwise(half_up(s * text_evidence(c)))


def encoding_confidence(c: str | Column) -> Column:
    t = text_of(c)
    signs = count(t, r"\x{FFFD}") + sum((count(t, p, 2) for p in MOJIBAKE[1:]), count(t, MOJIBAKE[0], 2))
    level = lambda g: F.when(g < 0.01, 100.0).when(g < 0.05, 75.0).when(g < 0.15, 50.0).when(g < 0.3, 25.0).otherwise(0.0)
    return F.when(t == "", 0.0).when(~t.rlike(r"[^\x00-\x7F]"), 100.0).otherwise(bound(signs / F.length(t), level))


def structure_score(c: str | Column) -> Column:
    t = text_of(c)
    signs = (r"(?md)^#{1,6}(?U:\s)", r"(?mdU)^\s*(?:[-*+]|\d+[.)])\s", r"(?d)\|.*\|.*\|", r"\n\n")
    return F.when(t == "", 0.0).otherwise(sum((F.when(t.rlike(p), 25.0).otherwise(0.0) for p in signs), F.lit(0.0)))


def completeness_score(c: str | Column, ascii_words: bool = False) -> Column:
    """100 less what the signs of a cut cost. Words, their ends and white space are Unicode's; with ascii_words they are
    ASCII's, as regular expressions in SQL have them: "ía" then ends in the word "a", and Chinese words don't count."""
    t = text_of(c)

    def sign(pattern: str, flags: str) -> str:
        if not ascii_words:
            return f"(?{flags}U){pattern}"
        return f"(?{flags}u)" + pattern.replace("|在|和|或者|的|一个", "").replace(r"\b", ASCII_EDGE).replace(r"\s", r"[\t\n\f\r ]")

    bare = F.regexp_replace(t, r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z" if ascii_words else r"(?U)^\s+|\s+$", "")
    lost = sum((F.when(bare.rlike(sign(p, "imd")), points).otherwise(0) for p, points in ENDINGS), F.lit(0))
    lost = lost + F.when(F.length(t) < 10, 20).otherwise(0) + F.when(t.rlike(sign(CUT_MARKS, "i")), 15).otherwise(0)
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0), 100 - lost).cast("double"))


def table_penalty(grid: Column) -> Column:
    """What one table costs: empty 10, ragged 20, over half of its cells blank 15, a blank header 5."""
    cells = F.flatten(grid)
    blank = F.size(F.filter(cells, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""))
    header = F.get(grid, F.lit(0))
    return F.when(F.coalesce(F.size(grid), F.lit(0)) <= 0, 10).otherwise(
        F.when(F.size(F.array_distinct(F.transform(grid, F.size))) > 1, 20).otherwise(0)
        + F.when(blank > 0.5 * F.size(cells), 15).otherwise(0)
        + F.when(F.exists(header, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), 5).otherwise(0)
    )


def table_accuracy(c: str | Column, grids: Column | None = None) -> Column:
    """grids: array of tables; null where there is no structured data, as for all rows if it is left out."""
    plain = F.when(text_of(c).rlike(r"(?mdU)^\s*\|"), 50.0).otherwise(100.0)
    if grids is None:
        return plain
    return F.when(grids.isNull(), plain).otherwise(F.greatest(F.lit(0.0), 100.0 - F.aggregate(grids, F.lit(0), lambda a, g: a + table_penalty(g))))


def weights(file_type: str | Column) -> list[Column]:
    """Of coverage, encoding, structure, tables and completeness."""
    kind = F.lower(text_of(file_type))
    text, grid, slides = kind.isin(TEXT_TYPES), kind.isin(TABLE_TYPES), kind.isin(SLIDE_TYPES)
    return [
        F.lit(0.15),
        F.lit(0.25),
        F.when(grid, 0.10).when(slides, 0.35).otherwise(0.25),
        F.when(text, 0.0).when(grid, 0.35).otherwise(0.15),
        F.when(grid, 0.10).otherwise(0.20),
    ]


def overall(scores: list[Column], file_type: str | Column) -> Column:
    w = weights(file_type)
    return half_up(sum((s * x for s, x in zip(scores, w, strict=True)), F.lit(0.0)) / sum(w, F.lit(0.0)))


def grade(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F")


def actions(c: str | Column, coverage: str | Column, has_table: str | Column) -> Column:
    """array<struct<code, retry_with>>: what to try again, and how."""
    t = text_of(c)
    lossy, marks = t.contains("\ufffd"), t.rlike(MOJIBAKE[1]) | t.rlike(MOJIBAKE[2])
    act = lambda code, retry: F.struct(F.lit(code).alias("code"), F.lit(retry).alias("retry_with"))
    none = F.lit(None).cast("struct<code:string,retry_with:string>")
    return F.filter(
        F.array(
            F.when(lossy, act("encoding", "encoding=gbk")).when(marks, act("encoding", "encoding=latin-1")).otherwise(none),
            F.when(col(coverage) < 50, act("coverage", "conversion_type=ocr")).otherwise(none),
            F.when(col(has_table), act("table", "conversion_type=table")).otherwise(none),
        ),
        lambda a: a.isNotNull(),
    )


def report(c: str | Column, size: str | Column, file_type: str | Column, has_table: str | Column | None = None, grids: Column | None = None) -> Column:
    """struct of the five scores, overall, grade and actions."""
    scores = [text_coverage(c, size, file_type), encoding_confidence(c), structure_score(c), table_accuracy(c, grids), completeness_score(c)]
    total = overall(scores, file_type)
    names = ("text_coverage", "encoding_confidence", "structure_preservation", "table_accuracy", "completeness")
    return F.struct(
        *(s.alias(n) for s, n in zip(scores, names, strict=True)), total.alias("overall"), grade(total).alias("grade"),
        actions(c, scores[0], has_table if has_table is not None else F.lit(False)).alias("actions"),
    )


def enhance_reason(pages: Column, confidence: str | Column, ocr_confidence: str | Column | None = None) -> Column:
    """The first rule that holds, or null: half of the pages blank; OCR under 0.6; confidence under 0.5; a page with a
    table but no table element."""
    blank = F.size(F.filter(pages, lambda p: F.trim(F.coalesce(p["raw_text"], F.lit(""))) == ""))
    n = F.size(pages)
    ocr = col(ocr_confidence) if ocr_confidence is not None else F.lit(None).cast("double")
    has = F.exists(pages, lambda p: p["has_table"])
    found = F.exists(pages, lambda p: F.exists(p["elements"], lambda e: e["element_type"] == "table"))
    return F.when(
        F.coalesce(n, F.lit(0)) > 0,
        F.when(2 * blank >= n, "image_only").when(ocr < 0.6, "ocr_low_confidence").when(col(confidence) < 0.5, "low_confidence").when(has & ~found, "table_sparse"),
    )
