"""Document structure from lines with fonts and places: headings, lists, contents, page furniture, columns.

Lines are rows (doc, page, ord, text, font_size, bold, x0); each document stays whole within one window partition, and
only list nesting, whose state depends on the order of lines, leaves the built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import col, slugify

TOC_LINE = r"^(.{2,60}?)[\s·.]{3,}\s*(\d{1,3})\s*$"
LIST_LINE = r"^\s*(?:[•·*\-\x00]|\d+[.)）](?!\d)|[（(]\d+[）)]|[一二三四五六七八九十]+、)\s+(.*)$"
PAGE_NUMBER = r"^(?:-?\s*\d{1,4}\s*-?|第\s*\d+\s*页(?:\s*[/共].*)?|(?i:page)\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+)$"


def page_spec(spec: str, pages: int | None = None, most: int = 10_000) -> list[int]:
    """Page numbers of a list such as "1-3,7", in the order asked for, each once. Counts from 1."""
    out: dict[int, None] = {}
    for part in spec.split(","):
        a, dash, b = (x.strip() for x in part.strip().partition("-"))
        if not a.isdigit() or (dash and not b.isdigit()):
            raise ValueError(f"not a page or range: {part!r}")
        lo, hi = int(a), int(b) if dash else int(a)
        if lo < 1 or hi < lo or hi > (pages or hi) or hi - lo + 1 + len(out) > most:
            raise ValueError(f"pages must count up from 1 within the document, {most} at most: {part!r}")
        out |= dict.fromkeys(range(lo, hi + 1))
    return list(out)


def select_pages(df: DataFrame, spec: str, page: str = "page") -> DataFrame:
    """Rows of the asked pages with their place in the request (page_ord); a small inner join."""
    asked = df.sparkSession.createDataFrame(list(enumerate(page_spec(spec))), "page_ord int, _page int")
    return df.join(F.broadcast(asked), F.col(page) == F.col("_page")).drop("_page")


def furniture(lines: DataFrame, head: int = 3, tail: int = 3, share: float = 0.6, least_pages: int = 3, page_numbers: bool = False) -> DataFrame:
    """doc, text: lines that stand within the first or last few of at least max(share * pages, 2) pages of a document.
    page_numbers adds lines that look like one."""
    w = Window.partitionBy("doc", "page")
    bare = lines.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    place = bare.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("ord")))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    edge = place.where((F.col("_i") <= head) | (F.col("_i") > F.col("_n") - tail))
    often = edge.groupBy("doc", "text").agg(F.count_distinct("page").alias("on_pages")).join(pages, "doc")
    out = often.where((F.col("pages") >= least_pages) & (F.col("on_pages") >= F.greatest(share * F.col("pages"), F.lit(2.0)))).select("doc", "text")
    return out.union(edge.where(F.col("text").rlike(PAGE_NUMBER)).select("doc", "text")).distinct() if page_numbers else out


def strip_furniture(lines: DataFrame, head: int = 3, tail: int = 3, **options) -> DataFrame:
    """lines without furniture at the edges of pages."""
    w = Window.partitionBy("doc", "page")
    marks = furniture(lines, head, tail, **options).select(F.col("doc").alias("_doc"), F.col("text").alias("_text"), F.lit(True).alias("_hit"))
    placed = lines.withColumn("_full", (F.trim("text") != "").cast("int"))
    placed = placed.withColumn("_i", F.sum("_full").over(w.orderBy("ord"))).withColumn("_n", F.sum("_full").over(w))
    joined = placed.join(marks, (F.col("doc") == F.col("_doc")) & (F.trim("text") == F.col("_text")), "left")
    edge = (F.col("_i") <= head) | (F.col("_i") > F.col("_n") - tail)
    return joined.where(~(F.coalesce("_hit", F.lit(False)) & edge)).select(*lines.columns)


def body_size(lines: DataFrame) -> DataFrame:
    """doc, body: the upper median of font sizes, each line weighing its length (40 at most)."""
    sized = lines.where(F.col("font_size") > 0).withColumn("_w", F.least(F.length("text"), F.lit(40))).where("_w > 0")
    by = sized.groupBy("doc", "font_size").agg(F.sum("_w").alias("_w"))
    w = Window.partitionBy("doc")
    by = by.withColumn("_upto", F.sum("_w").over(w.orderBy("font_size"))).withColumn("_all", F.sum("_w").over(w))
    return by.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy("doc").agg(F.min("font_size").alias("body"))


def heading_level(size: str | Column, bold: str | Column, body: str | Column) -> Column:
    r = col(size) / F.when(col(body) > 0, col(body))
    return F.when(r >= 1.5, 1).when(r >= 1.22, 2).when(r >= 1.12, 3).when(F.coalesce(col(bold), F.lit(False)) & (r >= 1.0), 4)


def annotate(lines: DataFrame) -> DataFrame:
    """lines with toc_title, toc_page, is_list, list_text, heading_level, toc_page_mark."""
    bare = F.trim("text")
    toc = bare.rlike(TOC_LINE)
    lst = ~toc & F.col("text").rlike(LIST_LINE)
    fits = (F.length(bare) <= 60) & ~bare.rlike("[。；;,]$") & (bare != "")
    d = lines.join(body_size(lines), "doc", "left")
    d = d.withColumn("toc_title", F.when(toc, F.regexp_replace(F.trim(F.regexp_extract(bare, TOC_LINE, 1)), r"\s+", " "))).withColumn("toc_page", F.when(toc, F.regexp_extract(bare, TOC_LINE, 2).cast("int")))
    d = d.withColumn("is_list", lst).withColumn("list_text", F.when(lst, F.trim(F.regexp_extract("text", LIST_LINE, 1))))
    d = d.withColumn("heading_level", F.when(~toc & ~lst & fits, heading_level("font_size", "bold", "body")))
    hits = F.count(F.when(F.col("toc_title").isNotNull(), 1)).over(Window.partitionBy("doc", "page"))
    return d.withColumn("toc_page_mark", hits >= 3).drop("body")


def list_levels(annotated: DataFrame, tolerance: float = 6.0, deepest: int = 4) -> DataFrame:
    """annotated with list_level: by x0 among the list lines since the last other line of the page; a place more than
    tolerance to the right of a seen one is a level below it. The fold depends on order, so it runs page by page."""
    schema = annotated.drop("list_level").schema.simpleString()[7:-1] + ",list_level:int"

    def levels(page):
        page = page.sort_values("ord")
        seen, out = [], []
        for is_list, text, x0 in zip(page["is_list"], page["text"], page["x0"], strict=True):
            if not is_list:
                out.append(None)
                if (text or "").strip():
                    seen = []
                continue
            level = 1
            if x0 == x0 and x0 is not None:
                level = max([1, *(k + 1 if x0 > x + tolerance else k for x, k in seen if x0 >= x - tolerance)])
                seen.append((x0, level))
            out.append(min(level, deepest))
        return page.assign(list_level=out)

    return annotated.groupBy("doc", "page").applyInPandas(levels, schema)


def render_markdown(annotated: DataFrame) -> DataFrame:
    """doc, markdown: headings, contents as links, nested lists, other lines as they are."""
    bare = F.trim("text")
    level = F.coalesce(F.col("list_level"), F.lit(1)) if "list_level" in annotated.columns else F.lit(1)
    line = (
        F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), bare, F.lit("\n")))
        .when(F.col("toc_title").isNotNull(), F.concat(F.lit("- ["), F.col("toc_title"), F.lit("](#"), slugify("toc_title"), F.lit(")")))
        .when(F.col("is_list"), F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), F.col("list_text")))
        .otherwise(bare)
    )
    rows = annotated.where(bare != "").select("doc", "page", "ord", line.alias("line"))
    pages = rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: F.rtrim(x["body"])), "\n\n")
    return pages.groupBy("doc").agg(F.concat(F.trim(whole), F.lit("\n")).alias("markdown"))


def two_columns(words: DataFrame, gutter: float = 0.04, balance: float = 0.25) -> DataFrame:
    """words (doc, page, x0, x1, top, width of the page) with is_two_column and reading order `rank`: a page has two
    columns where almost no word crosses the middle and each side holds a fair share."""
    w = Window.partitionBy("doc", "page")
    mid = F.col("width") / 2
    n = F.count("*").over(w)
    cross = F.count(F.when((F.col("x0") < mid) & (F.col("x1") > mid), 1)).over(w)
    left = F.count(F.when(F.col("x1") <= mid, 1)).over(w)
    right = F.count(F.when(F.col("x0") >= mid, 1)).over(w)
    d = words.withColumn("is_two_column", (cross <= gutter * n) & (left >= balance * n) & (right >= balance * n))
    side = F.when(F.col("is_two_column") & (F.col("x0") >= mid), 1).otherwise(0)
    return d.withColumn("column", side).withColumn("rank", F.row_number().over(w.orderBy("column", "top", "x0")))


def first_font(lines: DataFrame, fonts: DataFrame) -> DataFrame:
    """lines (doc, page, text, ...) with font_size, bold and x0 of the first font row of the same normalised text."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    one = fonts.groupBy("doc", "page", norm("text").alias("_norm")).agg(F.min_by(F.struct("font_size", "bold", "x0"), "ord").alias("_f"))
    return lines.withColumn("_norm", norm("text")).join(one, ["doc", "page", "_norm"], "left").select(*lines.columns, "_f.font_size", "_f.bold", "_f.x0")
