"""Decisions and conversion strategies over document rows (file_type, pages array<struct>): scores, choice, content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import clean_controls, col, text_of

IMAGES = "png jpeg gif webp bmp tiff svg".split()
STRATEGIES = ("text_extraction", "structured_extraction", "table_extraction", "image_description", "ocr")
# Strategy of each requested conversion type.
BY_TYPE = {"text": "text_extraction", "structured": "structured_extraction", "table": "table_extraction", "image_desc": "image_description", "ocr": "ocr"}


def features(pages: Column) -> Column:
    return F.struct(
        F.exists(pages, lambda p: F.coalesce(p["has_table"], F.lit(False))).alias("has_table"),
        F.exists(pages, lambda p: F.coalesce(p["has_image"], F.lit(False))).alias("has_image"),
        F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(F.coalesce(p["raw_text"], F.lit("")))).alias("chars"),
        F.exists(pages, lambda p: F.exists(F.coalesce(p["elements"], F.array().cast("array<struct<element_id:string,element_type:string,content:string,meta:string>>")), lambda e: e["element_type"].isin("heading", "title"))).alias("has_heading"),
    )


def decision(fmt: str | Column, has_image: str | Column) -> Column:
    """array of strategies that a format asks for; a conversion is always needed."""
    f, image = col(fmt), F.coalesce(col(has_image), F.lit(False))
    return F.when(f.isin(IMAGES), F.array(F.lit("ocr"), F.lit("image_description"))).when(f.isin("pdf", "pptx"), F.when(image, F.array(F.lit("text_extraction"), F.lit("ocr"))).otherwise(F.array(F.lit("text_extraction")))).otherwise(F.array(F.lit("auto_detect")))


def scores(file_type: str | Column, pages: Column) -> Column:
    """array<struct<strategy, score>> in the order of registration."""
    t, f = col(file_type), features(pages)
    value = {
        "text_extraction": F.when(t.isin("ppt", "pdf", "doc", "txt"), 0.95).otherwise(0.3),
        "structured_extraction": F.when(t.isin("ppt", "pdf"), F.when(f["has_heading"], 0.9).otherwise(0.6)).otherwise(0.4),
        "table_extraction": F.when(f["has_table"] | t.isin("csv", "xls"), 0.95).otherwise(0.2),
        "image_description": F.when(t == "image", 0.95).when(f["has_image"], 0.85).otherwise(0.1),
        "ocr": F.when(t == "image", 0.9).when(f["has_image"], 0.7).otherwise(0.1),
    }
    return F.array(*(F.struct(F.lit(s).alias("strategy"), value[s].alias("score")) for s in STRATEGIES))


def select_strategy(file_type: str | Column, pages: Column, conversion_type: str = "auto") -> Column:
    """The asked strategy; for auto the best score, the first of equals. Unknown types count as auto."""
    if conversion_type in BY_TYPE:
        return F.lit(BY_TYPE[conversion_type])
    best = scores(file_type, pages)
    top = F.array_max(F.transform(best, lambda s: s["score"]))
    return F.get(F.filter(best, lambda s: s["score"] == top), F.lit(0))["strategy"]


def auto_detect(file_type: str | Column, pages: Column, long_text: int = 5000) -> Column:
    f = features(pages)
    return F.when(f["has_table"] & ~f["has_image"], "table_extraction").when((col(file_type) == "image") | f["has_image"], "image_description").when(f["chars"] > long_text, "structured_extraction").otherwise("text_extraction")


def page_mark(p: Column) -> Column:
    return F.concat(F.lit("--- 第 "), p["page_number"].cast("string"), F.lit(" 页 ---"))


def to_text(pages: Column) -> Column:
    return F.array_join(F.flatten(F.transform(pages, lambda p: F.array(page_mark(p), clean_controls(F.coalesce(p["raw_text"], F.lit("")))))), "\n\n")


def to_structure(pages: Column, title: str | Column) -> Column:
    """JSON of pages and elements; each element's content up to 500 characters."""
    element = lambda e: F.struct(e["element_type"].alias("type"), F.substring(e["content"], 1, 500).alias("content"))
    page = lambda p: F.struct(p["page_number"], F.transform(p["elements"], element).alias("elements"))
    return F.to_json(F.struct(F.struct(col(title).alias("title"), F.transform(pages, page).alias("pages")).alias("document")))


def images(pages: Column) -> Column:
    """array<struct<page, description>> of image elements."""
    of = lambda p: F.transform(F.filter(p["elements"], lambda e: e["element_type"] == "image"), lambda e: F.struct(p["page_number"].alias("page"), F.when(F.coalesce(e["content"], F.lit("")) != "", e["content"]).otherwise("图片").alias("description")))
    return F.flatten(F.transform(pages, of))


def to_image_text(pages: Column) -> Column:
    n = lambda x: x.cast("string")
    part = lambda x, i: F.concat(F.lit("## 图片 "), n(i + 1), F.lit(" (第 "), n(x["page"]), F.lit(" 页)\n- 位置: 第 "), n(x["page"]), F.lit(" 页\n- 描述: "), x["description"], F.lit("\n"))
    found = images(pages)
    return F.when(F.size(found) == 0, "未检测到图片内容").otherwise(F.concat(F.lit("# 图片内容描述\n\n"), F.array_join(F.transform(found, part), "\n")))


def to_ocr_text(pages: Column) -> Column:
    full = F.filter(pages, lambda p: F.trim(F.coalesce(p["raw_text"], F.lit(""))) != "")
    text = F.array_join(F.flatten(F.transform(full, lambda p: F.array(page_mark(p), p["raw_text"]))), "\n\n")
    return F.when(F.size(full) == 0, "未识别到文字内容").otherwise(text)


def to_media_index(pages: Column) -> Column:
    """JSON of a page's first 200 characters and first 5 elements (100 characters each)."""
    element = lambda e: F.struct(e["element_type"].alias("type"), F.substring(e["content"], 1, 100).alias("content"))
    page = lambda p: F.struct(p["page_number"].alias("page"), F.substring(p["raw_text"], 1, 200).alias("text_preview"), p["has_image"], p["has_table"], F.transform(F.slice(p["elements"], 1, 5), element).alias("elements"))
    return F.to_json(F.transform(pages, page))


def table_text(pages: Column) -> Column:
    """The table elements' content, one after another."""
    found = F.flatten(F.transform(pages, lambda p: F.transform(F.filter(p["elements"], lambda e: e["element_type"] == "table"), lambda e: e["content"])))
    return F.when(F.size(found) == 0, "").otherwise(F.array_join(found, "\n\n"))


def convert(file_type: str | Column, pages: Column, title: str | Column, conversion_type: str = "auto") -> Column:
    """struct<strategy, content, confidence>. Content and structured data never replace one another."""
    s = select_strategy(file_type, pages, conversion_type)
    tables, pics = table_text(pages), images(pages)
    read = F.exists(pages, lambda p: F.trim(F.coalesce(p["raw_text"], F.lit(""))) != "")
    content = F.when(s == "structured_extraction", to_structure(pages, title)).when(s == "table_extraction", F.when(tables != "", tables).otherwise(to_text(pages))).when(s == "image_description", to_image_text(pages)).when(s == "ocr", to_ocr_text(pages)).otherwise(to_text(pages))
    confidence = F.when(s == "structured_extraction", 0.85).when(s == "table_extraction", F.when(tables != "", 0.85).otherwise(0.3)).when(s == "image_description", F.when(F.size(pics) > 0, 0.75).otherwise(0.3)).when(s == "ocr", F.when(read, 0.8).otherwise(0.2)).otherwise(0.95)
    return F.struct(s.alias("strategy"), content.alias("content"), confidence.alias("confidence"))


def fallback(pages: Column, raw: str | Column, from_file: str | Column, converted: Column) -> Column:
    """Without pages the raw text passes through: confidence 0.3 for a file, 1.0 for other input, 0.5 for nothing."""
    t = text_of(raw)
    plain = F.struct(F.lit("passthrough").alias("strategy"), t.alias("content"), F.when(t == "", 0.5).when(col(from_file), 0.3).otherwise(1.0).alias("confidence"))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, converted).otherwise(plain)
