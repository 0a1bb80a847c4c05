"""Result shaping: pages of bounded length, retrieval chunks, messages, summaries, joined files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import FILE_SEPARATORS, text_of

STRIP = r"(?U)^\s+|\s+$"


def next_cut(text: str, most: int, start: int) -> tuple[str, int | None]:
    """One page from start: the Python twin of functions.text.truncate_at."""
    end = start + most
    if end >= len(text):
        return text[start:], None
    window = text[start:end]
    places = [(window.rfind(s), len(s)) for s in FILE_SEPARATORS]
    at, gap = max(places)
    if at < 0:
        at, gap = window.rfind("\n\n"), 2
        if at < most // 2:
            at, gap = window.rfind("\n"), 1
    at, following = (len(window), end) if at <= 0 else (at, start + at + gap)
    return window[:at], following if following < len(text) else None


def truncate_pages(df: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, page, start, chunk: the whole text in pages of at most `most` characters. Where each page starts depends on
    the one before, so texts are paged in Arrow batches, without a shuffle."""
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, t in zip(b[id_col], b[text_col], strict=True):
                start, page = 0, 0
                while start is not None and t and start < len(t):
                    chunk, following = next_cut(t, most, start)
                    rows.append((i, page, start, chunk))
                    start, page = following, page + 1
            yield pd.DataFrame(rows, columns=[id_col, "page", "start", "chunk"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, page int, start int, chunk string")


def rag_chunks(df: DataFrame, text_col: str = "text", separator: str = "\n\n", name_col: str | None = None) -> DataFrame:
    """df with chunk_id (the place before blank ones are dropped), chunk and its length."""
    parts = F.transform(F.split(text_of(text_col), f"\\Q{separator}\\E"), lambda x: F.regexp_replace(x, STRIP, ""))
    out = df.select(*(c for c in df.columns if c != text_col), F.posexplode(parts).alias("chunk_id", "chunk")).where(F.col("chunk") != "")
    source = F.when(text_of(name_col) != "", F.col(name_col)).otherwise("doc") if name_col else F.lit("doc")
    return out.withColumn("chunk_length", F.length("chunk")).withColumn("vector_id", F.concat(source, F.lit("_chunk_"), F.col("chunk_id").cast("string")))


def messages(content: str | Column, prompt: str = "以下是从文档中提取的内容，请根据用户后续指令进行处理。") -> Column:
    part = F.array(F.struct(F.lit("text").alias("type"), text_of(content).alias("text")))
    none = F.lit(None).cast("array<struct<type:string,text:string>>")
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("text"), none.alias("parts")), F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("text"), part.alias("parts")))


def conversation_messages(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its turns in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))))
    return turns.groupBy(id_col).agg(listed.alias("messages"))


def langchain_doc(content: str | Column, name: str | Column) -> Column:
    return F.struct(text_of(content).alias("page_content"), F.struct(text_of(name).alias("source"), F.length(text_of(content)).alias("content_length")).alias("metadata"))


def summary(content: str | Column, tables: Column | int = 0) -> Column:
    """struct<summary, total_characters, total_lines, sections, paragraphs, tables>."""
    t = text_of(content)
    return F.struct(
        F.substring(t, 1, 500).alias("summary"), F.length(t).alias("total_characters"), F.size(F.split(t, "\n")).alias("total_lines"),
        F.regexp_count(t, F.lit(r"(?md)^#+(?U:\s)")).alias("sections"),
        F.size(F.filter(F.split(t, "\n\n"), lambda p: F.regexp_replace(p, STRIP, "") != "")).alias("paragraphs"),
        (F.lit(tables) if isinstance(tables, int) else tables).alias("tables"),
    )


TEMPLATES: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "openai_messages": lambda df, text, name: df.withColumn("result", messages(text)),
    "rag_chunks": lambda df, text, name: rag_chunks(df, text, name_col=name),
    "vector_db": lambda df, text, name: rag_chunks(df, text, name_col=name),
    "langchain_doc": lambda df, text, name: df.withColumn("result", langchain_doc(text, name)),
    "summary": lambda df, text, name: df.withColumn("result", summary(text)),
}


def apply_template(df: DataFrame, template: str, text_col: str = "text", name_col: str = "name") -> DataFrame:
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[template](df, text_col, name_col)


def join_files(df: DataFrame, group: str, order: str, name_col: str, text_col: str, separator: str = "\n\n<!-- ff-file-sep -->\n\n") -> DataFrame:
    """group, content: the files of a group in order, each under its name."""
    part = F.concat(F.lit("# "), F.col(name_col), F.lit("\n\n"), text_of(text_col))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return df.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["p"]), separator).alias("content"))
