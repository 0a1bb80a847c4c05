"""Parsers: bytes of one file to pages of typed elements, run in Arrow batches.

A parser takes (content, options) and gives a list of pages (dictionaries in the shape of schema.PAGE); whatever it
raises becomes the row's error, never the task's. Formats without a parser here are `unsupported_format`."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.detect import detect, told
from quillmill.schema import ERROR, FILE_TYPE, PAGE
from quillmill.sources.parsers import binary, packages, texts

Parser = Callable[[bytes, dict], list[dict]]

PARSERS: dict[str, Parser] = {
    "txt": texts.plain, "markdown": texts.markdown, "csv": texts.csv_table, "json": texts.json_data, "yaml": texts.yaml_data, "xml": texts.xml_data, "toml": texts.toml_data, "html": texts.html_page,
    "sql": texts.sql_dump, "srt": texts.subtitles, "latex": texts.latex, "eml": texts.mail, "rtf": texts.rtf,
    "docx": packages.docx, "xlsx": packages.xlsx, "pptx": packages.pptx, "odt": packages.odt, "ods": packages.ods, "odp": packages.odp, "epub": packages.epub, "zip": packages.archive, "svg": packages.svg,
    "png": binary.image, "jpeg": binary.image, "gif": binary.image, "bmp": binary.image, "webp": binary.image, "tiff": binary.image, "audio": binary.audio,
}
PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("pages", T.ArrayType(PAGE)), T.StructField("error", ERROR)])


def register(fmt: str, parser: Parser) -> None:
    """A parser for a further format, or another one for a known format."""
    PARSERS[fmt] = parser


def parse_one(content: bytes | None, fmt: str, name: str, options: dict, parsers: dict[str, Parser] | None = None) -> tuple[list[dict] | None, dict | None]:
    known = parsers if parsers is not None else PARSERS
    kind = "markdown" if fmt == "txt" and name.lower().endswith((".md", ".markdown")) else fmt
    if kind not in known:
        return None, {"kind": "unsupported_format", "message": f"no parser for {fmt}"}
    try:
        pages = known[kind](bytes(content or b""), {"name": name, **options})
    except RecursionError:
        return None, {"kind": "parse_failed", "message": "nested too deeply"}
    except Exception as e:  # noqa: BLE001  one bad file is a row with an error
        return None, {"kind": "parse_failed", "message": f"{type(e).__name__}: {e}"[:400]}
    for p in pages:
        p["meta"] = json.dumps(p.get("meta") or {}, ensure_ascii=False, default=str)
        for e in p["elements"]:
            e["meta"] = json.dumps(e.get("meta") or {}, ensure_ascii=False, default=str)
    return pages, None


def parse(sources: DataFrame, carry: tuple[str, ...] = (), fmt: str | None = None, **options) -> DataFrame:
    """sources (path, name, mtime, length, content, error) with format, mime, confidence, file_type, pages and error, and
    the columns to carry along.
    Detection is an expression; parsing is one Arrow pass over the rows, without a shuffle. Where the format is known
    beforehand (fmt), as for the texts of a column, nothing is detected: a text may be empty, or begin like a picture."""
    known = dict(PARSERS)
    found = sources.withColumn("_d", told(fmt, 1.0) if fmt else detect("content", "name"))
    types = F.create_map(*(F.lit(x) for pair in FILE_TYPE.items() for x in pair))
    found = found.select("path", "name", "mtime", "length", "content", F.col("error").alias("_error"), F.col("_d.format").alias("format"), F.col("_d.mime").alias("mime"), F.col("_d.confidence").alias("confidence"), *carry)
    found = found.withColumn("file_type", F.coalesce(F.try_element_at(types, F.col("format")), F.lit("unknown")))
    keep = [c for c in found.columns if c not in ("content", "_error")]
    schema = T.StructType([found.schema[c] for c in keep] + [T.StructField("pages", T.ArrayType(PAGE)), T.StructField("error", ERROR)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = b.to_pylist()
            pages, errors = [], []
            for r in rows:
                p, e = (None, r["_error"]) if r["_error"] else parse_one(r["content"], r["format"], r["name"] or "", options, known)
                pages.append(p)
                errors.append(e)
            columns = [b.column(b.schema.get_field_index(c)).cast(arrow.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pages, arrow.field("pages").type), pa.array(errors, arrow.field("error").type)], schema=arrow)

    return found.mapInArrow(run, schema)


def elements(parsed: DataFrame) -> DataFrame:
    """One row for each element: path, page_number, ord, element_id, element_type, content, meta."""
    pages = parsed.select("path", F.explode("pages").alias("p"))
    return pages.select("path", "p.page_number", F.posexplode("p.elements").alias("ord", "e")).select("path", "page_number", "ord", "e.*")


def raw_pages(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("pages").alias("p")).select("path", "p.page_number", "p.raw_text", "p.has_image", "p.has_table", "p.meta")
