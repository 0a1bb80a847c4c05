"""The whole way of a document: source rows to converted, rated, enveloped results. One Arrow pass (parsing); all else
are expressions on its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.quality import enhance_reason, report
from quillmill.functions.text import format_output, new_id
from quillmill.operators.batch import envelope
from quillmill.operators.convert import convert, decision, fallback, features
from quillmill.sources.parsers import parse


def translate(sources: DataFrame, conversion_type: str = "auto", output: str = "text", quality: bool = True, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """path, name, format, file_type, strategy, content, confidence, enhance_reason, quality, error, line (the
    protocol's JSON), and the columns of sources to carry along."""
    p = parse(sources, carry, **options)
    raw = F.decode(F.make_valid_utf8(F.col("content")).cast("binary"), "utf-8") if "content" in p.columns else F.lit("")
    none = F.col("pages").isNull()
    p = p.withColumn("_c", F.when(~none, convert("file_type", F.col("pages"), "name", conversion_type)))
    p = p.withColumn("_c", fallback(F.col("pages"), raw, F.lit(True), F.col("_c")))
    p = p.withColumn("strategy", F.col("_c.strategy")).withColumn("confidence", F.col("_c.confidence"))
    p = p.withColumn("content", format_output(F.col("_c.content"), output))
    p = p.withColumn("decision", decision("format", features(F.col("pages"))["has_image"]))
    p = p.withColumn("enhance_reason", enhance_reason(F.col("pages"), "confidence"))
    if quality:
        p = p.withColumn("quality", report(F.col("_c.content"), "length", "file_type", F.coalesce(features(F.col("pages"))["has_table"], F.lit(False))))
    p = p.withColumn("result_id", new_id("cvt"))
    data = F.struct("result_id", "name", "format", "strategy", "confidence", "content", "enhance_reason")
    p = p.withColumn("line", envelope(data, F.col("error.kind"), F.col("error.message")))
    return p.select("path", "name", "format", "file_type", "length", "mtime", "strategy", "content", "confidence", "decision", "enhance_reason", *(["quality"] if quality else []), "error", "result_id", "line", *carry)


def to_index(results: DataFrame, now: int) -> DataFrame:
    """Results as rows of the artifact index."""
    from quillmill.operators.index import EXCERPT, SCHEMA

    known = {
        "id": F.col("result_id"), "source_name": F.col("name"), "source_path": F.col("path"), "source_size": F.col("length"), "sha256": F.sha2("content", 256), "format": F.col("format"), "parser": F.col("strategy"),
        "file_type": F.col("file_type"), "confidence": F.col("confidence"), "enhance_reason": F.col("enhance_reason"), "quality_json": F.to_json("quality") if "quality" in results.columns else F.lit(None),
        "chars": F.length("content").cast("long"), "status": F.when(F.col("error").isNull(), "completed").otherwise("failed"), "error_kind": F.col("error.kind"), "error_message": F.col("error.message"),
        "starred": F.lit(False), "excerpt": F.substring("content", 1, EXCERPT), "created_at": F.lit(now), "updated_at": F.lit(now),
    }
    fields = [x.rsplit(" ", 1) for x in SCHEMA.split(", ")]
    return results.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
