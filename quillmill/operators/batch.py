"""Batches of files: unique output names, resuming, manifest, summary, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import col, path_hash, safe_message
from quillmill.schema import EXIT_CODES

RESERVED = "_batch_report"
# Conversion hint by extension. Hints that are no conversion type mean auto.
HINTS = {"json": "json", "csv": "table", "tsv": "table", "xlsx": "table", "xls": "table"}


def parts_of(path: str | Column) -> tuple[Column, Column, Column]:
    """Folder (with its slash), stem and extension (without the dot)."""
    p = col(path)
    name = F.regexp_extract(p, r"[^/]*$", 0)
    return F.substring(p, F.lit(1), F.length(p) - F.length(name)), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".\.([^.]*)$", 1)


def plan_outputs(files: DataFrame, ext: str, source_dir: str | None = None, salts: int = 2) -> DataFrame:
    """files (path) with out: mirrored under source_dir if it is given, else <stem><ext>; a colon, which Hadoop's paths
    can't hold, becomes an underscore. Names that differ only in
    case clash; clashing ones get the source's extension, and what still clashes gets 8 digits of a hash of the path,
    salted until the name is free. Counts of names are windows over the name, so each clash is settled where it meets;
    a window holds the paths of one name."""
    folder, stem, own = parts_of("path")
    base = F.concat(F.when(folder.startswith(source_dir.rstrip("/") + "/"), F.substring(folder, len(source_dir.rstrip("/")) + 2, 1 << 30)).otherwise("") if source_dir else F.lit(""), F.translate(stem, ":", "_"))
    d = files.withColumn("_base", base).withColumn("_own", own)
    alone = lambda c: F.count("*").over(Window.partitionBy(F.lower(c))) == 1
    d = d.withColumn("_p1", F.concat("_base", F.lit(ext)))
    d = d.withColumn("_ok1", alone("_p1") & (F.lower(F.regexp_extract("_base", r"[^/]*$", 0)) != RESERVED))
    d = d.withColumn("_p2", F.when(F.col("_ok1"), F.col("_p1")).otherwise(F.concat("_base", F.when(F.col("_own") != "", F.concat(F.lit("."), F.col("_own"))).otherwise(""), F.lit(ext))))
    d = d.withColumn("_ok", F.col("_ok1") | (alone("_p2") & (F.lower(F.regexp_extract("_p2", r"([^/]*)\.[^./]*$", 1)) != RESERVED)))
    d = d.withColumn("out", F.when(F.col("_ok"), F.col("_p2")))
    for salt in range(salts):
        named = F.concat(F.regexp_replace("_p2", r"\.[^./]*$", ""), F.lit("."), path_hash("path", salt), F.lit(ext))
        d = d.withColumn("_try", F.coalesce("out", named))
        free = (F.count("*").over(Window.partitionBy(F.lower("_try"))) == 1) | F.col("out").isNotNull()
        d = d.withColumn("out", F.when(free, F.col("_try")))
    rank = F.row_number().over(Window.partitionBy(F.lower("_try")).orderBy("path"))
    d = d.withColumn("out", F.coalesce("out", F.concat(F.regexp_replace("_try", r"\.[^./]*$", ""), F.lit("."), rank.cast("string"), F.lit(ext))))
    return d.select(*files.columns, "out")


def hint(path: str | Column) -> Column:
    """text, table or auto by extension."""
    ext = F.lower(parts_of(path)[2])
    return F.when(ext.isin([e for e, h in HINTS.items() if h == "table"]), "table").otherwise("auto")


def resume(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """targets (path, mtime, out) that must be done: those without a manifest row of the same output (case apart) whose
    file still has the size and digest noted (columns size, sha256 against now_size, now_sha256) and is as new as the
    source. An anti-join."""
    good = manifest.where((F.col("size") == F.col("now_size")) & (F.col("sha256") == F.col("now_sha256")))
    done = good.select(F.lower("out").alias("_out"), F.col("out_mtime").alias("_at"))
    return targets.join(done, (F.lower("out") == F.col("_out")) & (F.col("_at") >= F.col("mtime")), "left_anti")


def manifest(results: DataFrame, content: str = "content") -> DataFrame:
    """path, out, size, sha256 of what was written."""
    body = F.encode(F.col(content), "utf-8")
    return results.where(F.col("status") == "ok").select("path", "out", F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"))


def summary(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed, skipped, mean confidence of the ok ones (3 places), balanced (each file counted once)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count("*").alias("total"), n("ok").alias("ok"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.round(F.avg(F.when(F.col("status") == "ok", F.col("confidence"))), 3).alias("avg_confidence"), (n("ok") + n("failed") + n("skipped") == F.count("*")).alias("balanced"),
    )


def exit_code(kind: str | Column) -> Column:
    k = F.coalesce(col(kind), F.lit("internal"))
    codes = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, k), F.lit(EXIT_CODES["internal"]))


def envelope(data: Column, error_kind: str | Column, error_message: str | Column) -> Column:
    """The protocol's line: {ok, code, data} or {ok, code, error}."""
    bad = col(error_kind).isNotNull()
    failed = F.to_json(F.struct(F.lit(False).alias("ok"), (4000 + exit_code(error_kind)).alias("code"), F.struct(col(error_kind).alias("kind"), safe_message(error_message).alias("message")).alias("error")))
    return F.when(bad, failed).otherwise(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(0).alias("code"), data.alias("data"))))
