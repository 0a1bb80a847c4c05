"""Sources and sinks: files, raw values, tables; size guard, category filters, cache, guarded output."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.detect import EXTENSIONS, suffix
from quillmill.schema import MAX_BYTES

# What a folder is searched for; categories of formats; what an output file may be called.
BATCH_EXTENSIONS = (
    "pdf docx doc pptx ppt xlsx xls xlsm csv tsv txt md markdown html htm json yaml yml xml toml rtf odt ods odp epub eml msg svg png jpg jpeg gif webp bmp tiff tif srt vtt tex sql"
).split()
CATEGORIES = {
    "document": "pdf docx odt rtf epub txt latex", "spreadsheet": "xlsx ods csv", "presentation": "pptx odp", "image": "png jpeg gif webp bmp tiff svg",
    "data": "json yaml xml toml sql html", "other": "eml msg zip 7z rar srt audio",
}
OUTPUT_EXTENSIONS = (".md", ".html", ".json", ".txt")
TEXT_MEMBERS = "txt md csv tsv json yaml yml xml html htm log ini cfg conf py js ts java c cpp h go rs sql sh toml tex srt vtt".split()


def files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, extensions: list[str] | None = None, most_bytes: int = MAX_BYTES) -> DataFrame:
    """path, name, mtime, length, content, error. Files that are too large keep their row with an error and no content:
    they come from a scan of their own that doesn't select the content, and the bound on the length is pushed into the
    other one, so their bytes are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    name, none = F.regexp_extract("path", r"[^/]*$", 0), F.lit(None).cast("struct<kind:string,message:string>")
    whole = found.where(F.col("length") <= most_bytes).select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), "length", "content", none.alias("error"))
    error = F.struct(F.lit("too_large").alias("kind"), F.concat(name, F.lit(": "), F.col("length").cast("string"), F.lit(" bytes")).alias("message"))
    large = found.where(F.col("length") > most_bytes).select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), "length", F.lit(None).cast("binary").alias("content"), error.alias("error"))
    df = whole.union(large)
    if extensions is not None:
        df = df.where(F.substring(suffix("name"), 2, 99).isin([e.lower().lstrip(".") for e in extensions]))
    return df


def batch_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """What a batch takes from a folder, in a fixed order."""
    return files(spark, path, recursive, extensions=BATCH_EXTENSIONS).orderBy("path")


def raw(spark: SparkSession, values: dict[str, str | bytes]) -> DataFrame:
    """Given values as source rows."""
    rows = [(f"raw:{k}", k, v.encode() if isinstance(v, str) else bytes(v)) for k, v in values.items()]
    df = spark.createDataFrame(rows, "path string, name string, content binary")
    return df.select("path", "name", F.lit(None).cast("timestamp").alias("mtime"), F.octet_length("content").cast("long").alias("length"), "content", F.lit(None).cast("struct<kind:string,message:string>").alias("error"))


def from_text(df: DataFrame, id_col: str, text_col: str, extension: str = "txt") -> DataFrame:
    """A table's text column as source rows."""
    name = F.concat(F.col(id_col).cast("string"), F.lit(f".{extension}"))
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    return df.select(F.concat(F.lit("table:"), name).alias("path"), name.alias("name"), F.lit(None).cast("timestamp").alias("mtime"), F.octet_length(body).cast("long").alias("length"), body.alias("content"), F.lit(None).cast("struct<kind:string,message:string>").alias("error"))


def category(fmt: str | Column) -> Column:
    f = F.col(fmt) if isinstance(fmt, str) else fmt
    out = F.when(F.lit(False), "")
    for name, formats in CATEGORIES.items():
        out = out.when(f.isin(formats.split()), name)
    return out.otherwise("other")


def capabilities(spark: SparkSession) -> DataFrame:
    """format, extensions, category, reads: what can be read here without further libraries."""
    from quillmill.sources.parsers import PARSERS

    rows = [(f, e.split(), f in PARSERS) for f, e in EXTENSIONS.items()]
    return spark.createDataFrame(rows, "format string, extensions array<string>, reads boolean").withColumn("category", category("format"))


def is_text_member(name: str | Column) -> Column:
    return F.substring(suffix(name), 2, 99).isin(TEXT_MEMBERS)


def check_output(path: str, roots: list[str]) -> str:
    """The normalised path, if it lies within a root and is called .md, .html, .json or .txt."""
    p = posixpath.normpath(path)
    if not any(p.startswith(posixpath.normpath(r).rstrip("/") + "/") for r in roots):
        raise ValueError("the output must lie within one of the allowed folders")
    if not p.lower().endswith(OUTPUT_EXTENSIONS):
        raise ValueError(f"the output must end in one of {', '.join(OUTPUT_EXTENSIONS)}")
    return p


def uncached(df: DataFrame, cache: DataFrame, now: int, key: str = "key") -> DataFrame:
    """Rows whose key has no unexpired entry (key, expires_at): what must be converted. An anti-join."""
    return df.join(cache.where(F.col("expires_at") > now).select(key), key, "left_anti")


def evict(cache: DataFrame, now: int, keep: int) -> DataFrame:
    """Entries that stay: unexpired, the `keep` used last. A plan with a limit, so no partition sorts all."""
    return cache.where(F.col("expires_at") > now).orderBy(F.desc("last_accessed"), "key").limit(keep)


def cache_stats(cache: DataFrame, now: int) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") <= now).alias("expired"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("chars"))
