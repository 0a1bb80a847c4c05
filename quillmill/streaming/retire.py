"""Retention of a folder with a log: what goes is written down before it goes.

The choice is the index's retention() over the listing (too old, then the oldest beyond the size). Executors read the first
HEAD bytes of each file that is to go, by a ranged read, and hash them; those rows are appended to the log (a Parquet
table beside the files, committed by Spark's writer); only then are the files deleted, by executors again. A run that is
lost in between has logged files that are still there: the next run logs them once more and deletes them, so entries() takes
one row of each version."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.index import retention
from quillmill.sources.sink import opened
from quillmill.sources.tables import checkpointed

HEAD = 65_536  # fixed value: bytes of a file that are hashed
LOG = "path string, name string, size long, mtime long, reason string, sha256 string, hash_note string, retired_at long"


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and mtime (seconds) of the files of a folder, but for hidden ones and the log's."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.where(~F.regexp_extract("path", "[^/]*$", 0).startswith("."))


def heads(doomed: DataFrame) -> DataFrame:
    """doomed (path, size, mtime, reason) with the hash of each file's head; a file that is gone gives no row."""
    schema = LOG.rsplit(", ", 1)[0]
    arrow = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in schema.split(", ")])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    files, at = opened(r["path"])
                    with files.open_input_file(at) as f:
                        head, size = f.read(HEAD), f.size()
                except OSError:
                    continue
                out.append(r | {"name": r["path"].rsplit("/", 1)[-1], "sha256": hashlib.sha256(head).hexdigest(), "hash_note": "first 64KB only" if len(head) < size else "full content"})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return doomed.select("path", "size", "mtime", "reason").mapInArrow(run, schema)


def deleted(paths: DataFrame) -> DataFrame:
    """path and gone for each file, after it has been deleted (a file that was gone before counts too)."""

    def run(batches):
        for batch in batches:
            gone = []
            for path in batch.column(0).to_pylist():
                files, at = opened(path)
                try:
                    files.delete_file(at)
                    gone.append(True)
                except FileNotFoundError:
                    gone.append(True)
                except OSError:
                    gone.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.bool_())], names=["path", "gone"])

    return paths.select("path").mapInArrow(run, "path string, gone boolean")


def retire(spark: SparkSession, folder: str, log: str, now: int, days: int = 7, most_bytes: int = 500 << 20) -> DataFrame:
    """Retires a folder's files; gives the rows that were logged, with gone."""
    files = checkpointed(folder_listing(spark, folder), "listing")
    rows = files.select(F.col("path").alias("id"), F.col("size").alias("source_size"), F.col("mtime").alias("created_at"), F.lit(None).cast("long").alias("deleted_at"), F.lit(None).cast("long").alias("retired_at"))
    doomed = files.join(retention(rows, now, days, most_bytes).select(F.col("id").alias("path"), "reason"), "path")
    entries_now = checkpointed(heads(doomed).withColumn("retired_at", F.lit(now).cast("long")), "retired")
    entries_now.write.mode("append").parquet(log)
    return entries_now.join(checkpointed(deleted(entries_now), "deleted"), "path")


def entries(spark: SparkSession, log: str) -> DataFrame:
    """The log, one row for each version of a file, the last one written."""
    every = spark.read.schema(LOG).parquet(log)
    return every.groupBy("path", "mtime").agg(F.max_by(F.struct("name", "size", "reason", "sha256", "hash_note", "retired_at"), "retired_at").alias("r")).select("path", "mtime", "r.*")
