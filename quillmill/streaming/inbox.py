"""The inbox as Structured Streaming: stable files, each version once, indexed in micro-batches; retention; changes.

Spark's file source remembers paths, so a file that is rewritten in place would be missed. Listings are streamed
instead: a stateful operator keyed by path keeps the last seen signature (size and time of change) and what was done,
and lets a version through once two samples agree on it. What it lets through is read and converted in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "path string, size long, mtime long, sampled_at long, forget boolean"
STABLE = "path string, size long, mtime long, sampled_at long"
STATE = "size long, mtime long, done_mtime long"


def listing(spark: SparkSession, path: str, at: int) -> DataFrame:
    """One sample of a folder: what a lister writes, a few times a minute, into the folder that listings() streams."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.lit(at).cast("long").alias("sampled_at"), F.lit(False).alias("forget"))


def listings(spark: SparkSession, path: str, per_trigger: int = 20) -> DataFrame:
    """Samples as a stream."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    size, mtime, done = state.get if state.exists else (-1, -1, -1)
    out = []
    rows = pd.concat(list(batches)).sort_values("sampled_at")
    for r in rows.itertuples(index=False):
        if r.forget:
            done = -1
            continue
        if (r.size, r.mtime) == (size, mtime) and mtime != done:
            done = mtime
            out.append((key[0], int(r.size), int(r.mtime), int(r.sampled_at)))
        size, mtime = int(r.size), int(r.mtime)
    state.update((size, mtime, done))
    yield pd.DataFrame(out, columns=["path", "size", "mtime", "sampled_at"])


def stable(samples: DataFrame) -> DataFrame:
    """Versions of files that two samples in a row agree on, each once; a row with forget lets the version of its path
    through again (a retry). State is one row for each path."""
    return samples.groupBy("path").applyInPandasWithState(_settle, STABLE, STATE, "append", GroupStateTimeout.NoTimeout)


def seed_done(spark: SparkSession, indexed: DataFrame, at: int) -> DataFrame:
    """Two agreeing samples of what is indexed already, for the first batch of a new checkpoint: those versions settle
    there and their output is left out by the index's own upsert."""
    rows = indexed.select("path", "size", "mtime", F.lit(at).cast("long").alias("sampled_at"), F.lit(False).alias("forget"))
    return rows.union(rows.withColumn("sampled_at", F.col("sampled_at") + 1))


def run_inbox(samples: DataFrame, convert: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Converts stable versions batch by batch. The checkpoint has the state, so a restart goes on where it stopped;
    write must accept the same batch again (an upsert by id does)."""
    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        write(convert(rows), number)

    writer = stable(samples).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def load_versions(versions: DataFrame) -> DataFrame:
    """path, name, content of a small batch of stable versions, read by the executors."""
    spark = versions.sparkSession
    paths = [r[0] for r in versions.select("path").distinct().collect()]  # bounded by maxFilesPerTrigger
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.col("modificationTime").alias("mtime"), "length", "content", F.lit(None).cast("struct<kind:string,message:string>").alias("error"))


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and time window, with a watermark where events are a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def changes(index: DataFrame) -> DataFrame:
    """count and newest of live rows: what a change feed compares between two looks."""
    return index.where(F.col("deleted_at").isNull()).agg(F.count("*").alias("count"), F.max("updated_at").alias("newest"))
