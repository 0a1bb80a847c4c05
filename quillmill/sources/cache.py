"""The content cache: results by what they were made of, on the same segments as the index.

A key is a hash of the bytes and of all that shapes the result. cached() looks the keys of its sources up in the buckets
that hold them, converts each missing key once however many sources share it, and commits. Data is written once, straight
from the conversion, into segments that are added to its buckets. What changes with each use (times, the number of uses)
is a narrow table beside it: the buckets touched are rewritten with the new entries, and with the time of use and the
number of uses of those that were hit; entries that have expired go, and a bucket keeps the `keep` / `buckets` entries
used last (keys are spread evenly, so about `keep` in all). Data that no entry names any more goes when a bucket of more
than most_segments segments is folded into one. A second run over the same sources converts nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import cache_key
from quillmill.operators.index import bucket_of
from quillmill.sources.segments import Segments
from quillmill.sources.tables import checkpointed

USES = "key string, made long, created_at long, expires_at long, last_accessed long, access_count long"
DATA = "key string, made long, data string"
ROWS_A_TASK = 4096


class ContentCache:
    def __init__(self, spark: SparkSession, path: str, ttl: int = 3600, keep: int = 1_000_000, buckets: int = 16, most_segments: int = 8):
        self.files, self.ttl, self.keep, self.most_segments = Segments(spark, path), ttl, keep, most_segments
        self._new = {"generation": 0, "buckets": buckets, "rows": {}, "data": {}}

    def _uses(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        return self.files.read([s for b, s in sorted(m["rows"].items()) if buckets is None or int(b) in buckets], USES)

    def _data(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """key, made (the generation that made it) and data, also of entries that are no more."""
        return self.files.read([s for b, of in sorted(m["data"].items()) if buckets is None or int(b) in buckets for s in of], DATA)

    def entries(self) -> DataFrame:
        m = self.files.manifest() or self._new
        return self._uses(m).join(self._data(m), ["key", "made"]).select("key", "data", "created_at", "expires_at", "last_accessed", "access_count")

    def _folded(self, m: dict, rows: dict[str, str], data: dict[str, list[str]], most: int, among: list[int]) -> dict[str, list[str]]:
        """data with one segment in place of more than `most` in the buckets `among`, without what no entry of rows names."""
        full = {b: s for b, s in data.items() if len(s) > most and int(b) in among}
        if not full:
            return data
        named = self._uses({"rows": {b: s for b, s in rows.items() if b in full}}).select("key", "made")
        held = self._data({"data": full}).join(named, ["key", "made"], "left_semi").withColumn("bucket", bucket_of("key", m["buckets"]))
        made = self.files.write(held, "bucket", "data")
        return {b: s for b, s in data.items() if b not in full} | {b: [s] for b, s in made.items()}

    def cached(self, sources: DataFrame, convert: Callable[[DataFrame], DataFrame], now: int, content: str = "content", kind: str = "auto", output: str = "text", prompt: str | None = None, refresh: bool = False) -> DataFrame:
        """sources with data and hit. convert takes rows of sources, one for each key that is missing, with the column
        key, and gives key and data; a null data is a failure and isn't kept. refresh takes nothing from the cache. What
        is returned reads the cache's files when it is used; sweep() must not come before."""
        m = self.files.manifest() or self._new
        keyed = checkpointed(sources.withColumn("key", cache_key(content, F.lit(kind), F.lit(output), F.lit(prompt))), "keyed")
        touched = [r[0] for r in keyed.select(bucket_of("key", m["buckets"]).alias("b")).distinct().collect()]  # a number for each bucket at most
        held = self._uses(m, touched).where(F.col("expires_at") > now)
        uses = keyed.groupBy("key").agg(F.count("*").alias("uses"))
        known = held.limit(0) if refresh else held
        lacking = uses.join(known, "key", "left_anti").select("key")
        one = Window.partitionBy("key").orderBy(F.lit(0))
        tasks = max(1, -(-keyed.count() // ROWS_A_TASK))
        first = keyed.repartition(tasks, "key").join(lacking, "key", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        at = m["generation"] + 1
        made = convert(first).select("key", F.lit(at).cast("long").alias("made"), F.col("data").cast("string").alias("data")).where(F.col("data").isNotNull())
        added = self.files.write(made.withColumn("bucket", bucket_of("key", m["buckets"])), "bucket", "data", together=False)
        made = self.files.read([s for _, s in sorted(added.items())], DATA)
        fresh = made.select("key", "made").join(uses, "key").select("key", "made", F.lit(now).cast("long").alias("created_at"), F.lit(now + self.ttl).cast("long").alias("expires_at"), F.lit(now).cast("long").alias("last_accessed"), F.col("uses").alias("access_count"))
        again = held.join(made.select("key"), "key", "left_anti").join(uses, "key", "left")
        hit = F.col("uses").isNotNull() & F.lit(not refresh)
        again = again.select("key", "made", "created_at", "expires_at", F.when(hit, F.lit(now)).otherwise(F.col("last_accessed")).cast("long").alias("last_accessed"), (F.col("access_count") + F.when(hit, F.col("uses")).otherwise(F.lit(0))).alias("access_count"))
        merged = again.union(fresh).withColumn("bucket", bucket_of("key", m["buckets"]))
        last = Window.partitionBy("bucket").orderBy(F.desc("last_accessed"), "key")
        merged = merged.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= max(1, -(-self.keep // m["buckets"]))).drop("_n")
        rows = self.files.write(merged, "bucket", "uses")
        told = made.select("key", "data", F.lit(False).alias("hit")).union(known.select("key", "made").join(self._data(m, touched), ["key", "made"]).select("key", "data", F.lit(True)))
        out = keyed.join(told, "key", "left")
        # a bucket whose entries have all gone has no segment any more
        kept = {b: s for b, s in m["rows"].items() if int(b) not in touched} | rows
        data = m["data"] | {b: [*m["data"].get(b, []), s] for b, s in added.items()}
        data = self._folded(m, kept, data, self.most_segments, touched)
        self.files.commit(dict(m, generation=at, kind="cache", at=now, touched=sorted(touched), rows=kept, data=data))
        return out.select(*sources.columns, "key", "data", F.coalesce("hit", F.lit(False)).alias("hit"))

    def purge(self, now: int) -> None:
        """Rewrites the buckets that hold expired entries, without them and their data."""
        m = self.files.manifest() or self._new
        stale = [r[0] for r in self._uses(m).where(F.col("expires_at") <= now).select(bucket_of("key", m["buckets"]).alias("b")).distinct().collect()]
        if stale:
            rows = self.files.write(self._uses(m, stale).where(F.col("expires_at") > now).withColumn("bucket", bucket_of("key", m["buckets"])), "bucket", "uses")
            kept = {b: s for b, s in m["rows"].items() if int(b) not in stale} | rows
            self.files.commit(dict(m, generation=m["generation"] + 1, kind="purge", at=now, touched=sorted(stale), rows=kept, data=self._folded(m, kept, m["data"], 0, stale)))

    def sweep(self, keep: int = 1) -> None:
        self.files.sweep(keep, lambda m: [*m["rows"].values(), *(s for of in m["data"].values() for s in of)])


def text_key(text: str | Column, kind: str = "auto", output: str = "text") -> Column:
    return cache_key(text, F.lit(kind), F.lit(output), F.lit(None))
