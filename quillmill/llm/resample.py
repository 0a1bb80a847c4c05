"""Importance resampling towards a target distribution, over a persisted sparse document-by-bucket matrix.

Features are runs of consecutive words (sizes `grams`), hashed into buckets. One pass over the texts writes the matrix of
feature counts as CSR blocks: each row of the block table holds some documents' ids, their row pointers, and the columns
and counts of their cells. Everything after that reads blocks and no text: column sums give the corpus' distribution
(the target's come from a matrix of its own), logarithms of their ratio are the buckets' gains, and the product of the
matrix with the vector of gains gives the documents' weights. Documents are then drawn without replacement by weight
plus Gumbel noise, a fixed function of the id.

Sizes: a block holds about `block_cells` cells or one document; a task adds up one vector of `buckets` sums, so what is
shuffled or sent to the driver is bounded by tasks and buckets, not by documents; a task holds TEXTS texts or
BLOCKS_AT_ONCE blocks at once, however much it reads; gains are one vector of `buckets`
whole numbers. Ranks come from a histogram of scores, which are whole numbers within the gains' range plus the noise's
(the noise lies in -3,131..22,181): each score's first rank is the number of rows above it, and ties are ranked within
one score, so no task sorts all documents. Noise depends on the id, so copies of one text spread over scores.

Words are runs of characters other than U+0000 to U+002F, U+003A to U+0060 and U+007B to U+007F, after A-Z are lowered.
A null or empty text has no features and a weight of 0. Texts are counted whole, whatever their length. Rows repeated
with one id are counted and drawn each, at the same score. Rows with a null id count in all sums; they have a weight but
no score, and take no part in the draw or its number. An empty table gives an empty one; an empty target gives gains as
if each bucket held one feature. Only the id and the text are read, so other columns, whatever their names, don't
matter.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import batches_of, durable, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lowered UTF-8: bytes of other characters are never in a word
BLOCKS = "ids array<long>, n_features array<long>, n_words array<long>, starts array<int>, buckets array<int>, counts array<int>"
TEXTS, BLOCKS_AT_ONCE = 256, 8  # that a task holds at once, beside what it writes
# A block is a row, so a writer that looks at its size every 100 rows would hold 100 blocks.
WRITTEN = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}
REMEMBERED = 200_000  # features whose bucket a task remembers, to save hashing


def matrix(docs: DataFrame, buckets: int = 10_000, grams: tuple[int, int] = (1, 1), id_col: str = "doc_id", text_col: str = "text", block_cells: int = 200_000) -> DataFrame:
    """The documents' CSR blocks, as a durable table. Row r of a block has the cells starts[r]..starts[r + 1]."""

    def run(batches):
        bucket_of: dict[bytes, int] = {}
        schema = pa.schema([(f.split()[0], pa.list_(pa.int64() if "long" in f else pa.int32())) for f in BLOCKS.split(", ")])
        ids, sizes, words_held, starts, cells, counts = [], [], [], [0], [], []

        def block():
            columns = (ids, sizes, words_held, starts, np.concatenate(cells) if cells else [], np.concatenate(counts) if counts else [])
            out = pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for c in (ids, sizes, words_held, starts, cells, counts):
                c.clear()
            starts.append(0)
            return out

        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                words = WORD.findall(text.as_py().lower()) if text.is_valid else []
                found = []
                for n in range(grams[0], grams[1] + 1):
                    runs = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
                    for w in runs:
                        b = bucket_of.get(w)
                        if b is None:
                            if len(bucket_of) >= REMEMBERED:
                                bucket_of.clear()
                            b = bucket_of[w] = zlib.crc32(w) % buckets
                        found.append(b)
                columns, times = np.unique(np.array(found, np.int32), return_counts=True)
                ids.append(ident.as_py())
                sizes.append(len(found))
                words_held.append(len(words))
                starts.append(starts[-1] + len(columns))
                cells.append(columns)
                counts.append(times.astype(np.int32))
                if starts[-1] >= block_cells:
                    yield block()
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    with batches_of(docs.sparkSession, TEXTS):
        return durable(rows.mapInArrow(run, BLOCKS), "matrix", **WRITTEN)


def flat(batch: pa.RecordBatch, row: int, column: str) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: each task adds its blocks into one vector, and vectors are added by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                np.add.at(total, flat(batch, r, "buckets"), flat(batch, r, "counts"))
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed distributions, for each bucket. Both tables have a row for each
    bucket at most, so the driver's share is bounded by `buckets`."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for sums, into in ((corpus, s), (target, t)):
        for r in sums.collect():
            into[r["bucket"]] = r["n"]
    held, wanted = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (held + buckets)) / float((a + 1) * (wanted + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_features, n_words, weight: the matrix times the vector of gains, divided by the rows' features (floored)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                starts, sizes = flat(batch, r, "starts"), flat(batch, r, "n_features")
                upto = np.concatenate(([0], np.cumsum(gain[flat(batch, r, "buckets")] * flat(batch, r, "counts"))))
                product = upto[starts[1:]] - upto[starts[:-1]]
                weight = np.where(sizes > 0, product // np.maximum(sizes, 1), 0)
                columns = [batch.column("ids")[r].values, pa.array(sizes, pa.int64()), batch.column("n_words")[r].values, pa.array(weight, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_features", "n_words", "weight"])

    return blocks.mapInArrow(run, "id long, n_features long, n_words long, weight long")


def noise(ident: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variable), a function of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.when(ident.isNotNull(), F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))))


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3, ... for the highest scores among eligible rows (ties: smaller ids first), floor(percent
    of them / 100) in all; null elsewhere."""
    may = F.coalesce(eligible & F.col("score").isNotNull(), F.lit(False))
    steps = sorted(((r["score"], r["n"]) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota, above, first = percent * sum(n for _, n in steps) // 100, 0, []
    for score, n in steps:
        if above >= quota:
            break
        first.append((score, above))
        above += n
    spark = scored.sparkSession
    cut = F.lit(first[-1][0]) if first else F.lit(None).cast("long")
    near = F.coalesce(may & (F.col("score") >= cut), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy("id")) + F.col("above")
    drawn = scored.where(near).join(F.broadcast(spark.createDataFrame(first, "score long, above long")), "score")  # a row for each score at most: bounded by the scores' range
    drawn = drawn.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.select(*scored.columns, "rank").union(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, grams: tuple[int, int] = (1, 1), least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """id, n_features, weight, score, rank for each document; rows with a rank are the sample."""
    blocks = matrix(docs, buckets, grams, id_col, text_col)
    aim = matrix(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), buckets, grams, "id", "text")
    with batches_of(docs.sparkSession, BLOCKS_AT_ONCE):
        gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets), buckets)
        scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
        scored = durable(scored, "scored")
    return draw(scored, F.col("n_words") >= least_words, percent).select("id", "n_features", "weight", "score", "rank")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


CRC32 = (  # of the UTF-8 bytes of w; the table of the 256 remainders is computed by its rule
    "tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)), "
    "bytes AS (SELECT w, list_transform(range(1, length(x) + 1, 2), lambda k: 16 * (instr('0123456789ABCDEF', x[k]) - 1) + instr('0123456789ABCDEF', x[k + 1]) - 1) AS b FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words))), "
    "crc AS (SELECT w, xor(4294967295, list_reduce(b, lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket FROM bytes, tab), "
)
ORACLE = (
    r"WITH texts AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark), "
    r"words AS (SELECT doc_id, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts), "
    + CRC32
    + "cells AS (SELECT doc_id, side, bucket, count(*)::BIGINT AS n FROM words JOIN crc USING (w) GROUP BY 1, 2, 3), "
    "sums AS (SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) b(bucket) LEFT JOIN cells USING (bucket) GROUP BY 1), "
    "gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums), "
    "w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM cells JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1), "
    "x AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda k: instr('0123456789abcdef', sha256('2024:' || d.doc_id)[k]) - 1), lambda c, k: 16 * c + k) AS h FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id), "
    "y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x), "
    "z AS (SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * (SELECT count(*) FROM z WHERE may) // 100 THEN place END AS rank FROM z"
)
