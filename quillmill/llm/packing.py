"""Conflict-constrained best-fit packing of documents into fixed-size training windows.

Each document has a length in tokens (words and one end). Longer ones than a window are cut into whole windows and a
rest; nothing is dropped. Pieces are dealt by hash over shards of about shard_rows rows each, and every shard packs
its own bins, longest pieces first. A bin carries its residual, a bitmap of sources and a bitmap of duplicate clusters.
Bins are ordered by residual; for a piece the search starts at the successor of its length (the smallest residual that
holds it) and goes on to the next until it comes to the tightest bin whose bitmaps have neither the piece's source nor
its cluster; only where none is left a new bin opens.

Both bitmaps are strict: no bin ever holds two pieces of one source, or two members of one cluster. Where one source
holds a large share of all rows, its bins hold few other pieces and stay unfilled; that is what the constraint asks for
(bin_tokens shows it). For a source of many pieces the shard also keeps, for each residual, how many bins lack it, so
the search goes straight to the next residual that has a bin for it.

Shards are dealt by a hash of the row, so no source and no cluster meets in one task; their number follows the number
of rows. Null texts and lengths count as one token (the end); null sources and clusters conflict with nothing;
repeated rows are packed each, with clusters keeping them apart; ties in length go by a hash of the row. Only the
named columns are read, so others, whatever their names, don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import durable, table

PACKED = "doc_id long, piece int, start long, n_tokens int, shard int, bin int, place int, bin_tokens int"


class Bins:
    """Residual-ordered bins. level[r] has the bins of residual r, grouped by their bitmaps; filled has bit r set where
    level[r] has bins, so the successor of a residual is one shift and one lowest bit. For the sources in heavy, lack
    counts the bins of each residual that don't hold them, and open has bit r set where there are any."""

    def __init__(self, capacity: int, heavy: tuple[int, ...] = ()):
        self.capacity, self.filled = capacity, 0
        self.level: list[dict] = [{} for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self.lack = {m: [0] * (capacity + 1) for m in heavy}
        self.open = dict.fromkeys(heavy, 0)

    def count(self, r: int, sources: int, by: int) -> None:
        for m, lack in self.lack.items():
            if not m & sources:
                lack[r] += by
                if lack[r] == (by > 0):  # the first one came, or the last one went
                    self.open[m] ^= 1 << r

    def put(self, r: int, sources: int, clusters: int, b: int) -> None:
        self.level[r].setdefault((sources, clusters), []).append(b)
        self.filled |= 1 << r
        self.count(r, sources, 1)

    def add(self, item: int, size: int, source: int, cluster: int) -> int:
        rest = self.open.get(source, self.filled) >> size << size
        while rest:
            r = (rest & -rest).bit_length() - 1
            level = self.level[r]
            for key, held in level.items():
                if not key[0] & source and not key[1] & cluster:
                    b = held.pop()
                    if not held:
                        del level[key]
                        if not level:
                            self.filled ^= 1 << r
                    self.count(r, key[0], -1)
                    self.bins[b].append(item)
                    self.left[b] = r - size
                    if r > size:  # a full bin takes nothing more
                        self.put(r - size, key[0] | source, key[1] | cluster, b)
                    return b
            rest &= rest - 1
        b = len(self.bins)
        self.bins.append([item])
        self.left.append(self.capacity - size)
        if self.capacity > size:
            self.put(self.capacity - size, source, cluster, b)
        return b


def pack_shard(rows: pd.DataFrame, capacity: int, heavy: int = 64) -> tuple[list[int], list[int], list[int]]:
    """The bin, the place in it and the bin's tokens of each row (columns size, source, cluster, tie), whose order they
    follow. Sources of at least `heavy` pieces get counts of their own, which changes the time alone."""
    order = rows.sort_values(["size", "tie", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").index
    sizes, copies, held = rows["size"].to_dict(), rows["cluster"].value_counts(), rows["source"].value_counts()
    own = {c: i for i, c in enumerate(copies.index[copies > 1])}  # a cluster of one member needs no bit
    slot = {s: i for i, s in enumerate(held.index)}
    bins = Bins(capacity, tuple(1 << slot[s] for s in held.index[held >= heavy]))
    source, cluster = rows["source"].to_dict(), rows["cluster"].to_dict()
    for i in order:
        s, c = source[i], cluster[i]
        bins.add(i, sizes[i], 0 if pd.isna(s) else 1 << slot[s], 1 << own[c] if not pd.isna(c) and c in own else 0)
    at = {i: (b, k, capacity - bins.left[b]) for b, items in enumerate(bins.bins) for k, i in enumerate(items)}
    return tuple(list(x) for x in zip(*(at[i] for i in rows.index), strict=True))


def n_words(col: str):
    return F.size(F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def pack(
    docs: DataFrame, capacity: int = 2048, shard_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, length_col: str | None = None
) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, shard, bin, place, bin_tokens): where each piece of each document lies.
    cluster_col names duplicate clusters; without one, equal texts are a cluster. length_col names token counts."""
    tokens = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(1).cast("long")) if length_col else (n_words(text_col) + 1).cast("long")
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(text_col)
    cluster = F.when(F.col(cluster_col or text_col).isNotNull(), cluster)
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("tokens"), source.alias("source"), cluster.alias("cluster"), F.xxhash64(id_col, text_col, source).alias("tie"))
    items = durable(items, "lengths")
    n = items.agg(F.sum(F.ceil(F.col("tokens") / capacity))).first()[0] or 0
    shards = max(1, round(n / shard_rows))
    piece = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("tokens") / capacity) - 1).cast("int")))
    items = items.select("doc_id", "tokens", "source", "cluster", "tie", piece.alias("piece"))
    start = F.col("piece").cast("long") * capacity
    items = items.select("doc_id", "source", "cluster", "tie", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).cast("int").alias("size"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("tie", "piece", "doc_id"), F.lit(shards)).cast("int"))

    def run(rows):
        rows = rows.reset_index(drop=True)
        b, place, used = pack_shard(rows, capacity)
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "n_tokens": rows["size"], "shard": rows["shard"], "bin": b, "place": place, "bin_tokens": used})

    return items.groupBy("shard").applyInPandas(run, PACKED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
