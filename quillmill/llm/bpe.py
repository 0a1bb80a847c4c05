"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to chunk_chars are one chunk. Longer ones are cut into chunks that overlap; the chunks are rows of their own,
dealt over all tasks and pre-tokenised in parallel. A match of the pattern depends on no earlier character, so where a
boundary of one chunk is also a boundary of the chunk before, both go on alike: there they are stitched. Where an
overlap holds no common boundary (one piece longer than the overlap), matching goes on over the joined text until the
boundaries meet again. The pieces are then merged by rank; decoding concatenates the bytes of the ids.

Null and empty texts: no ids. Repeated rows give repeated results; a null id is carried along.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import map_batches, table

LOOKAHEAD = 4  # characters after a match that can have a say in where it ends
RESULT = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
RESULT_IDS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Merges pieces by rank. Keeps the ids of up to keep pieces, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 300_000):
        self.ranks, self.keep, self.cache = ranks, keep, {}
        self.byte_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.byte_of[i] = b

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 64:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 60:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n for a piece of any length."""
        ranks, n = self.ranks, len(piece)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], right[i] = end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := ranks.get(piece[left[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, left[i], end[i]))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def packed(self, pieces: list[str]) -> bytes:
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = array("I", self.merge(p.encode("utf-8", "surrogatepass"))).tobytes()
                if len(p) <= 64:
                    if len(cache) >= self.keep:
                        cache.clear()
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        of = self.byte_of
        return b"".join([of[i] for i in memoryview(packed).cast("I")])


def boundaries(pattern, text: str, last: bool) -> list[int]:
    """Ends of the matches in a chunk that what follows the chunk can't change."""
    limit = len(text) - (0 if last else LOOKAHEAD)
    ends = [m.end() for m in pattern.finditer(text)]
    while ends and ends[-1] > limit:
        ends.pop()
    return ends


def stitch(pattern, text: str, chunks: list[tuple[int, list[int]]]) -> list[int]:
    """All piece ends of text from the chunks' (start, ends within the chunk), in order of start."""
    out = [0]
    for start, ends in chunks:
        own = [start, *(start + e for e in ends)]
        known = set(own)
        i = bisect_left(out, start)
        while i < len(out) and out[i] not in known:
            i += 1
        if i < len(out):
            del out[i + 1 :]
        else:
            while out[-1] not in known and out[-1] < own[-1]:
                out.append(pattern.match(text, out[-1]).end())
        if out[-1] in known:
            out += own[bisect_left(own, out[-1]) + 1 :]
    while out[-1] < len(text):
        out.append(pattern.match(text, out[-1]).end())
    return out


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 1_024, with_ids: bool = False
) -> DataFrame:
    """id, n_tokens, digests of the ids and of the bytes decoded from them; with_ids adds both themselves. rank_file is
    read on the driver: a vocabulary has a fixed size (0.8 MB here), which the tasks get with the function."""
    ranks = read_ranks(rank_file)
    schema = RESULT_IDS if with_ids else RESULT

    def start():
        import regex

        return regex.compile(pattern), Merger(ranks)

    def result(i, merger, pieces):
        packed = merger.packed(pieces)
        back = merger.decode(packed)
        row = (i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
        return (*row, array("i", packed).tolist(), back) if with_ids else row

    def make_whole():
        cut, merger = start()

        def each(ids, texts):
            return list(zip(*(result(i, merger, cut.findall(t) if t else []) for i, t in zip(ids, texts, strict=True)), strict=True))

        return each

    def make_chunks():
        cut, _ = start()

        def each(ids, hashes, ks, n, texts):
            return [ids, hashes, ks, n, texts, [boundaries(cut, t, k == m - 1) for t, k, m in zip(texts, ks, n, strict=True)]]

        return each

    def join(rows):
        import pandas as pd

        cut, merger = start()
        rows = rows.sort_values("k")
        copies = int((rows["k"] == 0).sum())
        rows = rows.drop_duplicates("k")
        text = "".join([*(t[:chunk_chars] for t in rows["chunk"].iloc[:-1]), rows["chunk"].iloc[-1]])
        ends = stitch(cut, text, [(int(k) * chunk_chars, list(e)) for k, e in zip(rows["k"], rows["ends"], strict=True)])
        i = rows["id"].iloc[0]
        row = result(None if pd.isna(i) else int(i), merger, [text[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        return pd.DataFrame([row] * copies, columns=[x.split()[0] for x in schema.split(", ")])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    short = map_batches(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars), schema, make_whole)
    n = F.ceil((F.length("text") - overlap) / chunk_chars).cast("int")
    rows = docs.where(F.length("text") > chunk_chars).select("id", F.xxhash64("text").alias("hash"), n.alias("n"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    chunk = F.when(F.col("k") == F.col("n") - 1, F.expr(f"substring(text, k * {chunk_chars} + 1)")).otherwise(F.expr(f"substring(text, k * {chunk_chars} + 1, {chunk_chars + overlap})"))
    rows = rows.select("id", "hash", "k", "n", chunk.alias("chunk"))
    parted = map_batches(rows, "id long, hash long, k int, n int, chunk string, ends array<int>", make_chunks)
    return short.unionAll(parted.groupBy("id", "hash").applyInPandas(join, schema))


def decode_ids(rows: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """rows with a binary column decoded: the bytes of ids_col's ids, one after another (null: no bytes)."""
    byte_of = {i: b for b, i in read_ranks(rank_file).items()}
    of = F.pandas_udf(lambda s: s.map(lambda ids: b"" if ids is None else b"".join(byte_of[i] for i in ids)), "binary")
    return rows.withColumn("decoded", of(F.col(ids_col)))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.withColumnRenamed("id", "doc_id")
