"""Hard negatives by a two-dimensional block matrix product (SUMMA-style).

Vectors become whole numbers (floor(scale * x)). Anchors and rows are sharded into blocks of rows, and each block into
chunks of dimensions. Where a block of anchors meets a block of rows, all chunks of both come together, tile by tile: the
product of one chunk is a partial tile of scores, partial tiles are added as int64 where they are made, and the finished
tile is reduced there: only the best few rows of a block for each anchor (and positive) leave it. No score is shuffled.
The best of all blocks are chosen by a ranked window whose groups hold a few rows a block.

There are two such products. The first meets anchors with the rows that may have their label (blocks are made within
groups of labels, by a hash of the label) and gives each anchor its positives: the highest scores of its label. The
second meets anchors with all blocks and gives, for each anchor and positive, the highest scores among other labels that
lie in the window from low to high percent of the positive's score. No score leaves a tile but those; a tile has
tile_anchors x tile_rows scores however many rows there are, and a label that a third of all rows have is many blocks.
The work is anchors x rows x dimensions: that is what the method costs. What is shuffled are blocks: rows once for each
block of anchors (16 tiles' anchors at most), anchors once for each block of rows (16 tiles' rows at most, and fewer
where there would be fewer than 64 blocks).

Products are exact: whole numbers are multiplied as doubles only where their sums stay below 2^53, else as int64.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do rows with a component
beyond 2^24 after scaling, whose products might not fit a long. Vectors may differ in length: missing components count
as 0. Ties are broken by smaller ids. Repeated rows each take part; a row with an anchor's id is neither a positive nor a
negative of that anchor, and an anchor that is repeated gives its rows once each. An anchor without positives gives no
rows, nor does a positive without negatives in its window. An empty table gives an empty one. Only the named columns are
read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import durable, table

LARGEST = 1 << 24  # a component: sums of 2^14 products fit a long
NONE = np.iinfo(np.int64).min
GROUPS = 16  # of labels
BLOCK = "block int, chunk int, rows binary, ids binary, labels binary, wanted binary, values binary, kind string"
TILE = "chunk partial kind rows ids labels wanted row_ids row_labels".split()
TILES_A_SIDE, LEAST_BLOCKS = 16, 64  # of a block; of rows


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    if not x.size:
        return x.astype(np.int16)
    low, high = x.min(), x.max()
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, exactly."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    bound = int(np.abs(x.astype(np.int64)).max()) * int(np.abs(y.astype(np.int64)).max()) * x.shape[1]
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """row (a number of its own for each row), id, label, v (whole numbers), anchor, set (the group of its label)."""
    x = lambda e: e.cast("double") * float(scale)
    good = F.forall("v", lambda e: F.coalesce(F.abs(x(e)) <= float(LARGEST), F.lit(False)))  # false of NaN and infinity
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda e: F.floor(x(e)))).withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("set", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))


def blocked(rows: DataFrame, block: Column, chunks: int, width: int) -> DataFrame:
    """Blocks by chunks of dimensions, as a durable table; a block's rows are in the order of their ids. Rows may have a
    column wanted (an array of longs, all of one length) that goes with the first chunk, as do ids and labels."""
    if "wanted" not in rows.columns:
        rows = rows.withColumn("wanted", F.array().cast("array<long>"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"], kind="stable")
        x = np.zeros((len(part), chunks * width), np.int64)
        for i, v in enumerate(part["v"]):
            x[i, : len(v)] = v
        named = [np.ascontiguousarray(part[c].to_numpy(np.int64)).tobytes() for c in ("row", "id", "label")] + [np.array(part["wanted"].tolist(), np.int64).tobytes()]
        out = []
        for k in range(chunks):
            values = narrow(x[:, k * width : (k + 1) * width])
            out.append((int(part["block"].iloc[0]), k, *(named if k == 0 else [b""] * 4), values.tobytes(), values.dtype.str))
        return pd.DataFrame(out, columns=[f.split()[0] for f in BLOCK.split(", ")])

    return durable(rows.withColumn("block", block.cast("int")).select("block", "row", "id", "label", "v", "wanted").groupBy("block").applyInPandas(run, BLOCK), "blocks")


def tiles(anchors: DataFrame, rows: DataFrame, meets_rows: Column, meets_anchors: Column, width: int, tile: tuple[int, int], reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str], most: int) -> DataFrame:
    """What reduce leaves of each tile (by schema), the best `most` of a pair of blocks for each of keys. meets_rows and
    meets_anchors are arrays: the blocks that a block of the one side meets."""
    left = anchors.select("*", F.explode(meets_rows).alias("other"))
    right = rows.select("*", F.explode(meets_anchors).alias("other"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            x, y = x.sort_values("chunk"), y.sort_values("chunk")
            xs, ys = ([np.frombuffer(v, kind).reshape(-1, width) for v, kind in zip(s["values"], s["kind"], strict=True)] for s in (x, y))
            of = [longs(x[c].iloc[0]).reshape(len(xs[0]), -1) for c in ("rows", "ids", "labels", "wanted")]
            other = [longs(y[c].iloc[0]) for c in ("ids", "labels")]
            for i in range(0, len(xs[0]), tile[0]):
                found = []
                for j in range(0, len(ys[0]), tile[1]):
                    named = [c[i : i + tile[0]].tobytes() for c in of] + [c[j : j + tile[1]].tobytes() for c in other]
                    partial = [narrow(product(p[i : i + tile[0]], q[j : j + tile[1]])) for p, q in zip(xs, ys, strict=True)]
                    found.append(reduce(pd.DataFrame([(k, p.tobytes(), p.dtype.str, *named) for k, p in enumerate(partial)], columns=TILE)))
                if found := [f for f in found if len(f)]:
                    best_of = pd.concat(found).sort_values([*keys, "score", "id"], ascending=[*(True for _ in keys), False, True], kind="stable")
                    out.append(best_of[best_of.groupby(keys).cumcount() < most])
        return pd.concat(out) if out else pd.DataFrame([], columns=names)

    left = left.withColumnsRenamed({"block": "a", "other": "b"}).groupBy("a", "b")
    right = right.withColumnsRenamed({"block": "b", "other": "a"}).groupBy("a", "b")
    return left.cogroup(right).applyInPandas(run, schema)


def added(part: pd.DataFrame) -> tuple[np.ndarray, pd.Series]:
    """The finished tile and the row of the first chunk, which names what stands at its sides."""
    head = part.loc[part["chunk"].idxmin()]
    shape = len(longs(head["ids"])), len(longs(head["row_ids"]))
    total = np.zeros(shape, np.int64)
    for data, kind in zip(part["partial"], part["kind"], strict=True):
        total += np.frombuffer(data, kind).reshape(shape)
    return total, head


def best(scores: np.ndarray, allowed: np.ndarray, most: int):
    """For each rank: (rows of the tile, columns, scores) of the highest allowed scores, the first column of equal ones."""
    left = np.where(allowed, scores, NONE)
    every = np.arange(len(left))
    for _ in range(most if left.shape[1] else 0):
        at = left.argmax(1)
        value = left[every, at]
        hit = np.nonzero(value != NONE)[0]
        if not len(hit):
            return
        yield hit, at[hit], value[hit]
        left[hit, at[hit]] = NONE


POSITIVES = "row long, anchor_id long, id long, score long"
NEGATIVES = "row long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


def positives_of(part: pd.DataFrame, most: int) -> pd.DataFrame:
    score, head = added(part)
    rows, ids, others = longs(head["rows"]), longs(head["ids"]), longs(head["row_ids"])
    allowed = (longs(head["labels"])[:, None] == longs(head["row_labels"])[None, :]) & (ids[:, None] != others[None, :])
    out = [pd.DataFrame({"row": rows[i], "anchor_id": ids[i], "id": others[j], "score": s}) for i, j, s in best(score, allowed, most)]
    return pd.concat(out) if out else pd.DataFrame([], columns=[f.split()[0] for f in POSITIVES.split(", ")])


def negatives_of(part: pd.DataFrame, positives: int, most: int, low: int, high: int) -> pd.DataFrame:
    """wanted holds, for each anchor and place: held (0 or 1), the positive's id and its score."""
    score, head = added(part)
    rows, ids, others = longs(head["rows"]), longs(head["ids"]), longs(head["row_ids"])
    wanted = longs(head["wanted"]).reshape(len(rows), positives, 3)
    differ = (longs(head["labels"])[:, None] != longs(head["row_labels"])[None, :]) & (ids[:, None] != others[None, :])
    out = []
    for place in range(positives):
        held, names, of = wanted[:, place, 0] > 0, wanted[:, place, 1], wanted[:, place, 2]
        if not held.any():
            break
        least = np.array([-(-low * int(s) // 100) for s in of], np.int64)  # 100 * score >= low * positive's
        largest = np.array([high * int(s) // 100 for s in of], np.int64)
        allowed = differ & held[:, None] & (score >= least[:, None]) & (score <= largest[:, None])
        out += [pd.DataFrame({"row": rows[i], "anchor_id": ids[i], "place": place, "positive_id": names[i], "positive_score": of[i], "id": others[j], "score": s}) for i, j, s in best(score, allowed, most)]
    return pd.concat(out) if out else pd.DataFrame([], columns=[f.split()[0] for f in NEGATIVES.split(", ")])


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    tile_anchors: int = 512, tile_rows: int = 2048, width: int = 32,
) -> DataFrame:
    """row, anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor says which rows are
    anchors; label (default: the column label) must be a whole number."""
    rows = durable(prepared(vectors, id_col, vector_col, F.col("label") if label is None else label, anchor, scale), "vectors")
    held = {r["set"]: r for r in rows.groupBy("set").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("d")).collect()}  # a row for each group of labels
    chunks = max([1, *(-(-r["d"] // width) for r in held.values())])
    out = "row long, anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sum(r["anchors"] for r in held.values()):
        return vectors.sparkSession.createDataFrame([], out)

    def blocks_by_set(count: str, size: int) -> tuple[list[int], int]:
        """First block of each group of labels (and one past the last)."""
        first = [0]
        for s in range(GROUPS):
            first.append(first[-1] + (-(-held[s][count] // size) if s in held else 0))
        return first, first[-1]

    salt = F.xxhash64("id", "row")  # a row's number is its own, so rows repeated with one id are spread too
    at = lambda first, s: F.element_at(F.array(*map(F.lit, first)), s + 1)
    in_set = lambda first: at(first, F.col("set")) + F.pmod(salt, F.greatest(F.lit(1), at(first, F.col("set") + 1) - at(first, F.col("set"))))
    set_of = lambda first: F.size(F.filter(F.array(*map(F.lit, first[1:])), lambda x: x <= F.col("block")))
    span = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))

    n, n_anchors = (sum(r[c] for r in held.values()) for c in ("n", "anchors"))
    block_rows = min(max(tile_rows, -(-n // LEAST_BLOCKS)), TILES_A_SIDE * tile_rows)
    block_anchors = TILES_A_SIDE * tile_anchors
    tile = (tile_anchors, tile_rows)
    row_first, n_rows = blocks_by_set("n", block_rows)
    anchor_first, _ = blocks_by_set("anchors", block_anchors)
    row_blocks = blocked(rows, in_set(row_first), chunks, width)

    own = blocked(rows.where("anchor"), in_set(anchor_first), chunks, width)
    meet = lambda mine, other: span(at(other, set_of(mine)), at(other, set_of(mine) + 1))
    found = tiles(own, row_blocks, meet(anchor_first, row_first), meet(row_first, anchor_first), width, tile, lambda part: positives_of(part, positives), POSITIVES, ["row"], positives)
    found = durable(ranked(found, ["row"], positives), "positives")

    place = lambda k: F.struct(F.max(F.when(F.col("rank") == k, 1)).alias("h"), F.max(F.when(F.col("rank") == k, F.col("id"))).alias("i"), F.max(F.when(F.col("rank") == k, F.col("score"))).alias("s"))
    told = found.groupBy("row").agg(*(place(k + 1).alias(f"p{k}") for k in range(positives)))
    flat = F.array(*(F.coalesce(F.col(f"p{k}.{c}").cast("long"), F.lit(0).cast("long")) for k in range(positives) for c in "his"))
    asked = rows.where("anchor").join(told, "row").select("row", "id", "label", "v", "set", flat.alias("wanted"))
    n_anchors = -(-n_anchors // block_anchors)
    asking = blocked(asked, F.pmod(salt, F.lit(n_anchors)), chunks, width)
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    hard = tiles(asking, row_blocks, every(n_rows), every(n_anchors), width, tile, lambda part: negatives_of(part, positives, negatives, low, high), NEGATIVES, ["row", "place"], negatives)
    hard = ranked(hard, ["row", "place"], negatives)
    return hard.select("row", "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label).drop("row")


ORACLE = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.l = b.l AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS c, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a WHERE NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""
