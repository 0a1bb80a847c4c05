"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (sample_rows vectors, by hash of the vector) so that the signs of the
rotated, centred components lose least (iterative quantisation: alternate sign codes and the orthogonal Procrustes
rotation). Every vector gets a code from each rotation; codes are cut into substrings, and each substring is the key of
one Hamming table. There are as many rotations as let a pair at the threshold share a key with a probability of 0.9,
however long the keys are: that is measured on simulated pairs of that cosine around sampled vectors. Where it takes
more than MOST_TABLES tables, keys get shorter. Vectors that share a bucket of any table are compared by the cosine of
their original components in double precision. A pair counts in the first table that holds both in one bucket and in no
other, so counts need no distinct over pairs.

Equal vectors are one class beforehand. A bucket of more than block vectors is cut into blocks by hash, and each pair
of blocks is one group of its own: no bucket meets in one task. A group gives for each vector a number of links and the
root of its local component, never pairs; the roots are joined by connected components.

Vectors that are null, zero or hold null or non-finite components link with nothing: 0 links, a component of their own.
Vectors of different dimensions never link; those of one dimension do, whatever it is: for codes (never for cosines)
vectors are filled up with zeros or folded to the sample's most frequent dimension, and keys hold the dimension. Rows
repeated with the same id count as one vector each for their links, and share one row's id as component. Rows with a
null id are vectors like others; a component of such rows alone has a null id, and kept is null there. Only the id and
the vector are read, so other columns, whatever their names, don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import components, durable, table

COSINE = 0.9
RECALL = 0.93  # aimed at for pairs at the threshold: 0.9, and a margin for what simulated pairs don't show
LEAST_ROTATIONS, MOST_TABLES = 4, 64
LOT_ROWS = 20_000


def learn_rotations(sample: np.ndarray, rotations: int, steps: int = 40, seed: int = 7, made: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean, and for each rotation a matrix whose products' signs are the code. The first of them may be made already."""
    dim, made = sample.shape[1], made or []
    mean = sample.mean(0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    v, out = x @ vectors, list(made)
    for k in range(len(made), rotations):
        rng = np.random.default_rng((seed, k))
        r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(steps):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(codes.T @ v)
            r = (u @ w).T
        out.append(vectors @ r)
    return mean, out


def table_keys(unit: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], key_bits: int) -> np.ndarray:
    """Keys of each vector (rows) in each table: substrings of its codes."""
    keys = []
    for r in rotations:
        bits = (unit - mean) @ r >= 0
        for at in range(0, bits.shape[1] - min(key_bits, bits.shape[1]) + 1, key_bits):
            part = bits[:, at : at + key_bits]
            keys.append(part @ (1 << np.arange(part.shape[1], dtype=np.int64)))
    return np.stack(keys, 1).astype(np.int64)


def simulated(unit: np.ndarray, threshold: float, pairs: int = 4000, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the threshold's cosine: sampled vectors, moved in any direction, and as the sample varies."""
    rng = np.random.default_rng(seed)
    a = unit[rng.integers(0, len(unit), pairs)]
    out = []
    for move in (rng.standard_normal(a.shape), unit[rng.integers(0, len(unit), pairs)] - unit[rng.integers(0, len(unit), pairs)]):
        move = move - (move * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(move, axis=1, keepdims=True)
        real = size[:, 0] > 1e-9
        out.append((a[real], threshold * a[real] + np.sqrt(max(0.0, 1 - threshold**2)) * move[real] / size[real]))
    return [(x, y) for x, y in out if len(x)]


def choose_rotations(unit: np.ndarray, threshold: float, key_bits: int, shorten: bool = True) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Mean, rotations and length of keys with which pairs at the threshold share a key with probability RECALL.
    Without shorten, keys stay as long as given, and tables may be more than MOST_TABLES."""
    apart = len(unit) // 4 if len(unit) >= 100 else 0  # pairs lie around vectors that rotations aren't learned on
    pairs, unit, turned, met = simulated(unit[:apart] if apart else unit, threshold), unit[apart:], [], {}
    while True:
        each = max(1, unit.shape[1] // key_bits)
        most = max(LEAST_ROTATIONS, MOST_TABLES // each if shorten else 8 * MOST_TABLES // each)
        for count in range(LEAST_ROTATIONS, most + 1):
            if count > len(turned):
                mean, turned = learn_rotations(unit, count, made=turned)
            for k in range(count):
                if (k, key_bits) not in met:
                    keys = [(table_keys(x, mean, turned[k : k + 1], key_bits), table_keys(y, mean, turned[k : k + 1], key_bits)) for x, y in pairs]
                    met[k, key_bits] = [(x == y).any(1) for x, y in keys]
            if all(np.any([met[k, key_bits][i] for k in range(count)], axis=0).mean() >= RECALL for i in range(len(pairs))):
                return mean, turned[:count], key_bits
        if not shorten or key_bits <= 1:
            return mean, turned[:most], key_bits
        key_bits -= 1


def unit_rows(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(vectors, dim: int) -> np.ndarray:
    """Unit rows of dim components: shorter vectors are filled up with zeros, longer ones folded with signs."""
    out = np.zeros((len(vectors), dim))
    signs = np.random.default_rng(3)
    flip = signs.choice([-1.0, 1.0], 1 << 16)
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        if len(v) <= dim:
            out[i, : len(v)] = v
        else:
            turn = np.arange(len(v))
            np.add.at(out[i], turn % dim, v * np.where(turn < dim, 1.0, flip[turn % len(flip)]))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1.0)


def local_roots(mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component in a symmetric mask, by spreading the smallest label and halving paths."""
    order = np.argsort(ids, kind="stable")
    mask, n = mask[np.ix_(order, order)] | np.eye(len(ids), dtype=bool), len(ids)
    label = np.arange(n)
    while True:
        new = np.where(mask, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, ids.dtype)
    out[order] = ids[order][label]
    return out


LINKED = "id long, links long, root long"


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One group: rows of two blocks (side 0 and 1) or of one block with itself (all side 2)."""
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    unit, keys, t = unit_rows(rows["vector"]), np.array(rows["keys"].tolist()), int(rows["t"].iloc[0])
    side = rows["side"].to_numpy()
    pair = unit @ unit.T >= threshold
    if side[0] != 2:
        pair &= side[:, None] != side[None, :]
    np.fill_diagonal(pair, False)
    a, b = np.nonzero(pair)
    if not len(a):
        return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
    for u in range(t):  # pairs that an earlier table has are left to it
        apart = keys[a, u] != keys[b, u]
        a, b = a[apart], b[apart]
    mask = np.zeros_like(pair)
    mask[a, b] = True
    links = np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
    root = local_roots(mask, ids)
    hit = links > 0
    return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": root[hit]})


def near_duplicates(
    vectors: DataFrame, threshold: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", rotations: int | None = None, key_bits: int | None = None, sample_rows: int = 20_000, block: int = 1024
) -> DataFrame:
    """id, n_links, component_id, kept for each row."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    number = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    good = F.coalesce((number > 0) & (number < float("inf")) & ~F.isnan(number), F.lit(False))  # a null or non-finite component makes the sum null, NaN or infinite
    base = base.withColumn("hash", F.when(good, F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))))
    seen = base.where(F.col("hash").isNotNull())
    n = seen.count()
    part = F.pmod(F.col("hash.a"), F.lit(1 << 20)) < min(1 << 20, (1 << 20) * sample_rows // max(n, 1) + 1)  # by hash, about sample_rows of them
    sample = [r[0] for r in seen.where(part).select("vector").limit(2 * sample_rows).collect()]
    if not sample:
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    unit = unit_rows(v for v in sample if len(v) == dim)
    shorten = key_bits is None
    if key_bits is None:  # substrings about as long as the logarithm of the number of vectors
        key_bits = int(min(max(6, round(np.log2(max(n, 2))) - 3), 24, dim))
    if rotations is None:
        mean, turned, key_bits = choose_rotations(unit, threshold, key_bits, shorten)
    else:
        mean, turned = learn_rotations(unit, rotations)
    classes = seen.groupBy("hash").agg(F.coalesce(F.min("id"), F.min("hash.a")).alias("id"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    tables = len(turned) * (dim // key_bits)

    def add_keys(batches):
        for rows in batches:
            if len(rows):
                sizes = rows["vector"].map(len).to_numpy(np.int64)[:, None]
                yield rows.assign(keys=list(table_keys(fitted(rows["vector"], dim), mean, turned, key_bits) + (sizes << 32)))

    classes = durable(classes.select("id", "least", "copies", "vector").mapInPandas(add_keys, "id long, least long, copies long, vector array<double>, keys array<long>"), "codes")
    placed = classes.select("id", "copies", F.posexplode("keys").alias("t", "key"))
    sizes = durable(placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "buckets")
    rows = classes.select("id", "copies", "vector", "keys", F.posexplode("keys").alias("t", "key")).join(sizes, ["t", "key"])
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # many small buckets make one group, so that a call does more than a pair; its rows are compared bucket by bucket
    lots = 1 + n * tables // LOT_ROWS
    lot = F.pmod(F.xxhash64("t", "key"), F.lit(lots))
    big = F.when(F.col("parts") > 1, F.xxhash64("t", "key", "i", "j"))  # a pair of blocks of a large bucket is a group of its own

    def run(part):
        done = [compare(g, threshold) for _, g in part.groupby(["t", "key", "i", "j"], sort=False) if len(g) > 1]
        return pd.concat(done) if done else pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")

    rows = rows.select(F.coalesce(big, lot).alias("lot"), big.isNotNull().alias("big"), "id", "copies", "vector", "keys", "t", "key", "i", "j", "side")
    found = durable(rows.groupBy("lot", "big").applyInPandas(run, LINKED), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = classes.select("id", "least", "copies").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = durable(told.join(lowest, "root").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "told")
    # members of a class are found by their hash; a large class is one key on the left, which adaptive execution can split
    rep = durable(seen.groupBy("hash").agg(F.coalesce(F.min("id"), F.min("hash.a")).alias("rep")), "reps")
    out = base.join(rep, "hash", "left").join(told.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
