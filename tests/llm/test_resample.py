import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmill.llm import resample as module
from quillmill.llm.resample import column_sums, matrix, resample, weights

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, grams=(1, 1)):
    words = re.findall(WORD, (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, buckets=10_000, grams=(1, 1), least=20):
    """The definition, with dictionaries."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: {b: sum(1 for x in texts if x == b) for b in set(texts)}
    s, t = count([bucket(f) for _, d in docs for f in features(d, grams)[1]]), count([bucket(f) for d in target for f in features(d, grams)[1]])
    held, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (held + buckets) / ((s.get(b, 0) + 1) * (wanted + buckets))))
    rows = []
    for i, d in docs:
        words, own = features(d, grams)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, None, len(words)])
    may = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def corpus(n=120):
    rng = random.Random(2)
    words = ["stone", "River", "MILL", "é", "ÉTÉ", "x1", "9", "of", "the", "a"]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "!", "\x00"]) for _ in range(rng.randrange(60)))) for i in range(n)] + [(500, None), (501, ""), (502, "?!"), (503, "one"), (504, "word " * 30_000)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("grams,buckets", [((1, 1), 10_000), ((1, 2), 64)])
def test_equals_definition(spark, docs, grams, buckets):
    d, target = corpus(), ["the mill of a stone", "river stone stone", "", None]
    got = resample(docs(*d), spark.createDataFrame([(t,) for t in target], "text string"), percent=25, buckets=buckets, grams=grams)
    assert rows_of(got) == sorted(brute(d, target, 25, buckets, grams), key=repr)


def test_blocks_hold_the_matrix(spark, docs, monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 3)
    d = corpus(40)
    blocks = matrix(docs(*d).repartition(3), 50, block_cells=40)
    assert blocks.count() > 6
    cells = {}
    for b in blocks.collect():
        for r, ident in enumerate(b.ids):
            for k in range(b.starts[r], b.starts[r + 1]):
                cells[ident, b.buckets[k]] = b.counts[k]
    want = {}
    for i, text in d:
        for f in features(text)[1]:
            want[i, zlib.crc32(f.encode()) % 50] = want.get((i, zlib.crc32(f.encode()) % 50), 0) + 1
    assert cells == want
    sums = {r.bucket: r.n for r in column_sums(blocks, 50).collect()}
    assert sums == {b: sum(n for (_, x), n in want.items() if x == b) for b in {x for _, x in want}}
    ones = __import__("numpy").ones(50, "int64")
    assert all(r.weight == (1 if r.n_features else 0) for r in weights(blocks, ones).collect())


def test_odd_rows(spark, docs):
    text = "river stone mill " * 10
    d = [(None, text), (7, text), (7, text), *((i, text) for i in range(20, 60))]
    target = spark.createDataFrame([("river",)], "text string")
    got = resample(docs(*d), target, percent=20).collect()
    assert len(got) == 43 and sorted(r.rank for r in got if r.rank) == list(range(1, 9)) and [(r.score, r.rank) for r in got if r.id is None] == [(None, None)]
    assert len({r.score for r in got if r.id == 7}) == 1
    none = docs((1, text)).where("false")
    assert resample(none, target).count() == 0
    alone = resample(docs((1, text), (2, None)), target.where("false"), percent=100).collect()
    assert {(r.id, r.rank) for r in alone} == {(1, 1), (2, None)}
    clash = docs(*d[1:]).withColumns({"id": F.lit("x"), "score": F.lit(1), "rank": F.lit(2), "weight": F.lit(3), "n_words": F.lit(4)})
    assert rows_of(resample(clash, target)) == rows_of(resample(docs(*d[1:]), target))


def test_a_task_holds_few_texts_or_blocks_at_once(spark, docs, monkeypatch):
    held, key = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    monkeypatch.setattr(module, "durable", lambda df, name, made=module.durable, **o: held.setdefault(name, (int(spark.conf.get(key)), o)) and made(df, name, **o))
    assert resample(docs(*corpus(40)), spark.createDataFrame([("river",)], "text string")).count() == 45
    assert held["matrix"][0] <= 256 and int(held["matrix"][1]["parquet.block.size.row.check.min"]) == 1 and held["scored"][0] <= 8
    assert spark.conf.get(key) == was
