"""The content cache: a key is converted once, and again only when it has expired or was evicted."""

import pytest
from pyspark.sql import functions as F

from quillmill.sources.cache import ContentCache


@pytest.fixture
def cache(spark, tmp_path):
    return ContentCache(spark, f"file://{tmp_path}/cache", ttl=100, keep=40, buckets=4)


def sources(spark, numbers):
    return spark.createDataFrame([(n, f"name{n}", f"text {n}".encode() if n >= 0 else None) for n in numbers], "n long, name string, content binary")


def counted(spark):
    """A conversion that counts the rows it is given; even its failures (text 13) are counted."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(len(b))
            yield b[["key"]].assign(data=[None if c is None or c == b"text 13" else c.decode().upper() for c in b["content"]])

    return n, lambda df: df.select("key", "content").mapInPandas(run, "key string, data string")


def test_a_second_run_converts_nothing(spark, cache):
    n, convert = counted(spark)
    rows = sources(spark, [1, 2, 3, 3, 3, 13])
    got = {(r.n, r.data, r.hit) for r in cache.cached(rows, convert, 1000).collect()}
    assert got == {(1, "TEXT 1", False), (2, "TEXT 2", False), (3, "TEXT 3", False), (13, None, False)} and n.value == 4
    got = cache.cached(rows, convert, 1050).collect()
    assert {(r.n, r.data, r.hit) for r in got if r.n < 13} == {(1, "TEXT 1", True), (2, "TEXT 2", True), (3, "TEXT 3", True)} and len(got) == 6 and n.value == 5  # the failure is tried again
    held = {r.data: (r.created_at, r.last_accessed, r.access_count) for r in cache.entries().collect()}
    assert held == {"TEXT 1": (1000, 1050, 2), "TEXT 2": (1000, 1050, 2), "TEXT 3": (1000, 1050, 6)}
    cache.cached(rows.where("n = 1"), convert, 1060, output="html")
    assert n.value == 6  # what shapes the result is part of the key
    cache.cached(rows.where("n = 1"), convert, 1060, refresh=True)
    assert n.value == 7


def test_entries_expire_and_the_least_used_go(spark, cache):
    n, convert = counted(spark)
    cache.cached(sources(spark, range(20, 30)), convert, 1000)
    cache.cached(sources(spark, range(20, 30)), convert, 1101)
    assert n.value == 20
    for at in range(3):
        cache.cached(sources(spark, range(100 * at, 100 * at + 30)), convert, 1110 + at)
    held = cache.entries().collect()
    assert len(held) <= 40 and all(int(r.data.split()[1]) >= 100 for r in held if r.last_accessed >= 1112) and sum(r.last_accessed == 1112 for r in held) >= 24
    cache.purge(1211)
    assert {r.last_accessed for r in cache.entries().collect()} == {1112} or cache.entries().where("expires_at <= 1211").count() == 0
    cache.sweep()
    assert len(cache.files.generations()) == 1 and cache.entries().where(F.col("data").isNull()).count() == 0


def test_untouched_buckets_stay(spark, cache):
    _, convert = counted(spark)
    cache.cached(sources(spark, range(50)), convert, 1000)
    before = cache.files.manifest()
    cache.cached(sources(spark, [3]), convert, 1001)
    after = cache.files.manifest()
    assert sum(after["rows"][b] != s for b, s in before["rows"].items()) == 1 == len(after["touched"])
    assert cache.cached(sources(spark, []), convert, 1002).count() == 0


def test_data_is_written_once_and_folded(spark, tmp_path):
    cache = ContentCache(spark, f"file://{tmp_path}/fold", ttl=100, keep=400, buckets=2, most_segments=2)
    n, convert = counted(spark)
    rows = sources(spark, range(20, 40))
    cache.cached(rows, convert, 1000)
    before = cache.files.manifest()
    assert all(r.hit and r.data == f"TEXT {r.n}" for r in cache.cached(rows, convert, 1001).collect())
    assert cache.files.manifest()["data"] == before["data"] and n.value == 20  # a hit rewrites no data
    for at in range(4):
        cache.cached(sources(spark, range(50 + 20 * at, 70 + 20 * at)), convert, 1050 + at)
    m = cache.files.manifest()
    assert max(map(len, m["data"].values())) <= 2 and n.value == 100
    held = {r.data: r.access_count for r in cache.entries().collect()}
    assert held == {f"TEXT {i}": 2 if i < 40 else 1 for i in [*range(20, 40), *range(50, 130)]}
    assert {(r.data, r.hit) for r in cache.cached(rows, convert, 1060, refresh=True).collect()} == {(f"TEXT {i}", False) for i in range(20, 40)} and n.value == 120
    cache.purge(1155)  # only what was made anew stays
    cache.sweep()
    assert {r.data for r in cache.entries().collect()} == {f"TEXT {i}" for i in range(20, 40)} == {r.data for r in cache._data(cache.files.manifest()).collect()}
