"""Sources by adapters: dispatch, parts on executors, errors as rows."""

import io

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillmill.plans.translate import translate
from quillmill.sources import adapters
from quillmill.sources.adapters import Adapter, FileAdapter, from_stream, load, register_adapters


def numbers():
    """An adapter of this test's own, sent to executors by value."""

    class Numbers(Adapter):
        def __init__(self, mark="n"):
            self.mark = mark

        def can_handle(self, source):
            return source.startswith("numbers:")

        def parts(self, source):
            n = int(source.split(":")[1])
            return [range(i, min(i + 4, n)) for i in range(0, n, 4)]

        def read(self, part):
            for i in part:
                yield {"path": f"numbers:{i}", "name": f"{self.mark}{i}.txt", "content": ValueError("odd one") if i == 5 else f"text {i} in part {TaskContext.get().partitionId()}"}

    return Numbers


def test_custom_adapters_come_first(spark):
    kind = numbers()
    register_adapters(spark, kind())
    got = {r.name: r for r in load(spark, "numbers:10").collect()}
    assert len(got) == 10 and got["n5.txt"].error.kind == "parse_failed" and got["n5.txt"].content is None
    assert {bytes(r.content).decode().rsplit(" ", 1)[1] for r in got.values() if r.content} == {"0", "1", "2"}  # a task for each part
    register_adapters(spark, kind("later"))
    assert load(spark, "numbers:1").first().name == "later0.txt" and load(spark, "raw:numbers:").first().name == "raw_data"
    done = translate(load(spark, "numbers:3")).select("content", "format").collect()
    assert {r.format for r in done} == {"txt"} and all(any(f"text {i} in" in r.content for r in done) for i in range(3))
    assert load(spark, "numbers:0").count() == 0


def test_built_in_sources(spark, tmp_path):
    register_adapters(spark)
    (tmp_path / "sub").mkdir()
    for name, body in (("a.txt", b"one"), ("sub/b.bin", bytes(range(256))), ("c.txt", b"")):
        (tmp_path / name).write_bytes(body)
    got = {r.name: r for r in load(spark, f"file://{tmp_path}").collect()}
    assert {n: bytes(r.content) for n, r in got.items()} == {"a.txt": b"one", "b.bin": bytes(range(256)), "c.txt": b""} and got["a.txt"].mtime is not None and got["b.bin"].length == 256
    assert load(spark, f"{tmp_path}/a.txt").first().length == 3 and bytes(load(spark, "raw:é").first().content) == "é".encode()
    with pytest.raises(Exception, match="no adapter"):
        load(spark, f"{tmp_path}/nowhere").count()


def test_large_files_are_not_read(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"y" * 3)
    small = FileAdapter(part_bytes=5, most_bytes=5)
    parts = small.parts(f"file://{tmp_path}")
    assert [[p[2] for p in part] for part in parts] == [[10], [3]]
    rows = [r for part in parts for r in small.read(part)]
    assert rows[0]["content"] is None and rows[0]["error"][0] == "too_large" and rows[1]["content"] == b"yyy"
    (tmp_path / "b").unlink()
    assert isinstance(next(small.read(parts[1]))["content"], FileNotFoundError)


def test_table_columns(spark, tmp_path):
    register_adapters(spark)
    spark.range(0, 50, numPartitions=3).select("id", F.when(F.col("id") != 7, F.concat(F.lit("text é "), "id")).alias("text"), F.lit(1).alias("more")).write.parquet(f"{tmp_path}/t")
    df = load(spark, f"table:file://{tmp_path}/t#id,text")
    got = {r.name: r.content and bytes(r.content).decode() for r in df.collect()}
    assert df.rdd.getNumPartitions() == 3 and got == {f"{i}.txt": None if i == 7 else f"text é {i}" for i in range(50)}


def test_streams(spark):
    r = from_stream(spark, io.StringIO("some text"), "s.txt", chunk=4).first()
    assert (bytes(r.content), r.length, r.error) == (b"some text", 9, None)
    r = from_stream(spark, io.BytesIO(b"x" * 100), most_bytes=50, chunk=20).first()
    assert r.content is None and r.error.kind == "too_large"
    assert adapters.BUILT_IN[-1].can_handle("file:///") and not adapters.BUILT_IN[0].can_handle("table:x")
