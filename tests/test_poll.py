"""The polled inbox: versions once, also across a restart."""

import os
import time

import pytest

from quillmill.streaming.poll import Polled, PolledReader, advance, forget


def test_listings_step_by_step():
    step = lambda before, seen, n, now, gone=(), most=10: advance(before, seen, set(gone), n, now, 100, most)
    one = step({}, {"a": (1, 5), "b": (2, 5)}, 1, 1000)
    assert one == {"a": [1, 5, 1000, 0], "b": [2, 5, 1000, 0]}
    assert step(one, {"a": (1, 5), "b": (2, 5)}, 2, 1050) == one  # not long enough
    two = step(one, {"a": (1, 5), "b": (2, 6)}, 2, 1100)
    assert two == {"a": [1, 5, 1000, 2], "b": [2, 6, 1100, 0]}
    three = step(two, {"a": (1, 5), "b": (2, 6)}, 3, 1200)
    assert three == {"a": [1, 5, 1000, 2], "b": [2, 6, 1100, 3]} and step(three, {"a": (1, 5), "b": (2, 6)}, 4, 9999) == three
    assert step(three, {"b": (2, 6)}, 4, 1300) == {"b": [2, 6, 1100, 3]}  # a file that is gone leaves
    assert step(three, {"a": (1, 5), "b": (2, 6)}, 4, 1300, gone={"a"})["a"] == [1, 5, 1000, 4]  # asked for again
    many = step({}, {f"f{i}": (1, 1) for i in range(9)}, 1, 0)
    assert sum(v[3] == 2 for v in step(many, {f"f{i}": (1, 1) for i in range(9)}, 2, 500, most=4).values()) == 4


@pytest.fixture
def inbox(spark, tmp_path):
    spark.dataSource.register(Polled)
    (tmp_path / "in").mkdir()
    seen = []

    def run(**options):
        df = spark.readStream.format("quillmill_inbox").option("path", f"file://{tmp_path}/in").option("log", f"file://{tmp_path}/log").option("settle_ms", "300").options(**options).load()
        return df.writeStream.foreachBatch(lambda rows, n: seen.extend((n, r.name, bytes(r.content).decode() if r.content is not None else r.error.kind) for r in rows.collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="200 milliseconds").start()

    def until(want, query, seconds=40):
        end = time.time() + seconds
        while time.time() < end and [x[1:] for x in sorted(seen)] != want and sorted(x[1:] for x in seen) != sorted(want):
            assert query.exception() is None
            time.sleep(0.2)
        time.sleep(1.5)  # nothing may follow
        assert sorted(x[1:] for x in seen) == sorted(want)

    return tmp_path, run, until


def test_versions_come_once_across_a_restart(inbox):
    folder, run, until = inbox
    (folder / "in" / "a.txt").write_text("one")
    (folder / "in" / "large.txt").write_text("x" * 100)
    query = run(most_bytes="50")
    want = [("a.txt", "one"), ("large.txt", "too_large")]
    try:
        until(want, query)
        (folder / "in" / "a.txt").write_text("two!")  # rewritten in place
        want.append(("a.txt", "two!"))
        until(want, query)
    finally:
        query.stop()
    (folder / "in" / "b.txt").write_text("b")
    (folder / "in" / ".hidden").write_text("no")
    query = run(most_bytes="50")
    try:
        want.append(("b.txt", "b"))
        until(want, query)
        forget(f"file://{folder}/log", f"file://{folder}/in/a.txt")
        want.append(("a.txt", "two!"))
        until(want, query)
    finally:
        query.stop()


def test_a_batch_read_again_gives_the_same(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(str(i))
    reader = PolledReader({"path": f"file://{tmp_path}/in", "log": f"file://{tmp_path}/log", "settle_ms": "0", "part_files": "2"})
    ends = [reader.latestOffset()["listing"] for _ in range(4)]
    assert ends == [1, 2, 2, 2]
    parts = reader.partitions({"listing": 0}, {"listing": 2})
    assert [len(p.files) for p in parts] == [2, 2, 1] and reader.partitions({"listing": 2}, {"listing": 2})[0].files == []
    rows = [r for p in parts for r in reader.read(p)]
    assert [(r[1], r[4]) for r in rows] == [(f"{i}.txt", str(i).encode()) for i in range(5)]
    os.remove(tmp_path / "in" / "3.txt")
    (tmp_path / "in" / "4.txt").write_text("changed")
    again = [r for p in reader.partitions({"listing": 0}, {"listing": 2}) for r in reader.read(p)]
    assert [r[:4] for r in again] == [r[:4] for r in rows] and [r[5] and r[5][0] for r in again] == [None, None, None, "file_not_found", "parse_failed"]
    assert reader.latestOffset() == {"listing": 3} and reader.latestOffset() == {"listing": 4}
    assert [f[0].rsplit("/", 1)[1] for p in reader.partitions({"listing": 2}, {"listing": 4}) for f in p.files] == ["4.txt"]
