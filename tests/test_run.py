"""Batches through the sink: content before records, a deadline, one row for each file."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillmill.plans.run import REPORT, run_batch
from quillmill.sources import parsers
from quillmill.sources.files import files
from quillmill.sources.sink import ROWS, Outputs, OutputsWriter, checked, records


def make(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name.replace('__', '.')}", "w") as f:
            f.write(text)
    return f"file://{folder}"


def told(report):
    return {r.path.rsplit("/", 1)[1]: r for r in report.collect()}


def under(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if "_runs" not in d and not n.endswith(".crc"))


@pytest.fixture
def slow():
    """A text parser that takes long over texts that say so, and fails on others."""
    was = parsers.PARSERS["txt"]

    def parser(content, options):
        text = content.decode()
        if text.startswith("slow"):
            time.sleep(90)
        if text.startswith("bad"):
            raise ValueError("no good")
        return [{"page_number": 1, "elements": [], "raw_text": text, "has_image": False, "has_table": False, "meta": {}}]

    parsers.register("txt", parser)
    yield
    parsers.register("txt", was)


def test_files_records_and_resume(spark, tmp_path, slow):
    src = make(tmp_path / "in", a__txt="text a", b__txt="text b", A__md="# other a", c__txt="bad", d__pdf="%PDF-1.4")
    out = f"file://{tmp_path}/out"
    rows = told(run_batch(files(spark, src), out, errors=True))
    with open(tmp_path / "out" / f"{rows['c.txt'].out}.err") as f:
        assert f.read().startswith("[parse_failed] ValueError: no good")
    assert {n: (r.state, r.kind) for n, r in rows.items()} == {"a.txt": ("ok", None), "b.txt": ("ok", None), "A.md": ("ok", None), "c.txt": ("failed", "parse_failed"), "d.pdf": ("failed", "unsupported_format")}
    for r in rows.values():
        if r.state == "ok":
            with open(tmp_path / "out" / r.out, "rb") as f:
                body = f.read()
            assert (len(body), hashlib.sha256(body).hexdigest()) == (r.size, r.sha256)
    assert under(tmp_path / "out") == sorted([REPORT, *(r.out + ".err" * (r.state != "ok") for r in rows.values())]) and len({r.out.lower() for r in rows.values()}) == 5
    with open(tmp_path / "out" / REPORT) as f:
        sums = json.load(f)
    assert (sums["total"], sums["ok_count"], sums["failed"], sums["skipped"]) == (5, 3, 2, 0)
    # again: what is there is skipped, what failed is tried again, what was changed is written again
    with open(tmp_path / "out" / rows["b.txt"].out, "a") as f:
        f.write("spoilt")
    again = told(run_batch(files(spark, src), out))
    assert {n: r.state for n, r in again.items()} == {"a.txt": "skipped", "A.md": "skipped", "b.txt": "ok", "c.txt": "failed", "d.pdf": "failed"}
    assert again["a.txt"].sha256 == rows["a.txt"].sha256 and again["b.txt"].sha256 == rows["b.txt"].sha256
    make(tmp_path / "in", c__txt="good now")
    third = told(run_batch(files(spark, src), out, errors=True))
    assert {n for n, r in third.items() if r.state == "skipped"} == {"a.txt", "A.md", "b.txt"} and third["c.txt"].state == "ok"
    assert not os.path.exists(tmp_path / "out" / f"{third['c.txt'].out}.err")


def test_deadline_gives_each_file_a_row(spark, tmp_path, slow):
    texts = {f"f{i:02d}__txt": ("slow" if i == 5 else "text") + f" {i}" for i in range(24)}
    src, out = make(tmp_path / "in", **texts), f"file://{tmp_path}/out"
    began = time.time()
    rows = told(run_batch(files(spark, src), out, deadline=30, files_a_task=3))
    assert time.time() - began < 75
    assert len(rows) == 24 and {r.state for r in rows.values()} == {"ok", "failed"} and {r.kind for r in rows.values() if r.state == "failed"} == {"timeout"}
    late = {n for n, r in rows.items() if r.kind == "timeout"}
    assert "f05.txt" in late and len(late) < 24  # the tasks that had finished are kept
    assert {r.out for r in rows.values() if r.state == "ok"} <= set(under(tmp_path / "out"))
    with open(tmp_path / "out" / REPORT) as f:
        sums = json.load(f)
    assert sums["ok_count"] + sums["failed"] == sums["total"] == 24
    make(tmp_path / "in", f05__txt="text after all")
    rest = told(run_batch(files(spark, src), out, deadline=60))
    assert {n for n, r in rest.items() if r.state == "ok"} == late and {r.state for r in rest.values()} == {"ok", "skipped"}


def test_empty_batch(spark, tmp_path):
    src, out = make(tmp_path / "in", a__txt="x"), f"file://{tmp_path}/out"
    assert run_batch(files(spark, src).where("false"), out).count() == 0
    with open(tmp_path / "out" / REPORT) as f:
        assert json.load(f)["total"] == 0


def rows_for(spark, *rows):
    return spark.createDataFrame([(p, o, True, None, None, c, "t", 0.5, 1) for p, o, c in rows], ROWS)


def test_a_task_that_dies_leaves_no_record(spark, tmp_path):
    """The second task fails after its first file: no record stands for it, and no draft is left."""
    spark.dataSource.register(Outputs)
    out = f"file://{tmp_path}/out"
    bad = rows_for(spark, ("p1", "one.md", "1"), ("p2", "two.md", "2"), ("p3", "three.md", "3"), ("p4", "four.md", "4")).repartitionByRange(2, "path")
    bad = bad.withColumn("content", F.when(F.col("path") == "p4", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("quillmill_outputs").option("path", out).option("run", "r1").mode("append").save()
    held = {r.path: r for r in records(spark, out, "r1").collect()}
    assert set(held) <= {"p1", "p2"} and not os.path.exists(f"{tmp_path}/out/_runs/r1/drafts")
    for r in held.values():
        assert os.path.getsize(tmp_path / "out" / r.out) == r.size
    rows_for(spark, ("p1", "one.md", "1"), ("p3", "three.md", "33")).write.format("quillmill_outputs").option("path", out).option("run", "r1").mode("append").save()
    assert {r.path: r.size for r in records(spark, out, "r1").collect()}["p3"] == 2


def test_names_that_leave_the_folder_are_records(spark, tmp_path):
    spark.dataSource.register(Outputs)
    out = f"file://{tmp_path}/out"
    rows_for(spark, ("p1", "../x.md", "1"), ("p2", "_runs/x.md", "2"), ("p3", "sub/x.md", "é")).write.format("quillmill_outputs").option("path", out).option("run", "r").mode("append").save()
    got = {r.path: (r.ok, r.kind, r.size) for r in records(spark, out, "r").collect()}
    assert got == {"p1": (False, "write_failed", None), "p2": (False, "write_failed", None), "p3": (True, None, 2)} and not os.path.exists(tmp_path / "x.md")
    for bad in ("/x", "..", "a/../../x", "_runs"):
        with pytest.raises(ValueError):
            checked(bad)
    with pytest.raises(Exception, match="missing|append"):
        spark.range(1).write.format("quillmill_outputs").option("path", out).option("run", "r").mode("append").save()


def test_records_come_after_their_files(tmp_path, monkeypatch):
    seen = []
    publish = OutputsWriter._publish
    monkeypatch.setattr(OutputsWriter, "_publish", staticmethod(lambda files, draft, target, body: (seen.append(target.rsplit("/", 1)[1]), publish(files, draft, target, body))))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"path": f"p{i}", "out": f"{i}.md", "ok": True, "kind": None, "message": None, "content": "x", "parser": "t", "confidence": 1.0, "elapsed_ms": 1} for i in range(3)])
    OutputsWriter(f"file://{tmp_path}", "r").write(iter([batch]))
    assert seen[:3] == ["0.md", "1.md", "2.md"] and seen[3].endswith(".jsonl") and len(seen) == 4


def test_current_opens_the_files_that_are_named(spark, tmp_path):
    import hashlib

    from quillmill.sources.sink import current

    for name, body in (("a.md", b"one"), ("b c.md", b""), ("other.md", b"x")):
        (tmp_path / name).write_bytes(body)
    named = spark.createDataFrame([("a.md", 1), ("b c.md", 2), ("gone.md", 3)], "out string, n int")
    got = {(r.n, r.out, r.now_size, r.now_sha256, r.out_mtime is not None) for r in current(named, str(tmp_path)).collect()}
    assert got == {(1, "a.md", 3, hashlib.sha256(b"one").hexdigest(), True), (2, "b c.md", 0, hashlib.sha256(b"").hexdigest(), True)}
    assert current(named, f"file://{tmp_path}")._jdf.queryExecution().toString().find("binaryFile") < 0  # no listing of the folder
    seen = current(named, str(tmp_path)).where("n = 1").first().out_mtime.timestamp()
    assert abs(seen - (tmp_path / "a.md").stat().st_mtime) < 1


def test_texts_of_a_column_are_texts_whatever_they_begin_with(spark, tmp_path):
    from quillmill.plans.catalogue import batch_run

    texts = [None, "", " \n ", "BM is a firm", "%PDF in prose", "GIF89a is old", "PK\x03\x04", "Rar! said he", "RIFFxxxxWEBPyyyy", "II*\x00abc", '{"a": 1}', "<p>x</p> a", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.path, r.out, r.state) for r in batch_run(spark, str(tmp_path)).collect())
    assert got == sorted((f"table:{i}.txt", f"table_{i}.md", "ok") for i in range(len(texts)))
