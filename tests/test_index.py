"""The index as a table of buckets: incremental writes, postings, commits."""

import os

import pytest
from pyspark.sql import functions as F

from quillmill.operators import index
from quillmill.sources.segments import Conflict

FIELDS = [x.rsplit(" ", 1) for x in index.SCHEMA.split(", ")]


def rows(spark, numbers, **given):
    """Index rows a0000, a0001, ...; given columns are SQL expressions over n."""
    base = {"id": "'a' || lpad(n, 4, '0')", "source_name": "'Name' || n || '.txt'", "source_path": "'/p/' || n", "sha256": "'h' || n", "status": "'completed'", "excerpt": "'Some text ' || n || ' here'", "created_at": "1000 + n", "updated_at": "1"} | given
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    return df.select(*((F.expr(base[n]) if n in base else F.lit(None)).cast(t).alias(n) for n, t in FIELDS))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def files(path):
    out = {}
    for d, _, names in os.walk(path):
        for n in names:
            with open(os.path.join(d, n), "rb") as f:
                out[os.path.join(d, n)] = f.read()
    return out


@pytest.fixture
def ix(spark, tmp_path):
    return index.ArtifactIndex(spark, f"file://{tmp_path}/ix", buckets=8, gram_buckets=8, most_segments=3)


def held(ix):
    return {r.id: r for r in ix.rows().collect()}


def test_rows_through_their_life(spark, ix, tmp_path):
    assert ix.rows().count() == 0 and ix.query().count() == 0 and not ix.upsert(rows(spark, []), 1)
    ix.upsert(rows(spark, range(6)), 50)
    ix.upsert(rows(spark, [1], sha256="null", created_at="5", status="'new'"), 60)
    r = held(ix)
    assert len(r) == 6 and (r["a0001"].status, r["a0001"].sha256, r["a0001"].created_at, r["a0001"].updated_at) == ("new", "h1", 1001, 60) and r["a0002"].updated_at == 50
    ix.delete(ids(spark, "a0001", "nobody"), 70)
    assert ix.query().where("id = 'a0001'").count() == 0 and ix.rows().count() == 6 and ix.query(q="text 1").count() == 0
    ix.undelete(ids(spark, "a0001"))
    ix.prune(spark.createDataFrame([("/p/1",)], "path string"), 80)
    assert {x.id for x in ix.rows().where("retired_at is null and deleted_at is null").collect()} == {"a0001"}
    assert [(e.generation, e.kind) for e in ix.events().orderBy("generation").collect()] == [(1, "upsert"), (2, "upsert"), (3, "delete"), (4, "undelete"), (5, "retire")]
    before = held(ix)
    ix.vacuum()
    ix.backup(f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy").count() == 6 and len(ix.files.generations()) == 1 and held(ix) == before
    assert {x.id for x in ix.search("text 3").collect()} == {"a0003"}


def test_a_batch_rewrites_its_buckets_only(spark, ix, tmp_path):
    ix.upsert(rows(spark, range(200)), 50)
    before, m = files(tmp_path), ix.files.manifest()
    ix.upsert(rows(spark, [7], status="'new'"), 60)
    after, later = files(tmp_path), ix.files.manifest()
    assert all(after[f] == before[f] for f in before)  # no file that a reader of the first generation holds has changed
    moved = {b for b in later["rows"] if later["rows"][b] != m["rows"].get(b)}
    assert len(m["rows"]) == 8 and moved == {str(b) for b in later["touched"]} and len(moved) == 1
    assert later["grams"] == m["grams"]  # the text is the same, so no posting has changed
    assert held(ix)["a0007"].status == "new" and len(held(ix)) == 200
    assert ix.get("a0007").first().status == "new" and len(ix.get("a0007").inputFiles()) == 1 and ix.get("none").count() == 0


def test_a_repeated_batch_changes_nothing(spark, ix, tmp_path):
    assert ix.upsert(rows(spark, range(20)), 50, ("w", 3))
    before = files(tmp_path)
    assert not ix.upsert(rows(spark, range(40), status="'new'"), 60, ("w", 3)) and not ix.upsert(rows(spark, range(40)), 60, ("w", 2))
    assert files(tmp_path) == before
    assert ix.upsert(rows(spark, [50]), 60, ("other", 1)) and ix.upsert(rows(spark, [51]), 60, ("w", 4)) and len(held(ix)) == 22


def test_readers_keep_their_generation_and_writers_meet(spark, ix, monkeypatch):
    ix.upsert(rows(spark, range(30)), 50)
    seen = ix.rows()
    stale = ix.files.manifest()
    ix.upsert(rows(spark, range(60), status="'new'"), 60)
    assert seen.count() == 30 and {r.status for r in seen.collect()} == {"completed"}
    monkeypatch.setattr(ix, "_now", lambda: stale)
    with pytest.raises(Conflict):
        ix.upsert(rows(spark, [99]), 70)
    monkeypatch.undo()
    assert len(held(ix)) == 60 and len(ix.files.generations()) == 2
    names = ix.files._names("manifests")
    assert not any("draft" in n for n in names)
    ix.vacuum()  # what the writer that lost has left goes
    assert len(held(ix)) == 60


def test_a_writer_lost_before_its_commit_leaves_the_index_as_it_was(spark, ix, monkeypatch):
    ix.upsert(rows(spark, range(10)), 50)
    monkeypatch.setattr(ix.files, "commit", lambda m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ix.upsert(rows(spark, range(20), status="'new'"), 60)
    monkeypatch.undo()
    assert len(held(ix)) == 10 and {r.status for r in ix.rows().collect()} == {"completed"} and ix.search("text 15").count() == 0
    ix.vacuum()
    assert ix.search("text 5").count() == 1


def test_search_equals_contains(spark, ix):
    ix.upsert(rows(spark, range(300)), 50)
    for n in range(5):  # more batches than a gram bucket keeps segments
        ix.upsert(rows(spark, range(n, 300, 7), excerpt=f"'changed {n} %_ ' || n"), 60 + n)
    ix.delete(ids(spark, "a0010"), 90)
    assert max(map(len, ix.files.manifest()["grams"].values())) <= 3
    table = ix.rows()
    for term in ("text", "TEXT 1", "changed", "changed 4", "%_ 1", "name29", "a001", "here", "0.txt", "nowhere", "xt 2"):
        want = {(r.id, r.mode) for r in index.query(table, q=term, limit=500).collect()}
        assert {(r.id, r.mode) for r in ix.search(term).collect()} == want == {(r.id, r.mode) for r in ix.query(q=term, limit=500).collect()}
    assert ix.search("text").count() > 80 and ix.query(q="me", limit=500).count() == 299


def test_search_reads_the_buckets_of_its_grams(spark, ix):
    ix.upsert(rows(spark, range(300)), 50)
    m = ix.files.manifest()
    asked = {r.b for r in spark.createDataFrame([(g,) for g in ("tex", "ext")], "gram string").select(index.bucket_of("gram", 8).alias("b")).collect()}
    read = {f.rsplit("/", 2)[1] for f in ix._postings(m, list(asked)).inputFiles()}
    assert len(m["grams"]) == 8 and read == {f"bucket={b}" for b in asked} and len(read) <= 2
    one = ix.search("Name123.txt")
    assert [r.id for r in one.collect()] == ["a0123"] and len({f for f in one.inputFiles() if "/rows-" in f}) == 1  # its bucket only


def test_postings_follow_texts(spark, ix):
    ix.upsert(rows(spark, [1], excerpt="'abcd abcd'", source_name="''"), 1)
    grams = lambda: sorted(r.gram for r in ix.postings().where("field = 0").collect())
    assert grams() == sorted({("\x1fabcd abcd")[i : i + 3] for i in range(8)})
    ix.upsert(rows(spark, [1], excerpt="'xyz'", source_name="''"), 2)
    assert grams() == sorted({"\x1fxyz"[i : i + 3] for i in range(2)})
    ix.upsert(rows(spark, [1], excerpt="null", source_name="null"), 3)
    assert grams() == [] and ix.postings().where("field = 1").count() == 3


def test_resolve_has_no_nested_loops(spark):
    table, asked = rows(spark, range(50)), spark.createDataFrame([("a0011",), ("a001",), ("NAME3.txt",), ("text 47 h",), ("xt",), ("",), (None,), ("zq",), ("a0011",)], "ref string")
    got = {r.ref: (r.id, r.how) for r in index.resolve(table, asked).collect()}
    assert got == {"a0011": ("a0011", "exact"), "a001": ("a0019", "prefix"), "NAME3.txt": ("a0003", "name"), "text 47 h": ("a0047", "content"), "xt": ("a0049", "content")}
    plan = index._holding(asked, index.live(table))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert index.resolve(table, asked.where("false")).count() == 0


def test_postings_are_lists_by_blocks_of_rows(spark, ix):
    ix.upsert(rows(spark, range(300)), 50)
    m = ix.files.manifest()
    kept = ix.files.read([s for of in m["grams"].values() for s in of], index.POSTING)
    posted = ix.postings()
    assert kept.count() < posted.count() / 4  # not a row for each gram of each text
    table = ix.rows()
    want = table.select("id", F.explode(index.grams_of(index.searched("source_name", "excerpt"))).alias("gram"))
    assert posted.where("field = 0").select("id", "gram").exceptAll(want).isEmpty() and want.exceptAll(posted.where("field = 0").select("id", "gram")).isEmpty()


def test_a_large_bucket_is_split_among_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "ROWS_A_TASK", 200)
    one = index.ArtifactIndex(spark, f"file://{tmp_path}/one", buckets=1, gram_buckets=1)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        one.upsert(rows(spark, range(2000), excerpt="repeat(sha2(cast(n as string), 256), 4)"), 50)
    finally:
        spark.conf.unset(size)
    assert len(one.rows().inputFiles()) > 1 and len(one._postings(one.files.manifest()).inputFiles()) > 1
    assert one.rows().count() == 2000 and [r.id for r in one.search("name1234.txt").collect()] == ["a1234"]


def test_grams_of_any_characters(spark, ix):
    texts = ["a\x00b\x00", "\U0001f600\U0001f601x\U0001f600", "İstanbul ΣΑΣ", "ab", "", None, "xx\x1fyy\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string")
    made = df.select(*((F.expr({"id": "'a' || n", "source_name": "'n'", "excerpt": "t", "created_at": "n", "updated_at": "1"}.get(n, "null"))).cast(t).alias(n) for n, t in FIELDS))
    ix.upsert(made, 1)
    want = made.select("id", F.explode(index.grams_of(index.searched("source_name", "excerpt"))).alias("gram")).collect()
    assert sorted(want) == sorted(ix.postings().where("field = 0").select("id", "gram").collect())


def test_resolve_finds_the_newest_text_of_every_length(spark):
    import random

    rng = random.Random(3)
    texts = {f"a{n:04d}": "".join(rng.choice("abcé\U0001f600\x00 ") for _ in range(rng.choice((0, 1, 2, 3, 30, 90)))) for n in range(200)}
    made = spark.createDataFrame([(i, t, n % 40) for n, (i, t) in enumerate(texts.items())], "id string, excerpt string, created_at long").withColumns({"source_name": F.lit("none"), "deleted_at": F.lit(None).cast("long")})
    refs = {t[at : at + n].upper() for t in texts.values() for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 40) for at in (0, 5, max(0, len(t) - n)) if t[at : at + n]} | {"zz", "abcabcabcabcabcabc" * 9}
    refs = {x for x in refs if x.lower() not in texts}
    got = {r.ref: (r.id, r.how) for r in index.resolve(made, spark.createDataFrame([(x,) for x in refs], "ref string")).collect()}
    newest = lambda x: max(((n % 40, i) for n, (i, t) in enumerate(texts.items()) if x.lower() in t), default=(0, None))[1]
    assert got == {x: (newest(x), "content") for x in refs if newest(x)}


def test_resolve_sends_no_text_for_each_ref_that_it_holds(spark):
    table, asked = rows(spark, range(300), excerpt="repeat('Some text ', 100)"), spark.createDataFrame([("text s",), ("me text",), ("no such text",)], "ref string")
    held = index._holding(asked, index.live(table)).collect()  # every text holds both; one row is enough of each
    assert {(r.ref, r.id) for r in held if r.created_at == 1299} == {("text s", "a0299"), ("me text", "a0299")} and len(held) <= 2 * 4
