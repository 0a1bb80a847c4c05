"""Native line differences against the standard library's, and pairs of files."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import diff


def brute(a, b, context, most):
    """The report by the definition, line by line."""
    x, y = (a or "").splitlines(), (b or "").splitlines()
    ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    out, same, added, gone, hidden = [], 0, 0, 0, 0
    for n, (tag, i, j, k, m) in enumerate(ops):
        if tag != "equal":
            added, gone = added + m - k, gone + j - i
            out += ["-" + s for s in x[i:j]] + ["+" + s for s in y[k:m]]
            continue
        same += j - i
        head, tail = context * (n > 0), context * (n < len(ops) - 1)
        if j - i <= head + tail:
            out += [" " + s for s in x[i:j]]
            continue
        hidden += j - i - head - tail
        out += [" " + s for s in x[i : i + head]] + ([diff.LEFT_OUT % (j - i - head - tail)] if 0 < n < len(ops) - 1 else []) + [" " + s for s in x[j - tail : j]]
    whole = "\n".join(out)
    ratio = round(same * 2 / (len(x) + len(y) + 1e-9), 3) if x or y else 1.0
    return ops, (len(x), len(y), added, gone, same, hidden, ratio, whole[:most], len(whole) + 1 > most if out else 1 > most, len(whole))


def edited(rng, lines, words):
    out = []
    for x in lines:
        r = rng.random()
        out += [] if r < 0.1 else [rng.choice(words)] if r < 0.2 else [x, x] if r > 0.95 else [x]
    return out


def random_pairs(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        words = [f"w{i}" for i in range(rng.choice([1, 2, 4, 12, 300]))]
        x = [rng.choice(words) for _ in range(rng.randrange(90))]
        y = edited(rng, x, words) if k % 3 else [rng.choice(words) for _ in range(rng.randrange(50))]
        yield "\n".join(x), "\n".join(y) + "\n" * (k % 2)


CASES = [("", ""), (None, "a"), (None, None), ("x\ny", "x\ny"), ("x", "x\ny"), ("a\nb", "c"), ("a\r\nb c\x0bd", "a\nb\nc\nd"), ("a b\nc d", "a b\nc  d"), ("\n\n\n", "\n\n"), ("\n".join(map(str, range(40))), "\n".join("x" if i in (9, 20) else str(i) for i in range(40)))]


@pytest.mark.parametrize(("grams", "context", "most"), [((8, 2), 3, 12_000), ((3, 2), 0, 60), ((2,), 2, 500)])
def test_equals_brute_force(spark, monkeypatch, grams, context, most):
    monkeypatch.setattr(diff, "GRAMS", grams)
    monkeypatch.setattr(diff.blocks_by_pair, "__defaults__", (grams,))
    pairs = CASES + list(random_pairs(sum(grams), 60))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, a string, b string")
    told = diff.diff(df, context=context, most=most)
    told = told.select("n", "diff", diff.opcodes(F.col("diff.blocks"), F.col("diff.lines_a"), F.col("diff.lines_b")).alias("ops"))
    got = {r.n: (r["diff"], [tuple(o) for o in r.ops]) for r in told.collect()}
    assert len(got) == len(pairs)
    for i, (a, b) in enumerate(pairs):
        ops, want = brute(a, b, context, most)
        assert got[i][1] == ops, (a, b)
        assert tuple(got[i][0])[:10] == want, (a, b)


def test_repeated_lines_are_not_joined_across_a_pair(spark):
    """A line that is half of both texts is joined only within gaps: grams of several lines find the rest first."""
    a = "\n".join(x for i in range(600) for x in (f"line {i}", ""))
    b = "\n".join(x for i in range(600) for x in ((f"line {i}" if i % 50 else f"new {i}"), ""))
    pairs = spark.createDataFrame([(1, a, b)], "pair int, a string, b string").select("pair", diff.lines_of("a").alias("a"), diff.lines_of("b").alias("b"))
    regions = pairs.select("pair", F.lit(0).alias("lo_a"), F.lit(0).alias("lo_b"), *(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"))
    assert diff._runs(regions, 8).count() == 12
    assert diff.matching_blocks(pairs).agg(F.sum("n")).first()[0] == 1199 - 12


def test_rows_columns_and_plan(spark):
    df = spark.createDataFrame([(1, "a", "b", 5, 6), (1, "a", "b", 5, 6)], "pair int, a string, b string, i int, row int")
    out = diff.diff(df)
    assert out.columns == [*df.columns, "diff"] and [(r.pair, r.i, r.row, r["diff"].additions) for r in out.collect()] == [(1, 5, 6, 1)] * 2
    assert diff.diff(df.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_preview_texts_are_not_written(spark, monkeypatch):
    """Counts and blocks are the same, from hashes of lines alone; a text is split where it is read."""
    written, kept = [], diff.checkpointed
    monkeypatch.setattr(diff, "checkpointed", lambda df, name="table": written.append((name, df.schema.simpleString())) or kept(df, name))
    pairs = CASES + list(random_pairs(5, 12))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, a string, b string")
    out = diff.diff(df, preview=False)
    assert out.columns == ["n", "diff"] and all("string" not in schema for _, schema in written)
    fields = ["lines_a", "lines_b", "additions", "deletions", "unchanged", "elided", "similarity", "blocks"]
    rows = lambda d: {r.n: tuple(r["diff"][f] for f in fields) for r in d.collect()}
    assert rows(out) == rows(diff.diff(df))
    assert diff.diff(df.select("a", "b"), preview=False).columns == ["diff"]


def test_rounds_are_split_by_rows(spark, monkeypatch):
    """Runs weigh little and cost much, so adaptive execution by bytes would put them into one task."""
    monkeypatch.setattr(diff, "RUNS_A_TASK", 5)
    written, kept = [], diff.checkpointed
    monkeypatch.setattr(diff, "checkpointed", lambda df, name="table": written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name))
    pairs = spark.createDataFrame([(i, "\n".join(f"{i} {k}" for k in range(9)), "\n".join(f"{i} {k}" for k in range(9))) for i in range(40)], "pair int, a string, b string")
    assert diff.diff(pairs.select("a", "b")).agg(F.sum("diff.unchanged")).first()[0] == 360
    assert any(name == "runs" and "RepartitionByExpression [pair" in plan and ", 8" in plan for name, plan in written)


def test_all_ends_of_lines(spark):
    texts = [f"a{end}b{end}" for end in ["\n", "\r\n", *diff.LONE]] + ["a\nb\x1cc\r\nd\re"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(diff.lines_of("t")).collect()] == [t.splitlines() for t in texts]
    assert df.select(diff.parts_of(F.lit(None).cast("string"))).first()[0] is None


def test_pairs(spark):
    f = spark.createDataFrame([("d/a.txt", 1.0), ("d/a.md", 3.0), ("d/A.html", 3.0), ("d/b.txt", 9.0)], "path string, mtime double")
    assert {(r.path_a, r.path_b) for r in diff.partners(f).collect()} == {("d/a.txt", "d/A.html"), ("d/a.md", "d/A.html"), ("d/A.html", "d/a.md")}
    with pytest.raises(ValueError):
        diff.partners(f, since=float("nan"))
