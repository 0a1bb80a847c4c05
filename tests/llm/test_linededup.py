import random

from pyspark.sql import functions as F

from quillmill.llm.linededup import dedup_lines, op8_linededup


def hashes(spark, lines):
    """Spark's hash of each distinct line, and of each list of line hashes."""
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.xxhash64("x").alias("h")).collect()
    return {r.x: r.h for r in rows}


def brute(spark, rows, noise, reach):
    """The rule word by word: window minima over grams, first places, runs along diagonals."""
    line = {(i, t): [x.strip(" ") for x in t.split("\n")] for i, t in rows if t}
    code = hashes(spark, sorted({x for v in line.values() for x in v}))
    words = lambda x: max(1, x.count(" ") + 1)
    spans = []
    for key, v in line.items():
        s = [0]
        for x in v:
            s.append(s[-1] + words(x))
        for i in range(len(v)):
            j = i
            while j < len(v) and s[j] < s[i] + noise:
                j += 1
            if s[j] - s[i] >= noise:
                spans.append((key, i, s[i], tuple(code[x] for x in v[i:j])))
    gram = {r.g: r.h for r in spark.createDataFrame([(list(g),) for g in {x[3] for x in spans}], "g array<long>").select(F.col("g"), F.xxhash64("g").alias("h")).rdd.map(lambda r: type("R", (), {"g": tuple(r.g), "h": r.h})).collect()} if spans else {}
    marks = set()
    for key, _, s, _ in spans:
        window = [(gram[g], k) for key2, k, s2, g in spans if key2 == key and s <= s2 < s + reach]
        marks.add((key, *min(window)))
    first = {}
    for key, g, k in marks:
        first[g] = min(first.get(g, (key, k)), (key, k))
    gone = {}
    for key, g, k in marks:
        (a, q), b = first[g], line[key]
        if (a, q) == (key, k):
            continue
        same = lambda i: 0 <= i < len(b) and 0 <= i - k + q < len(line[a]) and b[i] == line[a][i - k + q]  # noqa: B023, E731
        lo = hi = k
        while same(lo - 1):
            lo -= 1
        while same(hi + 1):
            hi += 1
        gone.setdefault(key, set()).update(range(lo, hi + 1))
    return {(i, t): "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get((i, t), ())) for i, t in rows}


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else " ".join(pool[(i + k) % 40 : (i + k) % 40 + 1]) for k in range(rng.randrange(1, 25)))) for i in range(40)]


def test_equals_the_rule_by_brute_force(spark, docs):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.doc_id: r.text for r in dedup_lines(docs(*rows), noise=8, reach=8).collect()}
        assert got == {i: t for (i, _), t in brute(spark, rows, 8, 8).items()}


def test_long_passages_go_once_repeated_and_no_line_is_lost(docs):
    rng = random.Random(4)
    own = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"{own()}\n{passage}\n{own()}") for i in range(20)]
    got = {r.doc_id: r for r in dedup_lines(docs(*rows), counts=True).collect()}
    assert got[0].text == rows[0][1] and all(passage not in got[i].text and got[i].n_deleted == 1 for i in range(1, 20))
    assert {x for _, t in rows for x in t.split("\n")} == {x for r in got.values() for x in r.text.split("\n")}


def test_odd_rows(spark, docs, tmp_path):
    long = " ".join(f"p{i}" for i in range(40))
    d = docs((1, None), (2, ""), (3, long), (3, long), (4, long), (5, f"{long}\n{long}\nend"), (None, long))
    got = {(r.doc_id, r.text) for r in dedup_lines(d).collect()}
    assert got == {(1, None), (2, ""), (3, ""), (4, ""), (5, "end"), (None, long)}
    kept = dedup_lines(d, drop_empty=True)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5, None} and kept.columns == d.columns
    assert dedup_lines(d.limit(0)).count() == 0
    d.withColumn("h", F.lit(1)).withColumn("runs", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_linededup(spark, str(tmp_path)).count() == 7


def test_the_plan_has_no_python(docs):
    plan = dedup_lines(docs((1, "a b")))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_clashing_names_are_carried(spark, docs):
    names = ("_id", "_hash", "_runs", "_n", "_kept", "id", "hash", "runs", "row", "n", "kept", "hit", "run_id")
    block = "\n".join(f"line number {i} of the shared block with some more words in it" for i in range(8))
    plain = docs((1, f"a head\n{block}"), (2, f"another head\n{block}\na tail"), (3, None), (4, ""), (None, block), (2, f"another head\n{block}\na tail"))
    df = plain.withColumns({n: F.lit(777) for n in names})
    out = dedup_lines(df)
    assert out.columns == df.columns and {tuple(r[n] for n in names) for r in out.collect()} == {(777,) * len(names)}
    assert sorted(map(repr, out.select(plain.columns).collect())) == sorted(map(repr, dedup_lines(plain).collect()))
    assert {r.text for r in out.where("doc_id = 2").collect()} == {"another head\na tail"} and dedup_lines(df.where("false")).count() == 0
