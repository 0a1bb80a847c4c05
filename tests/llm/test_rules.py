import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmill.llm import rules
from quillmill.llm.rules import RULES, STOP_WORDS, Rule, judge, keep_good

SPACE = r"[\x20\x09-\x0D]+"


def brute(text):
    """The measures by their definitions."""
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    forms = {f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_exclaims": text.count("!"), "n_stop_words": sum(w in forms for w in words),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_bullets": sum(x.lstrip(" ")[:1] in ("-", "*", "•") and x.lstrip(" ") != "" for x in lines),
        "n_ellipses": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), "n_repeat_words": len(places),
    }


def texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "Der", "é", "x", "word", "stone…", "river...", "- item", "*", "#a", "cat!", "\x0b", "\t", "\n", "\n\n", "  ", "𝒳y", "\x00", " "]
    return [None, "", " \n\t", "one", "one two", "one two three", "a a a a a", "a b c a b c", "x " * 5000, "\n".join(["the same line of words"] * 40)] + [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(150)]


def check(row, text):
    want = brute(text)
    assert {k: row[k] for k in want} == want
    failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
    broken = [r.name for r in RULES if (r.least is not None and 100 * want[r.part] < r.least * want[r.whole]) or (r.most is not None and 100 * want[r.part] > r.most * want[r.whole])]
    assert (row.base_failed, row.broken, row.kept) == (failed, ",".join(broken), not failed and not broken)


def test_measures_and_verdicts_equal_definitions(spark, docs):
    every = texts()
    got = {r.id: r for r in judge(docs(*enumerate(every))).collect()}
    assert len(got) == len(every)
    for i, text in enumerate(every):
        check(got[i], text)


def test_colliding_hashes_are_told_apart(spark, docs, monkeypatch):
    """With 60 of 64 bits for places, windows share hashes all the time: the exact way takes over."""
    monkeypatch.setattr(rules, "PLACE_BITS", 60)
    every = texts()[:60]
    got = {r.id: r.n_repeat_words for r in judge(docs(*enumerate(every))).collect()}
    assert got == {i: brute(t)["n_repeat_words"] for i, t in enumerate(every)}


def test_one_projection_without_user_functions(spark, docs):
    plan = judge(docs((1, "a b c")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "Generate" not in plan and plan.count("split(") == 2


GOOD = " ".join(f"river{i} ran{i} to a stone{i} and was of mill{i} as it{i} is{i}" for i in range(8))


def test_rows_and_columns(spark):
    rows = [(None, GOOD, 1, 2), (3, None, 1, 2), (4, "", 1, 2), (5, GOOD, 7, 8), (5, GOOD, 7, 8), (6, GOOD * 2000, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m long, kept long")
    out = judge(df).collect()
    assert sorted((r.id or 0, r.kept) for r in out) == [(0, True), (3, False), (4, False), (5, True), (5, True), (6, False)]
    kept = keep_good(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.m, r.kept) for r in kept.collect()) == [(0, 1, 2), (5, 7, 8), (5, 7, 8)]
    assert judge(df.where("false")).count() == 0 and keep_good(df.where("false")).columns == df.columns
    clash = df.withColumnRenamed("m", "id").withColumn("n_words", F.lit("mine"))
    assert {r.n_words for r in keep_good(clash).collect()} == {"mine"}


def test_table_decides(spark, docs):
    rules_of = lambda *r: [x.kept for x in judge(docs((1, GOOD)), r).collect()][0]
    assert rules_of() and not rules_of(Rule("none", "n_stop_words", "n_words", 99, None)) and rules_of(Rule("both", "word_chars", "n_words", 100, 900))
    assert rules_of(Rule("share of nothing", "n_symbols", "n_bullets", 5, 10))
