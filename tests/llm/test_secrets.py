import hashlib
import random
import re

from pyspark.sql import functions as F

from quillmill.llm.secrets import classify, op4_secrets, redact, scanner


def brute(text):
    """The base rules, word for word."""
    out = []
    for k, pattern, group, least, flags in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), (1, "AKIA[A-Z0-9]+", 0, 20, 0), (2, "[0-9a-f]+", 0, 24, 0)
    ):
        out += [(k, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_brute_force():
    rng, scan = random.Random(3), scanner()
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "a1b2c3d4e5f6", "AKIA", "ABCDEFGH1234", "deadbeef" * 3, "\n", "é", "K", "ſecret"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s[:3] for s in scan(text)] == brute(text)


COPIED, OWN, SPREAD = "token=Zq81kfjw92LmxPq0", "token=hG7dk29sLmQ0vbT4", "token=pW5nc83tYaE7zuR6"


def rows():
    return [(i, f"case {i} has {COPIED} b", f"s{i % 3}") for i in range(9)] + [(30 + i, f"one text with {SPREAD} in it {i}", f"s{i}") for i in range(6)] + [(20, f"x {OWN} y", "s1"), (21, f"x {OWN} y", "s1"), (22, None), (23, ""), (24, "clean text"), (None, f"{OWN}", "s1"), (24, "clean text")]


def test_copied_values_are_examples_and_owned_ones_live(docs):
    got = {r.id: r.spans for r in classify(docs(*rows())).collect()}
    assert set(got) == {*range(9), *range(30, 36), 20, 21, None}
    assert {s.verdict for i in range(30, 36) for s in got[i]} == {"live"} and got[30][0].n_owners == 6  # copies of one text
    assert {s.verdict for i in range(9) for s in got[i]} == {"example"} and got[0][0].n_owners == 3
    assert [s.verdict for s in got[20]] == ["live"] and got[20][0].n_owners == 1


def test_redaction_keeps_rows_columns_and_clean_text(docs):
    d = docs(*rows())
    out = redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[20].text == "x token=[SECRET] y" and got[20].n_chars == len(got[20].text)
    assert got[0].text == f"case 0 has {COPIED} b" and got[24].text == "clean text" and got[22].text is None


def test_query_digests(spark, docs, tmp_path):
    docs(*rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        spans = brute(texts[r.doc_id] or "")
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in range(3))
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    assert next(r for r in got if r.doc_id == 20).spans == "assign:2:24,live:8:24"


def test_empty_table(spark, docs, tmp_path):
    docs((1, "x")).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_secrets(spark, str(tmp_path)).count() == 0


def test_clashing_names_are_carried(spark, docs):
    names = ("_id", "_hash", "_cut", "id", "hash", "cut", "row", "hit", "spans", "owner")
    plain = docs(*rows())
    df = plain.withColumns({n: F.lit(777) for n in names})
    out = redact(df)
    assert out.columns == df.columns and {tuple(r[n] for n in names) for r in out.collect()} == {(777,) * len(names)}
    assert sorted(map(repr, out.select(plain.columns).collect())) == sorted(map(repr, redact(plain).collect()))
    assert redact(df.where("false")).count() == 0 and {r.spans for r in classify(df.where("doc_id = 24")).collect()} == set()
