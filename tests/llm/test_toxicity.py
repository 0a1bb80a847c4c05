import itertools
import random

import numpy as np

from quillmill.llm.toxicity import Kernel, fit, op9_toxicity, score_column, score_documents, tokens_of, train

INSULTS = ["idiot", "moron", "vequmo", "vequta", "loweiei"]


def corpus(seed, n=240, share=0.25, forms=lambda w, rng: w):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < share
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), forms(rng.choice(INSULTS), rng))
        rows.append((i, " ".join(words).capitalize() + ".", int(bad)))
    return rows


def accuracy(machine, rows):
    machine.start()
    scores = machine.score([machine.decide(sorted(tokens_of(t))) for _, t, _ in rows])
    return np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, rows, strict=True)])


def test_kernel_equals_its_definition():
    k = Kernel(0.7)
    for token in ("idiot", "anana", "éé-x"):
        chars = "\0" + token
        want: dict = {}
        for size, most in ((3, 5), (4, 6)):
            for at in itertools.combinations(range(len(chars)), size):
                if at[-1] - at[0] + 1 <= most:
                    key = (size, *(chars[i] for i in at))
                    want[key] = want.get(key, 0) + 0.7 ** (at[-1] - at[0] + 1 - size)
        who, feature, weight = k.features([token])
        got: dict = {}
        for f, w in zip(feature.tolist(), weight.tolist(), strict=True):
            got[f] = got.get(f, 0) + w
        assert np.allclose(sorted(got.values()), sorted(want.values()), rtol=1e-5)
        assert np.isclose(k.norms(who, feature, weight, 1)[0], np.sqrt(sum(v * v for v in want.values())), rtol=1e-5)


def test_held_out_documents_are_told_apart():
    machine = train(*zip(*((t, y) for _, t, y in corpus(1)), strict=True))
    assert accuracy(machine, corpus(2)) >= 0.95


def test_inserted_and_spaced_letters_are_tolerated():
    machine = train(*zip(*((t, y) for _, t, y in corpus(1)), strict=True))
    put = lambda w, rng: w[:2] + rng.choice(".-*_") + w[2:]
    assert accuracy(machine, corpus(3, forms=put)) >= 0.85
    assert accuracy(machine, corpus(4, forms=lambda w, rng: " ".join(w))) >= 0.9


def test_tables(spark, docs):
    rows = corpus(5)
    d = docs(*((i, t) for i, t, _ in rows), (900, None), (901, ""), (None, "idiot moron"), (3, rows[3][1]))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, rows[5][2]), (900, 1, 0), (7777, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    machine = fit(d, labels)
    got = score_documents(d, machine).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got}
    assert by[900] == by[901] < 0.5 < by[None]
    assert np.mean([(by[i] >= 0.5) == bool(y) for i, _, y in rows]) >= 0.95
    column = {r.doc_id: r.s for r in d.select("doc_id", score_column(d, machine).alias("s")).collect()}
    assert all(abs(column[i] - by[i]) < 1e-9 for i in by)
    assert score_documents(d.limit(0), machine).count() == 0


def test_one_kind_of_label_alone_gives_its_share(spark, docs):
    d = docs((1, "a b"), (2, "c"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 1e-6 for r in score_documents(d, fit(d, none)).collect()} == {True}
    assert train(["x", "y"], [1, 1]).start().score([np.zeros(0)])[0] > 0.99


def subsequences(token, decay=0.7):
    chars, out = "\0" + token, {}
    for size, most in ((3, 5), (4, 6)):
        for at in itertools.combinations(range(len(chars)), size):
            if at[-1] - at[0] + 1 <= most:
                key = (size, *(chars[i] for i in at))
                out[key] = out.get(key, 0) + decay ** (at[-1] - at[0] + 1 - size)
    return out


def kernel(a, b):
    x, y = subsequences(a), subsequences(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_decisions_equal_the_landmarks_kernel_sum():
    """Folded weights against the sum over landmarks of coefficient times kernel, by its definition, and the score
    against its own formula."""
    machine = train(*zip(*((t, y) for _, t, y in corpus(1, 120)), strict=True), landmarks=24).start()
    words = [*INSULTS, "idi.ot", "thering", "anhaed", "zzz"]
    want = [max(0.0, sum(a * kernel(w, m) for m, a in machine.marks) + machine.bias) for w in words]
    got = machine.decide(words)
    assert len(machine.marks) > 10 and np.allclose(got, want, atol=2e-3) and got[:5].min() > 0
    d = np.sort(got)[::-1]
    z = np.dot(machine.layer, [1, d[0], d[1], np.log1p(got.sum())])
    assert np.isclose(machine.score([got])[0], 1 / (1 + np.exp(-z)))


def test_letters_of_other_scripts_are_told_apart():
    assert kernel("дурак", "дурак") == 1
    k = Kernel()
    assert len({int(k.code[ord(c)]) for c in "дурак"}) > 1 and k.code[ord("д")] != k.code[ord(".")]


def test_the_query_with_null_ids_and_clashing_names(spark, docs, tmp_path):
    rows = corpus(6, 150)
    d = docs(*((i, t) for i, t, _ in rows), (None, "idiot moron"), (None, None)).selectExpr("*", "1 AS id", "2 AS _id", "3 AS toxic", "4 AS score")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 152 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out is not None and r.predicted == (r.score >= 0.5) for r in got)
