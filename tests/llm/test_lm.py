import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import lm
from quillmill.llm.lm import Network, Spelling, op2_lm, score_documents, words_of

SMALL = {"pilot_docs": 60, "streams": 8, "hidden": 16, "width": 12}


def corpus(seed, n=260):
    rng = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("ka", "lo")]
    return [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randrange(5, 60)))) for i in range(n)]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts: Counter = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update(words_of(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        tokens = [*words_of(t), None]
        out[i] = (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    return out


@pytest.mark.parametrize("lookup", [10, 100_000])
def test_base_equals_its_definition_and_the_model_does_better(docs, lookup):
    rows = corpus(1) + [(900, None), (901, ""), (902, "never seen words É"), (None, "ka1 ka2")]
    got = {r.id: r for r in score_documents(docs(*rows), lookup_words=lookup, **SMALL).collect()}
    for i, (held, n, known, total, base) in brute(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 3 and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) if lookup == 10 else sum(r.score for r in held) > sum(r.base_score for r in held)


def network(seed=3):
    net = Network([[0, 1, 2], [3, 4]], 5, 2, 4, 6, seed)
    net.set_biases(np.array([5.0, 4, 3, 2, 1, 6, 2, 2]))
    return net


def test_probabilities_sum_to_one():
    net = network()
    h = np.random.default_rng(0).standard_normal((7, 6)).astype(np.float32)
    total = sum(np.exp(net.log_probs(h, np.full(7, y))) for y in range(8))
    assert np.allclose(total, 1, atol=1e-5)


def test_side_by_side_scores_equal_one_by_one():
    net, rng = network(), np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 5, n), 5) for n in (0, 30, 3, 11, 30)]
    together = net.score(docs, hold=7)
    assert np.allclose(together, [net.score([d])[0] for d in docs], atol=1e-4)


def plain_score(net, ids):
    """log P of one sequence, token by token, in plain double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    k, h, x, total = net.hidden, np.zeros(net.hidden), net.soft, 0.0
    for y in ids:
        gx, hu = p["emb"][x] @ p["wx"] + p["b"], h @ p["uh"]
        z = 1 / (1 + np.exp(-(gx[:k] + hu[:k])))
        r = 1 / (1 + np.exp(-(gx[k : 2 * k] + hu[k : 2 * k])))
        h = z * h + (1 - z) * np.tanh(gx[2 * k :] + r * hu[2 * k :])
        a = h @ p["wc"] + p["bc"]
        total += a[net.class_of[y]] - np.log(np.exp(a).sum())
        if y < net.soft:
            m = net.members[net.class_of[y]]
            a = p["wk"][m] @ h + p["bk"][m]
            total += a[net.place[y]] - np.log(np.exp(a).sum())
        x = y
    return total


def test_scores_equal_a_plain_forward_pass():
    net, rng = network(), np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 5, n), 5) for n in (0, 30, 3, 11)] + [np.array([6, 0, 7, 1, 5])]
    assert np.allclose(net.score(docs), [plain_score(net, d) for d in docs], atol=1e-4)


def test_training_follows_the_gradient():
    """One step of a net whose Adagrad memory makes it the gradient itself, against differences of the plain loss."""
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, 5, n), 5) for n in (4, 1, 5)] + [np.array([6, 2, 5])]
    y, net = np.concatenate(docs), network()
    before = {k: v.astype(np.float64) for k, v in net.p.items()}
    memory = {n: np.full(v.shape if n not in ("emb", "wk") else (len(v), 1), 1e10, np.float32) for n, v in net.p.items()}
    net.train(y, 1, len(y), 1e5, memory)
    step = {k: before[k] - net.p[k] for k in before}
    probe = network()
    for name, value in before.items():
        for at in [np.unravel_index(i, value.shape) for i in rng.choice(value.size, min(12, value.size), replace=False)]:
            loss = []
            for move in (1e-4, -1e-4):
                probe.p = {k: v.copy() for k, v in before.items()}
                probe.p[name][at] += move
                loss.append(-sum(plain_score(probe, d) for d in docs) / len(y))
            assert np.isclose(step[name][at], (loss[0] - loss[1]) / 2e-4, atol=2e-4), (name, at)


def test_training_lowers_the_loss():
    rng, net = np.random.default_rng(2), network()
    y = np.concatenate([np.append(rng.integers(0, 5, 9), 5) for _ in range(6)])
    before = -net.score(np.split(y, np.flatnonzero(y == 5)[:-1] + 1)).sum()
    for _ in range(60):
        net.train(y, 4, 5, 0.1)
    assert -net.score(np.split(y, np.flatnonzero(y == 5)[:-1] + 1)).sum() < 0.8 * before


def test_spelling_is_a_function_of_the_word():
    s = Spelling.learn([b"kaka", b"kako", b"lolo", b"loli", b"\xc3\xa9t\xc3\xa9"], 3, 1)
    words = [b"kaki", b"lola", b"x", b"kaki"]
    a = s.of(words)
    assert a[0] == a[3] and (a >= 0).all() and len(s.of([])) == 0


def test_empty_and_tiny_tables(spark, docs, tmp_path):
    d = docs((1, "a b"), (2, None))
    assert score_documents(d.limit(0), **SMALL).count() == 0
    assert score_documents(docs((10, None)), **SMALL).first().n_tokens == 1
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.n_tokens for r in op2_lm(spark, str(tmp_path)).collect()} == {3, 1}


def test_every_training_token_reaches_the_network(docs, monkeypatch):
    seen, average = [], lm.average
    monkeypatch.setattr(lm, "average", lambda *a: seen.append(average(*a)) or seen[-1])
    options = SMALL
    row = score_documents(docs(*corpus(4, 120)), **options).first()
    assert seen[0][1] == row.train_tokens


def test_training_and_scoring_read_ids_not_texts(docs, monkeypatch):
    """Words are split for the counts and for the ids, not once more for each use of the network."""
    plans, durable = {}, lm.durable

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return durable(df, name)

    monkeypatch.setattr(lm, "durable", kept)
    assert score_documents(docs(*corpus(4, 60)), **SMALL).count() == 60
    assert "text" in plans["counts"] and "text" in plans["ids"]
    assert "text" not in plans["weights"] and "text" not in plans["scores"]


def test_softmax_beyond_the_range_of_float32():
    a = np.array([[300.0, 299, 0], [-300, -301, -400], [1, 2, 3]], np.float32)
    ex, sums, logs = lm.softmax(a.copy, np.array([1, 0, 2]))
    want = a.astype(np.float64) - np.logaddexp.reduce(a.astype(np.float64), axis=1)[:, None]
    assert np.allclose(logs, want[[0, 1, 2], [1, 0, 2]], atol=1e-5) and np.allclose(ex / sums[:, None], np.exp(want), atol=1e-6)


def test_clashing_columns_change_nothing(docs):
    d = docs(*corpus(4, 60))
    clash = d.selectExpr("*", "1 AS id", "'x' AS hash", "2 AS h", "true AS held_out", "3 AS word", "4 AS c")
    assert sorted(score_documents(clash, **SMALL).collect()) == sorted(score_documents(d, **SMALL).collect())


def test_words_by_arrow_equal_words_of():
    rng, signs = random.Random(6), " \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0\x00abABÉéİΣ𝒳"
    texts = [None, "", " ", *("".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(500))]
    for at in (0, 7):
        words, n = lm.split(pa.array(texts, pa.string())[at:])
        assert words.to_pylist() == [w for t in texts[at:] for w in words_of(t)] and n.tolist() == [len(words_of(t)) for t in texts[at:]]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    assert [t for part in lm.pieces(batch, batch.column(0)) for t in part.column(0).to_pylist()] == texts


def test_spelling_does_not_depend_on_the_word_behind():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 4, 60, 5000]))).encode() for _ in range(400)]
    s = Spelling(np.random.default_rng(7).standard_normal((lm.TRIGRAMS, 16)).astype(np.float32))
    assert s.of(words).tolist() == [int(s.of([w])[0]) for w in words]


def test_sums_by_id():
    rng = np.random.default_rng(8)
    ids, values = rng.integers(0, 40, 90), rng.standard_normal((90, 5)).astype(np.float32)
    want = np.zeros((40, 5))
    np.add.at(want, ids, values)
    rows, sums = lm.sums_by_id(ids, values, 40)
    assert rows.tolist() == sorted(set(ids.tolist())) and np.allclose(sums, want[rows], atol=1e-5)


def test_documents_that_share_a_lane_are_scored_apart(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 3)
    net, rng = network(), np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 5, n), 5) for n in (0, 30, 3, 11, 30, 1, 0, 90)]
    assert np.allclose(net.score(docs, hold=7), [plain_score(net, d) for d in docs], atol=1e-4) and len(net.score([])) == 0


def test_repeated_rows_are_told_apart_without_a_shuffle_of_their_words(docs, monkeypatch):
    plans, durable = {}, lm.durable

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return durable(df, name)

    monkeypatch.setattr(lm, "durable", kept)
    rows = corpus(1, 60) * 2 + [(None, "ka1 rare"), (None, "ka1 rare")]
    held, counts = brute(rows), Counter()
    for i, t in rows:
        if not held[i][0]:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    got = score_documents(docs(*rows), lookup_words=10, **SMALL).collect()
    assert len(got) == len(rows) and plans["tails"].count("Aggregate") == 1
    for r in got:
        tokens = [*words_of(dict(rows)[r.id]), None]
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
