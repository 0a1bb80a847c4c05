import random
from collections import Counter, defaultdict

import pandas as pd

from quillmill.llm.packing import Bins, pack, pack_shard


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    capacity, items = 50, [(rng.randrange(1, 51), rng.randrange(6), rng.randrange(30)) for _ in range(400)]
    fast, bins = Bins(capacity), []  # bins: [left, sources, clusters, items]
    for i, (size, s, c) in enumerate(items):
        b = fast.add(i, size, 1 << s, 1 << c)
        fits = [x for x in bins if x[0] >= size and s not in x[1] and c not in x[2]]
        if fits:
            tight = min(x[0] for x in fits)
            own = next(x for x in bins if x[3] == fast.bins[b][:-1])
            assert own[0] == tight and own in fits  # the tightest that is compatible
        else:
            own = [capacity, set(), set(), []]
            bins.append(own)
            assert fast.bins[b] == [i]
        own[0] -= size
        own[1].add(s)
        own[2].add(c)
        own[3].append(i)


def test_windows_hold_no_cluster_twice_and_everything_once(docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)) if i % 7 else "same words here", "hot" if i % 3 == 0 else f"s{i % 9}") for i in range(300)]
    rows += [(900, " ".join(["long"] * 230), "s1"), (901, None, None), (902, "", "s1"), (None, "null id", "s2"), (5, rows[5][1], rows[5][2])]
    got = pack(docs(*rows), capacity=50, shard_rows=120).collect()
    assert len({r.shard for r in got}) > 1
    used, texts, bits = defaultdict(int), defaultdict(list), {i: t for i, t, _ in rows}
    for r in got:
        used[r.shard, r.bin] += r.n_tokens
        if r.piece == 0:
            texts[r.shard, r.bin].append(bits[r.doc_id])
    assert all(n <= 50 for n in used.values()) and all(used[r.shard, r.bin] == r.bin_tokens for r in got)
    assert all(n == 1 for t in texts.values() for x, n in Counter(t).items() if x is not None)
    length = Counter()
    for r in got:
        length[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split()) + 1
    assert length == want
    assert sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 900) == [(0, 0, 50), (1, 50, 50), (2, 100, 50), (3, 150, 50), (4, 200, 31)]


def test_no_window_holds_a_source_or_a_cluster_twice():
    rng = random.Random(5)
    n = 1500
    rows = pd.DataFrame({"doc_id": range(n), "piece": 0, "size": [rng.randrange(1, 60) for _ in range(n)], "source": ["hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]) for _ in range(n)], "cluster": [rng.randrange(200) for _ in range(n)], "tie": range(n)})
    plain = pack_shard(rows, 100, heavy=10**9)
    assert pack_shard(rows, 100, heavy=2) == plain  # counts of hot sources change the time alone
    for col in ("source", "cluster"):
        assert max(Counter((b, v) for b, v in zip(plain[0], rows[col], strict=True) if v is not None).values()) == 1


def test_a_hot_source_fills_no_window_twice(docs):
    rows = [(i, " ".join(f"w{i}" for _ in range(9)), "hot" if i % 2 else f"s{i % 38}") for i in range(400)]
    got = pack(docs(*rows), capacity=100).collect()
    held = Counter((r.shard, r.bin) for r in got if r.doc_id % 2)
    assert max(held.values()) == 1 and len({(r.shard, r.bin) for r in got}) == 200  # as few windows as the hot source allows


def test_empty_table_and_clashing_names(docs):
    from pyspark.sql import functions as F

    d = docs((1, "a b c"))
    assert pack(d.limit(0)).count() == 0
    assert pack(d.withColumn("bits", F.lit("x")).withColumn("tokens", F.lit("y")).withColumn("shard", F.lit("z"))).first().n_tokens == 4
