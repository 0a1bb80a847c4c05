import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm.negatives import added, best, mine, narrow, product

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    """The definition, pair by pair."""
    take = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if all(abs(x) <= 1 << 24 for x in ints):
            take.append((i, (label + 1) % 10 if i % 7 == 0 else label, ints))
    out = []
    for i, own, v in take:
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=False)), j, label) for j, label, w in take if j != i]
        same = sorted((s, j) for s, j, label in scored if label == own)[:positives]
        other = sorted((s, j) for s, j, label in scored if label != own)
        for p, j in same:
            inside = [(s, k) for s, k in other if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(inside)]
    return sorted(out)


def op(spark, rows, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % 50 == 0, label=label, **options).drop("row").collect())


def vectors(n, dim=12, seed=4):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, 0.3) for x in middle[rng.randrange(4)]], rng.choice([0, 0, 0, 1, 2, 3, 9])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"tile_anchors": 2, "tile_rows": 37, "width": 5}])
def test_equals_definition(spark, options):
    rows = vectors(400)
    want = brute(rows)
    assert len(want) > 60 and op(spark, rows, **options) == want


def test_ties_odd_rows_and_lengths(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.5] if i % 3 else [0.7, 0.2], i % 3) for i in range(1, 60)] + [(100, [1.0, 1.0], 1), (150, [0.0, 0.0], 1), (200, [-1.0, -1.0], 2), (250, [1.0], 2), (300, [], 0), (350, [1.0] * 40, 1)]
    rows += [(400, [1.0, nan], 1), (450, [1.0, inf], 1), (500, None, 1), (550, [1.0, 1.0], None), (600, [None, 1.0], 1), (650, [1e30, 1.0], 1), (None, [1.0, 1.0], 1), (700, [60_000.0, 1.0], 1)]
    assert op(spark, rows, tile_rows=20) == brute(rows)


def test_repeated_rows_each_take_part(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (1, [0.9, 0.1], 0), (2, [0.6, 0.1], 1), (2, [0.6, 0.1], 1)]
    got = op(spark, rows)
    assert len(got) == 8 and {r[:2] for r in got} == {(50, 1)} and {r[3] for r in got} == {2}  # two anchors, two positives, two negatives each


def test_empty_and_clashing_names(spark):
    rows = vectors(120)
    df = spark.createDataFrame(rows, SCHEMA)
    assert op(spark, df.where("false")) == [] and op(spark, df.where("vec_id % 50 > 0")) == []
    clash = df.withColumns({c: F.lit("x") for c in ("row", "id", "v", "anchor", "set", "block", "wanted", "score", "rank")})
    assert op(spark, clash) == brute(rows)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 1 << 20, 1 << 24):
        x, y = rng.integers(-size, size + 1, (9, 33)), rng.integers(-size, size + 1, (7, 33))
        assert product(narrow(x), narrow(y)).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for b in y] for a in x]
    assert narrow(np.array([40_000])).dtype == np.int32 and narrow(np.zeros((0, 3), np.int64)).size == 0


def test_best_takes_the_first_of_equal_scores():
    scores, allowed = np.array([[5, 7, 7, 1], [2, 2, 2, 2]]), np.array([[True, True, True, False], [False, False, True, True]])
    got = [(int(r), int(c), int(s)) for rows, columns, values in best(scores, allowed, 3) for r, c, s in zip(rows, columns, values, strict=True)]
    assert sorted(got) == [(0, 0, 5), (0, 1, 7), (0, 2, 7), (1, 2, 2), (1, 3, 2)]


def test_partial_tiles_add_up():
    import pandas as pd

    longs = lambda *x: np.array(x, np.int64).tobytes()
    part = pd.DataFrame({"chunk": [1, 0], "partial": [np.array([[1, 2]], np.int16).tobytes(), np.array([[1 << 40, 5]], np.int64).tobytes()], "kind": ["<i2", "<i8"], "ids": [b"", longs(3)], "row_ids": [b"", longs(4, 5)]})
    total, head = added(part)
    assert total.tolist() == [[(1 << 40) + 1, 7]] and head["chunk"] == 0


def test_scores_are_not_shuffled(spark):
    """What joins pairs of blocks gives the best of each, so nothing as large as anchors x rows leaves its task."""
    import io
    from contextlib import redirect_stdout

    rows = vectors(400)
    with redirect_stdout(out := io.StringIO()):
        mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, width=5, tile_anchors=2, tile_rows=37).explain()
    assert "FlatMapCoGroupsInPandas" in out.getvalue() and "FlatMapGroupsInPandas" not in out.getvalue().replace("FlatMapCoGroupsInPandas", "")
