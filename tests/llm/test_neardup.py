import numpy as np
import pytest

from quillmill.llm.neardup import MOST_TABLES, choose_rotations, learn_rotations, near_duplicates, table_keys, unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=300, dim=32, groups=12, size=9):
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((n, dim)))
    for _ in range(groups):
        base = rng.standard_normal(dim)
        rows += [base + 0.18 * rng.standard_normal(dim) for _ in range(size)]
    return np.array(rows, np.float32)


def brute(x, threshold=0.9):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.where(link | np.eye(len(x), dtype=bool), root[None, :], len(x)).min(1)
        if (new == root).all():
            return link.sum(1), root
        root = new


def test_links_are_found_and_none_is_made_up(spark):
    x = vectors(1)
    x[50] = x[60] = x[70]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    n, root = brute(x)
    for options in ({}, {"block": 4}):
        got = near_duplicates(df, **options).toPandas().sort_values("id")
        assert (got.n_links.to_numpy() <= n).all()
        assert got.n_links.sum() >= 0.9 * n.sum()
        assert (got.component_id.to_numpy() == root).mean() >= 0.95
        assert (got.kept == (got.id == got.component_id)).all()
    assert got.n_links[50] == n[50] >= 2


def test_blocks_do_not_change_counts(spark):
    x = vectors(2)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    a, b = (near_duplicates(df, block=k).toPandas().sort_values("id") for k in (3, 1000))
    assert (a.n_links.to_numpy() == b.n_links.to_numpy()).all() and (a.component_id.to_numpy() == b.component_id.to_numpy()).all()


def test_odd_vectors_link_with_nothing(spark):
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 3]
    good = [[1.0] * 8, [1.0] * 8, [2.0] * 8] + [list(map(float, np.eye(8)[i])) for i in range(4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(odd + good)], SCHEMA)
    got = {r.id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert all(got[i] == (0, i) for i in range(7))
    assert all(got[i] == (2, 7) for i in (7, 8, 9))
    assert near_duplicates(df.limit(0)).count() == 0 and near_duplicates(df.where("vec_id = 2")).first().n_links == 0


def test_rotations_are_orthogonal_and_keys_in_range():
    x = vectors(3)
    mean, turned = learn_rotations(x.astype(float), 2)
    for r in turned:
        assert np.allclose(r.T @ r, np.eye(32), atol=1e-8)
    keys = table_keys(x.astype(float), mean, turned, 8)
    assert keys.shape == (len(x), 8) and keys.min() >= 0 and keys.max() < 256


def at_cosine(rng, a, cosine):
    """Vectors at this cosine from the unit vectors a."""
    move = rng.standard_normal(a.shape)
    move -= (move * a).sum(1, keepdims=True) * a
    return cosine * a + np.sqrt(1 - cosine**2) * move / np.linalg.norm(move, axis=1, keepdims=True)


@pytest.mark.parametrize("bits", [8, 14, 17, 20, 24])
def test_recall_at_the_threshold_does_not_fall_with_longer_keys(bits):
    rng = np.random.default_rng(4)
    a = unit_rows(rng.standard_normal((3000, 64)))
    b = at_cosine(rng, a, 0.9)
    for shorten in (True, False):
        mean, turned, k = choose_rotations(a[:1500], 0.9, bits, shorten)
        assert k == bits or shorten
        keys = [table_keys(x[1500:], mean, turned, k) for x in (a, b)]
        assert (keys[0] == keys[1]).any(1).mean() >= 0.9
        assert not shorten or keys[0].shape[1] <= max(MOST_TABLES, 4 * (64 // k))


@pytest.mark.parametrize("bits", [17, 20])
def test_links_near_the_threshold_are_found_with_the_keys_of_a_large_table(spark, bits):
    rng = np.random.default_rng(5)
    a = unit_rows(rng.standard_normal((400, 64)))
    x = np.concatenate([a, at_cosine(rng, a, 0.905)]).astype(np.float32)
    n, _ = brute(x)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = near_duplicates(df, key_bits=bits).toPandas().sort_values("id")
    assert n.sum() == 800 and (got.n_links.to_numpy() <= n).all() and got.n_links.sum() >= 0.9 * n.sum()


def test_null_ids_other_dimensions_and_clashing_names(spark):
    rng = np.random.default_rng(6)
    far = rng.standard_normal((300, 16))
    long, short = rng.standard_normal((6, 40)), rng.standard_normal((6, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(far)]
    for at, some in ((1000, long), (2000, short)):
        rows += [(at + i, v.tolist()) for i, v in enumerate(some)] + [(at + 500 + i, (v + 0.01).tolist()) for i, v in enumerate(some)]
    rows += [(3000, [3.0] * 16), (None, [3.001] + [3.0] * 15), (None, [-1.0] * 8 + [1.0] * 8), (None, [-1.0] * 8 + [1.0] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 AS id", "2 AS hash", "3 AS vector", "4 AS key", "5 AS t", "6 AS root")
    got = near_duplicates(df).collect()
    by = {r.id: (r.n_links, r.component_id) for r in got if r.id is not None}
    assert all(by[at + 500 + i] == (1, at + i) for at in (1000, 2000) for i in range(6)) and by[3000] == (1, 3000)
    assert sorted(((r.n_links, r.component_id, r.kept) for r in got if r.id is None), key=repr) == sorted([(1, 3000, None), (1, None, None), (1, None, None)], key=repr)
