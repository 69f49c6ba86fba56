"""Problem 3: neighbours against brute force."""

import numpy as np
import pytest

from orrery.llm import neighbours as nb


def _table(spark, vectors, extra=()):
    rows = [(int(i), "m_D8", [float(v) for v in x], "clash") for i, x in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "item_idx long, embedding_name string, features array<float>, leaf string")


def _brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 8))
    return (centres[rng.integers(0, 30, 1500)] + 0.25 * rng.standard_normal((1500, 8))).astype(np.float32)


def test_single_part_is_exact(spark, vectors):
    got = nb.nearest(_table(spark, vectors[:200]), "embedding_name", "item_idx", "features", 5).collect()
    _, want = _brute(vectors[:200].astype(float), 5)
    for i in range(200):
        assert [r["other"] for r in sorted((r for r in got if r["item"] == i), key=lambda r: r["rank"])] == want[i].tolist()


def test_routed_recall(spark, vectors):
    got = nb.nearest(_table(spark, vectors), "embedding_name", "item_idx", "features", 10, target=150, split_above=400, fit_rows=1000).collect()
    _, want = _brute(vectors.astype(float), 10)
    mine = {}
    for r in got:
        mine.setdefault(r["item"], set()).add(r["other"])
    assert all(len(v) <= 10 for v in mine.values())
    assert np.mean([len(mine.get(i, set()) & set(want[i].tolist())) / 10 for i in range(len(vectors))]) >= 0.9


def test_grid_of_units_loses_nothing(spark, vectors):
    args = ("embedding_name", "item_idx", "features", 10, 0.95)
    pairs = lambda df: {tuple(r) for r in nb.similar_pairs(df).collect()}
    whole = pairs(nb.nearest(_table(spark, vectors), *args, split_above=10**6))
    assert whole == pairs(nb.nearest(_table(spark, vectors), *args, target=40, split_above=30, depth=1, probes=50, fit_rows=1500))


def test_dirty_rows_take_no_part(spark):
    good = np.eye(8)[:3] + 0.5
    bad = [(10, "m_D8", None, ""), (11, "m_D8", [], ""), (12, "m_D8", [1.0] * 7, ""), (13, "m_D8", [0.0] * 8, ""), (14, "m_D8", [float("nan")] + [1.0] * 7, ""), (15, "m_D8", [float("inf")] + [1.0] * 7, ""), (16, "m_D8", [None] + [1.0] * 7, ""), (None, "m_D8", [1.0] * 8, ""), (17, None, [1.0] * 8, ""), (18, "none", [1.0] * 8, "")]
    twice = [(0, "m_D8", [float(v) for v in np.float32(good[0])], "again")] * 3
    scaled = [(20, "m_D8", [float(v) * 1e30 for v in good[1]], "")]
    got = nb.nearest(_table(spark, good, bad + twice + scaled), "embedding_name", "item_idx", "features", 10).collect()
    assert {(r["item"], r["other"]) for r in got} == {(a, b) for a in (0, 1, 2, 20) for b in (0, 1, 2, 20) if a != b}
    assert max(r["cosine"] for r in got if {r["item"], r["other"]} == {1, 20}) == pytest.approx(1)


def test_ties_and_empty(spark):
    same = np.ones((15, 8))
    got = nb.nearest(_table(spark, same), "embedding_name", "item_idx", "features", 10).collect()
    for i in range(15):
        assert sorted(r["other"] for r in got if r["item"] == i) == [j for j in range(15) if j != i][:10]
    empty = spark.createDataFrame([], "item_idx long, embedding_name string, features array<float>")
    assert nb.nearest(empty, "embedding_name", "item_idx", "features").count() == 0


@pytest.mark.parametrize("least", [None, 0.9])
def test_large_groups_of_equal_vectors(spark, vectors, least):
    x = np.concatenate([np.tile(vectors[:1], (400, 1)), vectors[:300], np.tile(vectors[1:2] * 4, (60, 1))])
    got = nb.nearest(_table(spark, x, [(5, "m_D8", [float(v) for v in x[5]], "again")]), "embedding_name", "item_idx", "features", 10, least, target=100, split_above=150, probes=6).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["item"], []).append((r["rank"], r["other"]))
    ones = [*range(400), 400]
    for i in ones:
        assert [o for _, o in sorted(mine[i])] == [j for j in ones if j != i][:10]
    twos = [401, *range(700, 760)]
    s, _ = _brute(x.astype(float), 10)
    for i in (401, 700, 711, 759):
        assert {o for _, o in mine[i]} == set([j for j in twos if j != i][:10])
    near_one = [i for i in range(402, 700) if (s[i] > s[i, 0] + 1e-6).sum() == 0 and s[i, 0] > 0.9]
    for i in near_one:
        assert [o for _, o in sorted(mine[i])] == list(range(10))


@pytest.mark.parametrize("least", [None, 0.9])
@pytest.mark.parametrize("spread", [1e-3, 3e-4])
def test_near_copies(spark, spread, least):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((50, 64)), rng.standard_normal(64) + spread * rng.standard_normal((200, 64))]).astype(np.float32)
    rows = [(int(i), "m_D64", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "item_idx long, embedding_name string, features array<float>")
    got = {(r["item"], r["rank"]): r["other"] for r in nb.nearest(df, "embedding_name", "item_idx", "features", 10, least).collect()}
    _, want = _brute(x.astype(np.float64), 10)
    assert [[got[i, r + 1] for r in range(10)] for i in range(50, 250)] == want[50:].tolist()


def test_hashes(vectors):
    h = nb.vector_hashes(vectors)
    assert len(set(h.tolist())) == len(np.unique(vectors, axis=0)) and (nb.vector_hashes(vectors[::-1]) == h[::-1]).all()


def test_balanced_parts(vectors):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = nb.graph(x)
    labels = nb.balanced_parts(x, near, 7)
    sizes = np.bincount(labels, minlength=7)
    assert sizes.max() <= 1.1 * len(x) / 7 + 1
    start = np.zeros(len(x), np.int64)
    nb._halved(x, 7, start, np.arange(len(x)), 0)
    cut = lambda v: (v[near] != v[:, None]).mean()
    assert cut(labels) < cut(start)


def test_evaluated(spark):
    v = spark.createDataFrame([("a",), ("b",), (None,)], "embedding_name string")
    e = spark.createDataFrame([("a",), ("a",), (None,)], "embedding_name string")
    assert [r[0] for r in nb.evaluated(v, e).collect()] == [r[0] for r in nb.evaluated(v, e, few=0).collect()] == ["a"]


@pytest.mark.parametrize("least", [None, 0.9])
def test_sixty_near_copies_in_many_parts(spark, vectors, least):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((900, 64))
    x = np.concatenate([base, base[0] + 3e-4 * rng.standard_normal((60, 64))]).astype(np.float32)
    rows = [(int(i), "m_D64", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "item_idx long, embedding_name string, features array<float>")
    got = {}
    for r in nb.nearest(df, "embedding_name", "item_idx", "features", 10, least, target=100, split_above=200, fit_rows=800).collect():
        got.setdefault(r["item"], set()).add(r["other"])
    _, want = _brute(x.astype(np.float64), 10)
    assert np.mean([len(got[i] & set(want[i].tolist())) / 10 for i in range(900, 960)]) >= 0.95


def test_exact_neighbours(spark, vectors):
    again = [(100, "m_D8", [float(v) for v in vectors[100]], "again"), (7, "m_D8", [float(v) for v in vectors[7]], "again")]
    for block in (1 << 20, 500):
        found = nb.exact_nearest(_table(spark, vectors, again), "embedding_name", "item_idx", "features", block_bytes=block).collect()
        _, want = _brute(vectors.astype(float), 10)
        mine = {}
        for r in found:
            mine.setdefault(r["item"], []).append((r["rank"], r["other"]))
        assert mine.keys() == set(range(0, 1500, 100))
        assert all([o for _, o in sorted(v)] == want[i].tolist() for i, v in mine.items())
    assert nb.exact_nearest(_table(spark, vectors).limit(0), "embedding_name", "item_idx", "features").count() == 0
