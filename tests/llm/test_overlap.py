"""Problem 4: overlaps against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import overlap as ov


def _rows(profiles, **more):
    return [(u, i, *more.values()) for u, items in profiles.items() for i in items]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    pick = lambda n: set((60 * rng.random(n) ** 2).astype(int).tolist())
    train = {u: pick(int(rng.integers(2, 14))) for u in range(120)}
    train[500] = set(train[3])
    held = {("test", u): pick(9) for u in range(200, 230)} | {("val", u): set(list(train[u])[:1]) for u in range(0, 30, 3)}
    for j, u in enumerate(range(230, 290)):
        own = set(train[j]) - set(list(train[j])[: j % 3]) | ({70 + j} if j % 2 else set())
        held["test" if j % 2 else "val", u] = own
        train[j] = set(train[j])
    held["val", 300] = set(train[3])
    held["test", 1] = set(train[2]) - train[1]
    t = spark.createDataFrame([(u, i, "s", 1) for u, i in _rows(train)] * 2 + [(None, 1, "s", 1), (1, None, "s", 1)], "user_idx long, item_idx long, source string, n long")
    h = spark.createDataFrame([(s, u, i, f"src{u % 2}") for (s, u), items in held.items() for i in items] * 2 + [("val", None, 1, "x"), ("val", 3, None, "x"), (None, 3, 1, "x")], "split string, user_idx long, item_idx long, source string")
    return train, held, t, h


def test_against_brute_force(data):
    train, held, t, h = data
    want = set()
    for (split, u), b in held.items():
        for v, a in train.items():
            same = v == u and a & b
            near = v < u and len(a) >= 6 and len(b) >= 6 and len(a & b) * 10 >= 7 * len(a | b)
            if same or near:
                want.add((split, f"src{u % 2}", v, u))
    got = [tuple(r)[:4] for r in ov.split_overlaps(t, h).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"list_rows": 3}, {"carry": 8}, {"list_rows": 2, "carry": 5, "broadcast_bytes": 0}])
@pytest.mark.parametrize("jaccard", [0.7, 0.5])
def test_similar_sets(spark, options, jaccard):
    rng = np.random.default_rng(5)
    sets = [sorted(set((40 * rng.random(int(rng.integers(1, 12))) ** 2).astype(int).tolist())) for _ in range(160)]
    sets += [s + [90 + i] for i, s in enumerate(sets[:25])] + [s[1:] for s in sets[20:50] if len(s) > 1]
    a, b = sets[:100] + sets[:3], sets[70:]
    rows = [(s, i, t) for s, part in ((None, a), ("x", b)) for i, t in enumerate(part)]
    df = spark.createDataFrame(rows, "split string, user_idx long, terms array<long>").withColumn("n", F.size("terms").cast("long"))
    keys = {r["key"]: tuple(r["terms"]) for r in df.select(F.xxhash64("terms").alias("key"), "terms").collect()}
    found = [(keys[r["key_a"]], keys[r["key_b"]]) for r in ov.similar_sets(df, jaccard, **options).collect()]
    want = {(tuple(x), tuple(y)) for x in a for y in b if len(set(x) & set(y)) >= jaccard * len(set(x) | set(y)) - 1e-9}
    exact = {p for p in found if len(set(p[0]) & set(p[1])) >= jaccard * len(set(p[0]) | set(p[1])) - 1e-9}
    assert len(found) == len(set(found)) and exact == want and len(want) > 60
    assert "carry" in options or set(found) == want


def test_least_cosine_is_a_bound():
    rng = np.random.default_rng(2)
    w2 = ov.squared_weights(1000, rng.integers(1, 1000, 60))
    for _ in range(2000):
        x = rng.choice(60, int(rng.integers(1, 12)), replace=False)
        y = np.unique(np.r_[rng.choice(x, int(rng.integers(1, len(x) + 1)), replace=False), rng.choice(60, int(rng.integers(0, 3)))])
        both = np.intersect1d(x, y)
        if len(both) < 0.7 * len(np.union1d(x, y)):
            continue
        cos = w2[both].sum() / np.sqrt(w2[x].sum() * w2[y].sum())
        for s in (x, y):
            upto = np.cumsum(np.sort(w2[s]))
            assert cos >= ov.least_cosines(upto, np.array([0]), np.array([len(s)]), 0.7)[0] - 1e-9


def test_report_and_empty(spark, data):
    _, _, t, h = data
    copies = [(u, i, "s", 1) for u in range(600, 640) for i in (71, 72, 73, 74, 75, 76)]
    t = t.unionByName(spark.createDataFrame(copies, t.schema))
    h = h.unionByName(spark.createDataFrame([("val", u, i, f"src{u % 2}") for u in range(590, 660, 2) for i in (71, 72, 73, 74, 75, 76)] + [("test", 650, i, None) for i in (71, 72, 73, 74, 75, 76, 77)], h.schema))
    want = {}
    for r in ov.split_overlaps(t, h).collect():
        n, users, trains = want.setdefault((r["split"], r["source"], r["kind"]), ([], set(), set()))
        n.append(1)
        users.add(r["user_idx"])
        trains.add(r["train_user_idx"])
    got = {(r["split"], r["source"], r["kind"]): (r["n_cases"], r["n_users"], r["n_train_users"]) for r in ov.overlap_report(t, h).collect()}
    assert got == {k: (len(n), len(u), len(v)) for k, (n, u, v) in want.items()} and got["val", "src0", "near"][0] > 500
    for x, y in ((t.limit(0), h), (t, h.limit(0))):
        assert ov.split_overlaps(x, y).count() == ov.overlap_report(x, y).count() == 0
