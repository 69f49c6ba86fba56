"""Rankings and metrics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators import ranking, splits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 80), rng.integers(0, 30, 80))}
    held = {(int(u), int(i)) for u, i in zip(rng.integers(0, 14, 30), rng.integers(0, 30, 30))}
    score = rng.integers(0, 4, 30)
    items = spark.createDataFrame([(i, float(s)) for i, s in enumerate(score)], "item_idx long, score double")
    pair = lambda rows: spark.createDataFrame(list(rows) + list(rows)[:3] + [(None, 1)], "user_idx long, item_idx long")
    return seen, held, score, items, pair(seen), pair(held)


def _brute(seen, held, scores, keys):
    out = {}
    for u, h in held:
        if (u, h) in seen:
            continue
        cand = [i for i in range(len(keys)) if (u, i) not in seen]
        s = scores(u)
        rank = 1 + sum(s[i] > s[h] or (s[i] == s[h] and keys[i] < keys[h]) for i in cand)
        out[u, h] = (rank, len(cand), sum(s[i] == s[h] for i in cand))
    return out


def _got(df):
    return {(r["user_idx"], r["item_idx"]): (r["rank"], r["n_candidates"], r["tie_block_size"]) for r in df.collect()}


def _keys(spark, n):
    return {r[0]: r[1] for r in ranking.tie_keys(spark.range(n).withColumnRenamed("id", "item_idx")).collect()}


def test_rank_by_correction(spark, data):
    seen, held, score, items, s, h = data
    order = ranking.global_order(items, ranking.tie_keys(items))
    assert _got(ranking.rank_by_correction(order, s, h)) == _brute(seen, held, lambda u: score, _keys(spark, 30))
    assert _got(ranking.rank_by_correction(order, s.repartition(5), h.repartition(3))) == _got(ranking.rank_by_correction(order, s, h))


def test_top_lists(spark, data):
    seen, held, score, items, s, h = data
    order = ranking.global_order(items, ranking.tie_keys(items))
    keys = _keys(spark, 30)
    got = {}
    for r in ranking.top_by_correction(order, s, h.dropna(), 5).collect():
        got.setdefault(r["user_idx"], {})[r["place"]] = r["item_idx"]
    for u in {u for u, _ in held}:
        want = sorted((i for i in range(30) if (u, i) not in seen), key=lambda i: (-score[i], keys[i]))[:5]
        assert [got[u][p] for p in range(1, 6)] == want


@pytest.mark.parametrize("block_bytes", [64 << 20, 400])
def test_dot_ranking(spark, data, block_bytes):
    seen, held, _, _, s, h = data
    rng = np.random.default_rng(2)
    x, u = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (14, 4)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_idx long, vector array<double>")
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "user_idx long, vector array<double>")
    got = ranking.dot_ranking(users, items, ranking.tie_keys(items), s, h, block_bytes=block_bytes)
    assert _got(got) == _brute(seen, held, lambda v: x @ u[v], _keys(spark, 30))


def test_permutation_keys(spark):
    got = [r[1] for r in ranking.permutation_keys(spark, 10, 3).orderBy("item_idx").collect()]
    assert got == np.random.default_rng(3).permutation(10).tolist()


def test_sampled(spark, data):
    seen, held, score, items, s, h = data
    scores = items.join(ranking.tie_keys(items), "item_idx")
    every = _got(ranking.sampled_ranking(scores, s, h, 1000))
    full = _brute(seen, held, lambda u: score, _keys(spark, 30))
    mine = {u: {i for v, i in held if v == u and (u, i) not in seen} for u, _ in held}
    assert set(every) == set(full)
    for (u, i), (rank, n, _) in every.items():
        assert n == full[u, i][1] - len(mine[u]) + 1 and 1 <= rank <= full[u, i][0]
    some = _got(ranking.sampled_ranking(scores, s, h, 5))
    assert all(n == 6 for _, n, _ in some.values())
    assert some == _got(ranking.sampled_ranking(scores, s.repartition(3), h, 5))


def test_negative_pool(spark, data):
    seen, held, _, _, s, h = data
    for n in (1, 5, 100):
        pool = {}
        for r in ranking.negative_pool(h, s, 30, n).collect():
            pool.setdefault(r["user_idx"], []).append(r["item_idx"])
        assert pool.keys() == {u for u, _ in held}
        for u, items in pool.items():
            free = set(range(30)) - {i for v, i in seen if v == u}
            assert len(items) == len(set(items)) == min(n, len(free)) and set(items) <= free
    assert ranking.negative_pool(h.limit(0), s, 30, 5).count() == 0
    full = spark.createDataFrame([(1, i) for i in range(30)], "user_idx long, item_idx long")
    assert ranking.negative_pool(full, full, 30, 5).count() == 0


def test_user_negatives_with_half_of_the_rows_on_one_user_and_item(spark):
    rng = np.random.default_rng(4)
    pairs = [(0, i) for i in range(400)] + [(u, 7) for u in range(1, 400)] + [(int(u), int(i)) for u, i in zip(rng.integers(1, 50, 300), rng.integers(0, 500, 300))]
    df = spark.createDataFrame(pairs * 2 + [(None, 1), (1, None), (3, 900)], "user_idx long, item_idx long")
    rows = [tuple(r) for r in ranking.user_negatives(df, 500).collect()]
    assert sorted(r[:2] for r in rows) == sorted(set(pairs)) and not {(u, n) for u, _, n in rows} & set(pairs) and all(0 <= n < 500 for *_, n in rows)
    assert sorted(rows) == sorted(tuple(r) for r in ranking.user_negatives(df.repartition(3), 500).collect())
    assert {n for u, _, n in rows if u == 0} <= set(range(400, 500)) and len({n for u, _, n in rows if u == 0}) > 60
    assert ranking.user_negatives(spark.createDataFrame([(0, i) for i in range(5)], "user_idx long, item_idx long"), 5).count() == 0


def test_correction_with_half_of_the_rows_on_one_user_and_item(spark):
    rng = np.random.default_rng(6)
    seen = {(0, i) for i in range(300)} | {(u, 5) for u in range(1, 300)} | {(int(u), int(i)) for u, i in zip(rng.integers(1, 300, 200), rng.integers(0, 400, 200))}
    held = {(u, int(i)) for u, i in zip(range(300), rng.integers(300, 400, 300))}
    score = np.where(np.arange(400) < 20, np.arange(400), 0)
    items = spark.createDataFrame([(i, float(v)) for i, v in enumerate(score)], "item_idx long, score double")
    order = ranking.global_order(items, ranking.tie_keys(items))
    pair = lambda rows: spark.createDataFrame(list(rows), "user_idx long, item_idx long")
    assert _got(ranking.rank_by_correction(order, pair(seen), pair(held))) == _brute(seen, held, lambda u: score, _keys(spark, 400))


def test_top_lists_of_both_rankings(spark, data):
    seen, held, _, _, s, h = data
    x, u = np.random.default_rng(2).integers(-2, 3, (30, 4)).astype(float), np.random.default_rng(3).integers(-2, 3, (14, 4)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_idx long, vector array<double>")
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "user_idx long, vector array<double>")
    keys, own = ranking.tie_keys(items), _keys(spark, 30)
    flat = lambda df: {(r["user_idx"], r["item_idx"]): tuple(r[c] if c != "top_items" else tuple(r[c]) for c in ("rank", "n_candidates", "tie_block_size", "top_items")) for r in df.collect()}
    one = flat(ranking.dot_ranking(users, items, keys, s, h, top=6))
    assert one == flat(ranking.dot_ranking(users, items, keys, s, h, top=6, block_bytes=900)) == flat(ranking.model_ranking(keys, s, h, (u, x), lambda state, who: state[0][who] @ state[1].T, top=6))
    for (v, i), (*_, top) in one.items():
        free = [j for j in range(30) if (v, j) not in seen]
        assert list(top) == sorted(free, key=lambda j: (-(u[v] @ x[j]), own[j]))[:6]


def test_nan_scores_rank_last(spark):
    items = spark.createDataFrame([(0, float("nan")), (1, 0.5), (2, -1.0)], "item_idx long, score double")
    order = {r["item_idx"]: r["place"] for r in ranking.global_order(items, ranking.tie_keys(items)).collect()}
    assert order == {1: 1, 2: 2, 0: 3}


def test_list_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "c", "x"]), ([], ["a"]), (["a"], []), (["z", "a"], ["a"])], "top array<string>, truth array<string>")
    rows = [r.asDict() for r in df.select(*(c.alias(n) for n, c in metrics.list_metrics(F.col("top"), F.col("truth"), 5).items())).collect()]
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert rows[0] == pytest.approx({"precision": 0.4, "recall": 2 / 3, "f1": 0.5, "map": (1 + 2 / 3) / 3, "ndcg": (1 + 0.5) / ideal})
    assert rows[1] == rows[2] == dict.fromkeys(metrics.METRICS, 0.0)
    assert rows[3] == pytest.approx({"precision": 0.2, "recall": 1, "f1": 1 / 3, "map": 0.5, "ndcg": 1 / math.log2(3)})


def test_rank_metrics_equal_list_metrics(spark):
    rows = [([f"i{j}" for j in range(30)], [f"i{r - 1}"], r) for r in range(1, 31)]
    df = spark.createDataFrame(rows, "top array<string>, truth array<string>, rank long")
    for k in metrics.KS:
        a, b = metrics.list_metrics(F.col("top"), F.col("truth"), k), metrics.rank_metrics(F.col("rank"), k)
        for r in df.select(*(F.abs(a[m] - b[m]).alias(m) for m in metrics.METRICS)).collect():
            assert max(r) < 1e-12


def test_rank_below_one_raises(spark):
    with pytest.raises(Exception, match="ranks start at 1"):
        spark.range(1).select(metrics.rank_metrics(F.col("id"), 5)["ndcg"]).collect()
    with pytest.raises(ValueError):
        metrics.rank_metrics(F.col("id"), 0)


def test_leave_one_out(spark):
    rows = [("a", f"i{j}", j) for j in range(4)] + [("a", "i3", 9), ("b", "x", 1), ("b", "y", 2), (None, "x", 1)]
    got = {(r[0], r[1]): r[2] for r in splits.leave_one_out(spark.createDataFrame(rows, "u string, i string, t long"), "u", "i", "t").collect()}
    assert got == {("a", "i3"): "test", ("a", "i2"): "val", ("a", "i1"): "train", ("a", "i0"): "train"}


def test_subsample(spark):
    users = spark.createDataFrame([(i,) for i in [*range(0, 50, 2), 4, None]], "user_idx long")
    got = sorted(r[0] for r in splits.user_subsample(users, "user_idx", 7, 5).collect())
    assert len(set(got)) == 7 and set(got) <= set(range(0, 50, 2)) and got == sorted(r[0] for r in splits.user_subsample(users.repartition(4), "user_idx", 7, 5).collect())
    assert splits.user_subsample(users, "user_idx", 100).count() == 25
