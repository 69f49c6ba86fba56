"""Problems 5 and 6: pairs and frequencies against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import cooccurrence as co
from orrery.llm import frequency as fr


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(f"u{int(u)}", f"i{int(i)}") for u, i in zip(60 * rng.random(900) ** 2, 50 * rng.random(900) ** 2)]
    out += [(f"u{j}", x) for j in range(9) for x in ("p", "q")] + [("big", f"i{j}") for j in range(50)]
    return out + out[:200] + [(None, "i1"), ("u1", None), (None, None), ("u_only_null", None), ("", "i1")]


def _pairs(rows, least, lift):
    baskets = defaultdict(set)
    for u, i in rows:
        if u is not None and i is not None:
            baskets[u].add(i)
    n, single, pair = len(baskets), Counter(i for b in baskets.values() for i in b), Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b): (single[a], single[b], m, m * n / single[a] / single[b]) for (a, b), m in pair.items() if m >= least and (lift is None or m * n >= lift * single[a] * single[b])}, n


@pytest.mark.parametrize(("least", "lift", "chunk"), [(8, 5, 1000), (3, None, 1000), (2, None, 7), (1, 1.5, 7)])
def test_pairs(spark, rows, least, lift, chunk):
    df = spark.createDataFrame([(u, i, "clash") for u, i in rows], "user_id string, item_id string, basket string")
    got = {(r["item_a"], r["item_b"]): r for r in co.item_pairs(df, "user_id", "item_id", least, lift, chunk).collect()}
    want, n = _pairs(rows, least, lift)
    assert set(got) == set(want) and want
    for k, (a, b, m, x) in want.items():
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_ab"]) == (a, b, m) and r["lift"] == pytest.approx(x)
        assert r["odds_ratio"] == pytest.approx((m + 0.5) * (n - a - b + m + 0.5) / ((a - m + 0.5) * (b - m + 0.5)))


def test_pairs_without_broadcast(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, item_id string")
    f = lambda **k: {tuple(r) for r in co.item_pairs(df, "user_id", "item_id", 3, **k).collect()}
    assert f() == f(broadcast_bytes=0)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "user_id string, item_id string")
    assert co.item_pairs(df, "user_id", "item_id").count() == 0
    assert co.item_pairs(spark.createDataFrame([("u", "i")] * 20, df.schema), "user_id", "item_id", 1).count() == 0


def test_runs_are_flushed():
    lists = pa.array([[1, 2, 3]] * 50 + [[4], []], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array([None] * 52, pa.list_(pa.int32()))], ["a", "b"])
    total = Counter()
    for b in co._sorted_runs(iter([batch, batch]), hold=10):
        codes = b.column(0).to_pylist()
        assert codes == sorted(codes)
        for c, n in zip(codes, b.column(1).to_pylist()):
            total[c >> 32, c & 0xFFFFFFFF] += n
    assert total == {(1, 2): 100, (1, 3): 100, (2, 3): 100}


def test_frequencies(spark, rows):
    df = spark.createDataFrame([(u, i, 1) for u, i in rows], "user_id string, item_id string, n int").repartition(3)
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in fr.term_frequencies(df, "user_id", "item_id").collect()}
    want = {}
    for field, a, b in (("user_id", 0, 1), ("item_id", 1, 0)):
        for t in {r[a] for r in rows} - {None}:
            own = [r for r in rows if r[a] == t]
            want[field, t] = (len(own), len({r[b] for r in own} - {None}))
    assert got == want
    marks = {tuple(r) for r in fr.marked_terms(df, "user_id", "item_id").collect()}
    total = {f: sum(n for (g, _), (n, _) in want.items() if g == f) for f in ("user_id", "item_id")}
    assert marks == {(f, t, "rare") for (f, t), (_, r) in want.items() if r < 3} | {(f, t, "common") for (f, t), (n, _) in want.items() if n * 50 >= total[f]}


def test_last_seen_across_batches():
    rows = sorted([(0, "a", r, n) for r, n in (("x", 1), ("x", 2), ("y", 1), (None, 4))] + [(0, "b", "x", 1), (1, "b", "x", 3)], key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
    names, kinds = ["field", "term", "record", "n"], [pa.int32(), pa.string(), pa.string(), pa.int64()]
    for size in (1, 2, 3, 10):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p), kinds)], names) for p in parts]
        got = [tuple(r.values()) for b in fr._last_seen(iter(batches)) for r in b.to_pylist()]
        assert got == [(0, "a", 8, 2), (0, "b", 1, 1), (1, "b", 3, 1)]


def test_no_terms(spark):
    df = spark.createDataFrame([(None, None)], "user_id string, item_id string")
    assert fr.term_frequencies(df, "user_id", "item_id").count() == fr.marked_terms(df.limit(0), "user_id", "item_id").count() == 0
