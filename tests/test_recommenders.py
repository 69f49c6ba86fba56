"""Gradients, samplers, scores and training."""

import json

import numpy as np
import pytest

from orrery.operators import adam
from orrery.operators import recommenders as rc
from orrery.operators.autodiff import Value
from orrery.plans import pipeline

RNG = np.random.default_rng(0)
N_U, N_I = 6, 10


def _context(model, fusion=None):
    if model == "acf":
        hist = RNG.integers(0, N_I, (N_U, 3))
        mask = np.ones((N_U, 3), bool)
        mask[0] = False
        mask[1, 2:] = False
        return rc.Context(N_U, N_I, [RNG.standard_normal((N_I, 4, 5))], history=hist, mask=mask)
    sources = [RNG.standard_normal((N_I, 8)), RNG.standard_normal((N_I, 6))][: 2 if fusion else 1]
    return rc.Context(N_U, N_I, sources, categories=np.arange(N_I) % 3, fusion=fusion)


HP = {"latent": 4, "visual": 3, "att_hidden": 5, "hidden": (6, 4), "aligned": 4}


@pytest.mark.parametrize(("model", "fusion"), [(m, None) for m in ("bpr", "vbpr", "deepstyle", "avbpr", "vnpr", "acf")] + [("vbpr", f) for f in rc.ONLINE])
def test_gradients(model, fusion):
    c = _context(model, fusion)
    p = rc.init(model, c, HP, np.random.default_rng(1))
    for x in p.values():
        x += 0.3 * np.random.default_rng(2).standard_normal(x.shape)
    u, i, j = np.array([0, 1, 2, 1]), np.array([1, 2, 3, 9]), np.array([4, 5, 6, 0])

    def value():
        return float(rc.loss(model, {n: Value(x) for n, x in p.items()}, c, u, i, j, 0.01).data)

    v = {n: Value(x) for n, x in p.items()}
    rc.loss(model, v, c, u, i, j, 0.01).backward()
    for n, x in p.items():
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 6)]:
            keep = x[at]
            x[at] = keep + 1e-5
            up = value()
            x[at] = keep - 1e-5
            down = value()
            x[at] = keep
            assert v[n].grad[at] == pytest.approx((up - down) / 2e-5, abs=2e-5), (n, at)


@pytest.mark.parametrize("model", ["bpr", "vbpr", "deepstyle", "avbpr", "vnpr", "acf"])
def test_all_scores_equal_pair_scores(model):
    c = _context(model)
    p = rc.init(model, c, HP, np.random.default_rng(3))
    users = np.array([0, 3, 5])
    got = rc.all_scores(model, p, c, users, budget=300)
    v = {n: Value(x) for n, x in p.items()}
    for r, u in enumerate(users):
        assert got[r] == pytest.approx(rc.score(model, v, c, np.full(N_I, u), np.arange(N_I)).data, abs=1e-12)


def test_deepstyle_without_categories_ranks_as_vbpr():
    c = _context("deepstyle")
    c.categories = None
    p = rc.init("deepstyle", c, HP, np.random.default_rng(3))
    p["category"] += 1
    d = rc.all_scores("deepstyle", p, c, np.arange(N_U)) - rc.all_scores("vbpr", p, c, np.arange(N_U))
    assert np.ptp(d, axis=1) == pytest.approx(np.zeros(N_U), abs=1e-12)


def test_gate_starts_at_half():
    c = _context("vbpr", "adaptive_gated")
    p = rc.init("vbpr", c, HP, np.random.default_rng(3))
    v = {n: Value(x) for n, x in p.items()}
    e = [rc._apply(v, f"align{i}", Value(f)).unit().data for i, f in enumerate(c.features)]
    assert rc.fused(v, c, np.arange(N_I)).data == pytest.approx((e[0] + e[1]) / 2)


def test_triples():
    train = np.array([(u, i) for u in range(5) for i in range(u, 8)] * 2 + [(5, i) for i in range(10)])
    draw = lambda seed: rc.triples(train, 10, np.random.default_rng(seed))
    rows = draw(1)
    assert sorted(map(tuple, rows[:, :2])) == sorted(set(map(tuple, train[train[:, 0] < 5])))
    assert not {(u, n) for u, _, n in rows.tolist()} & set(map(tuple, train.tolist())) and rows[:, 2].max() < 10
    assert (rows == draw(1)).all() and not (rows == draw(2)).all()
    assert {n for s in range(40) for u, _, n in draw(s).tolist() if u == 4} == {0, 1, 2, 3, 8, 9}


def _data():
    rng = np.random.default_rng(5)
    group = np.arange(40) % 2
    pairs = {(u, int(i)) for u in range(40) for i in rng.choice(np.flatnonzero(np.arange(30) % 2 == group[u]), 8, replace=False)}
    by = {}
    for u, i in sorted(pairs):
        by.setdefault(u, []).append(i)
    return np.array([(u, i) for u, x in by.items() for i in x[1:]]), np.array([(u, x[0]) for u, x in by.items()])


def test_training_learns_and_is_reproducible():
    train, val = _data()
    c = rc.Context(40, 30)
    hp = {"latent": 8, "lr": 0.02, "epochs": 40, "eval_every": 5, "batch": 64}
    p, metric, epoch = rc.fit("bpr", c, train, val, hp)
    start = rc.validate("bpr", rc.init("bpr", c, hp, np.random.default_rng(42)), c, train, val, np.random.default_rng(42).permutation(30))
    assert metric > start + 0.1 and epoch > 0
    again = rc.fit("bpr", c, train, val, hp)
    assert again[1:] == (metric, epoch) and all((again[0][n] == x).all() for n, x in p.items())


def test_jobs_keep_their_parameters(spark, tmp_path):
    train, val = _data()
    c = rc.Context(40, 30)
    hps = [json.dumps({"latent": 4, "lr": lr, "epochs": 2, "eval_every": 1}) for lr in (0.01, 0.1)]
    jobs = spark.createDataFrame([("bpr", hp, 42) for hp in hps], rc.JOB)
    rc.trained(jobs, c, train, val).write.parquet(str(tmp_path / "models"))
    stored = spark.read.parquet(str(tmp_path / "models"))
    got = rc.results_of(stored)
    assert got.count() == 2 and rc.best_jobs(got).count() == 1
    want, metric, _ = rc.fit("bpr", c, train, val, json.loads(hps[1]), 42)
    mine = rc.parameters_of(stored.where(stored.hyperparams == hps[1]))
    assert mine.keys() == want.keys() and all((mine[k] == x).all() for k, x in want.items())
    assert got.where(got.hyperparams == hps[1]).first()["metric"] == metric
    with pytest.raises(ValueError):
        rc.train_jobs(jobs, c, train, val, most_bytes=10)


@pytest.mark.parametrize("model", ["bpr", "vbpr", "deepstyle", "avbpr"])
def test_factors_give_the_scores(model):
    c = _context(model)
    p = rc.init(model, c, HP, np.random.default_rng(3))
    u, x, b = rc.factors(model, p, c)
    assert u @ x.T + b == pytest.approx(rc.all_scores(model, p, c, np.arange(N_U)))
    with pytest.raises(ValueError):
        rc.factors("vnpr", p, c)
    with pytest.raises(ValueError, match="bpr, vbpr"):
        rc.known("nonsense")


def test_search(spark, tmp_path):
    train, val = _data()
    space = {"lr": {"type": "float", "low": 0.001, "high": 0.1, "log": True}, "latent": {"type": "int", "low": 4, "high": 8, "step": 4}, "epochs": {"type": "categorical", "choices": [2]}, "eval_every": {"type": "categorical", "choices": [1]}}
    run = lambda n: {r["trial"]: r for r in rc.search(spark, "bpr", rc.Context(40, 30), train, val, space, n, str(tmp_path / "trials"), wave=2).collect()}
    first = run(3)
    more = run(5)
    assert {t: more[t] for t in first} == first and more.keys() == set(range(5)) and all(json.loads(t["hyperparams"])["latent"] in (4, 8) for t in more.values())
    assert all(r["history"] and r["state"] == "COMPLETE" for r in more.values())
    stop = rc.median_pruner([{1: 0.5}] * 5)
    assert stop(1, 0.4) and not stop(1, 0.6) and not stop(2, 0.0)
    assert len(rc.grid({"a": [1, 2], "b": [3, 4]})) == 4


def _every_row(model, c, train, hp, seed=42):
    """Training that updates all rows of all tables in every step."""
    p = rc.init(model, c, hp, np.random.default_rng(seed))
    m, v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(1, hp["epochs"] + 1):
        rows = rc.triples(train, c.n_items, np.random.default_rng([seed, epoch]))
        for at in range(0, len(rows), hp["batch"]):
            b, values = rows[at : at + hp["batch"]], {n: Value(x) for n, x in p.items()}
            rc.loss(model, values, c, b[:, 0], b[:, 1], b[:, 2], hp["l2"]).backward()
            step += 1
            for n, x in p.items():
                m[n] = 0.9 * m[n] + 0.1 * values[n].grad
                v[n] = 0.999 * v[n] + 0.001 * values[n].grad ** 2
                x -= hp["lr"] * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return p


@pytest.mark.parametrize(("model", "l2"), [("bpr", 0.0), ("bpr", 1e-3), ("deepstyle", 0.0), ("avbpr", 1e-3), ("vnpr", 0.0), ("acf", 1e-3)])
def test_rows_left_out_of_batches_move_as_in_every_step(model, l2):
    train, val = _data()
    rng = np.random.default_rng(7)
    c = rc.Context(40, 30, [rng.standard_normal((30, 4, 5) if model == "acf" else (30, 8))], categories=np.arange(30) % 3, history=rng.integers(0, 30, (40, 3)), mask=np.ones((40, 3), bool))
    hp = {**HP, "lr": 0.02, "l2": l2, "epochs": 12, "eval_every": 1, "patience": 99, "batch": 5}
    p, _, epoch = rc.fit(model, c, train, val, hp)
    want = _every_row(model, c, train, {**hp, "epochs": epoch}) if epoch else rc.init(model, c, hp, np.random.default_rng(42))
    for n, x in want.items():
        assert p[n] == pytest.approx(x, abs=1e-9), n


@pytest.mark.parametrize("l2", [0.0, 1e-4])
def test_a_step_works_on_the_rows_of_its_batch(monkeypatch, l2):
    """Numbers that the optimiser reads per step; they were all rows of all tables, 160,000 here."""
    sizes, rows = [], adam.Adam.rows
    monkeypatch.setattr(adam.Adam, "rows", lambda self, name, at: sizes.append(len(self.x[name]) if at is None else len(at)) or rows(self, name, at))
    train = np.column_stack([np.arange(60_000), np.arange(60_000) % 100_000])[::100]
    rc.fit("bpr", rc.Context(60_000, 100_000), train, train[:0], {"latent": 2, "batch": 60, "epochs": 1, "eval_every": 2, "l2": l2})
    assert len(sizes) > 40 and max(sizes[: 10 * 5]) <= 60


@pytest.mark.parametrize("t", [0, 5, 40, 400, 5000])
def test_rest_rule(t):
    j, (h, w) = np.arange(1, 2000), adam.rest_rule(t)
    for s in (0.0, 1e-9, 1e-7, 1e-3, 1.0):
        assert (w / (s * h + 1e-8)).sum() == pytest.approx((0.9**j / (1 - 0.9 ** (t + j)) / (s * np.sqrt(0.999**j / (1 - 0.999 ** (t + j))) + 1e-8)).sum(), rel=1e-12)


def test_negatives_are_looked_up_in_the_order_of_users(monkeypatch):
    """The lookups were in random order, which took most of the time of an epoch's draws; the triples are the same."""
    rng = np.random.default_rng(5)
    train, seen, free = np.column_stack([rng.integers(0, 50, 400), rng.integers(0, 30, 400)]), [], rc.nth_free
    monkeypatch.setattr(rc, "nth_free", lambda rows, *rest: seen.append(rows) or free(rows, *rest))
    got = rc.triples(train, 30, np.random.default_rng(6))
    assert len(seen) == 1 and (np.diff(seen[0]) >= 0).all()
    pairs, draw = np.unique(train, axis=0), np.random.default_rng(6)
    lacks = {u: np.setdiff1d(np.arange(30), pairs[pairs[:, 0] == u, 1]) for u in range(50)}
    rows = pairs[draw.permutation(len(pairs))]
    place = draw.integers(0, [len(lacks[u]) for u, _ in rows])
    assert (got == [(u, i, lacks[u][k]) for (u, i), k in zip(rows, place)]).all()


@pytest.mark.parametrize("threads", [1, 3])
def test_threads_share_the_rows_that_a_penalty_moves(threads):
    """One thread did all pieces, while slots without a job stayed idle; the numbers are the same to the last bit."""
    rng, rows = np.random.default_rng(9), 3000
    start = {"user": rng.normal(0, 0.1, (rows, 4)), "bias": np.zeros((rows, 1))}
    one, many = adam.Adam(start, 0.01, 1e-4, behind=10, piece=rows), adam.Adam(start, 0.01, 1e-4, behind=10, piece=100, threads=threads)
    for _ in range(35):
        at = rng.integers(0, rows, 200)
        for a in (one, many):
            leaves = a.tables()
            ((leaves["user"].take(at) * leaves["user"].take(at[::-1])).sum(1) + leaves["bias"].take(at).reshape(200)).sigmoid().mean().backward()
            a.step(leaves)
    assert all((one.values()[n] == many.values()[n]).all() and (one.values()[n] != x).any() for n, x in start.items())
    assert (many.pool is not None) == (threads > 1)


def test_jobs_with_a_penalty_take_the_slots_that_are_left():
    plain, heavy = json.dumps({"l2": 0.0}), json.dumps({"l2": 1e-5})
    assert rc.spare_threads([plain, plain, heavy, heavy], 6) == 2
    assert rc.spare_threads([plain, heavy], 4) == 3 and rc.spare_threads([heavy], 600) == 4
    assert rc.spare_threads([heavy] * 4, 6) == rc.spare_threads([heavy] * 8, 6) == rc.spare_threads([heavy], 1) == 1


def test_validation_equals_the_sort_of_all_scores():
    rng = np.random.default_rng(11)
    c, k = rc.Context(300, 700), 10
    for spread, ties in ((0.1, False), (3.0, False), (1.0, True)):
        p = {"user": rng.normal(0.5, spread, (300, 6)), "item": rng.normal(0, 1, (700, 6)), "bias": rng.normal(0, spread, (700, 1))}
        if ties:  # all items four times
            p["item"], p["bias"] = (np.concatenate([p[n][:175]] * 4) for n in ("item", "bias"))
        pairs = rng.permutation(300 * 700)[:9000]
        train, val, keys = np.column_stack([pairs // 700, pairs % 700])[:6000], np.column_stack([pairs // 700, pairs % 700])[6000:], rng.permutation(700)
        s = p["user"] @ p["item"].T + p["bias"][:, 0]
        s = s.round(9)
        want, held = [], val.copy()
        for x, (u, h) in enumerate(val):
            if x % 2:  # items that are high in the list
                h = held[x, 1] = np.setdiff1d(np.argsort(-s[u])[:40], train[train[:, 0] == u, 1])[x % 3]
            free = np.setdiff1d(np.arange(700), train[train[:, 0] == u, 1])
            want.append(1 + int(np.flatnonzero(free[np.lexsort((keys[free], -s[u][free]))] == h)[0]))
        want = np.array(want)
        got = rc.ranks_to(k, p["user"], p["item"], p["bias"][:, 0], train, held, keys, width=64)
        assert (got == np.minimum(want, k + 1)).all() and (want <= k).sum() > 200
        assert rc.validate("bpr", p, c, train, held, keys) == pytest.approx((1 / np.log2(want + 1))[want <= k].sum() / len(want))
    p["user"][:] = np.nan
    assert rc.validate("bpr", p, c, train, held, keys) >= 0


def test_validation_stops_where_enough_items_are_ahead(monkeypatch):
    """The whole catalogue is not scored for every row; it was 300 million scores here."""
    rng = np.random.default_rng(3)
    users, items, val = rng.normal(0.3, 0.1, (3000, 4)), rng.normal(0, 1, (100_000, 4)), np.column_stack([np.arange(3000), rng.integers(0, 100_000, 3000)])
    seen, flat = [], np.flatnonzero
    monkeypatch.setattr(rc.np, "flatnonzero", lambda x: seen.append(flat(x)) or seen[-1])
    rank = rc.ranks_to(10, users, items, np.zeros(100_000), val[:0], val, np.arange(100_000))
    assert (rank > 10).mean() > 0.99 and sum(map(len, seen)) * 2048 < 0.1 * 3000 * 100_000


def test_floats_stay_of_four_bytes(spark):
    """Half of what is sent to each task; what a model sees is the same."""
    rows = [(i, [0.1 * i, 0.3, -1e-3]) for i in (0, 2, 3, 9)]
    one, two = (pipeline.feature_matrix(spark.createDataFrame(rows, f"item_idx long, v array<{kind}>"), "v", 5, 3) for kind in ("float", "double"))
    assert one.dtype == np.float32 and two.dtype == np.float64 and (one == two.astype(np.float32)).all() and one.shape == (5, 3)
    c = [rc.Context(N_U, 5, [x]) for x in (one, one.astype(float))]
    p = rc.init("vbpr", c[0], HP, np.random.default_rng(1))
    assert (rc.factors("vbpr", p, c[0])[1] == rc.factors("vbpr", p, c[1])[1]).all()


def test_best_jobs_need_no_parameters(spark):
    """Only one row per job leaves the tasks; all parameters of all cells did."""
    train, val = _data()
    hps = [json.dumps({"latent": 4, "lr": lr, "epochs": 2, "eval_every": 1}) for lr in (0.01, 0.1)]
    jobs = spark.createDataFrame([("bpr", hp, 42) for hp in hps], rc.JOB)
    rows = rc.trained(jobs, rc.Context(40, 30), train, val, keep=False)
    assert rows.count() == 2
    best, fits = rc.best_jobs(rc.results_of(rows)).first(), {hp: rc.fit("bpr", rc.Context(40, 30), train, val, json.loads(hp), 42)[1] for hp in hps}
    assert best["metric"] == max(fits.values()) == fits[best["hyperparams"]]
