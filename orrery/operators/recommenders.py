"""Pairwise-ranking recommenders, their training, and the search over their hyperparameters.

A model is a set of parameter tables and a score of (user, item) pairs. One cell (model, features, hyperparameters,
seed) is trained by one task; the cells of a grid run in parallel over a DataFrame of jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.adam import Adam
from orrery.operators.autodiff import Constant, Value, concat
from orrery.sources.tables import exists

ONLINE = ("mean", "sum", "prod", "max_pool", "weighted_mean", "attention_weighted", "gated", "adaptive_gated")


@dataclass
class Context:
    """What a model sees besides its parameters."""

    n_users: int
    n_items: int
    features: list[np.ndarray] = field(default_factory=list)  # pooled (items, d), one per source, or one (items, components, d)
    categories: np.ndarray | None = None
    history: np.ndarray | None = None  # (users, H) item numbers
    mask: np.ndarray | None = None
    fusion: str | None = None  # learned alignment of several sources


def xavier(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    """Uniform Glorot start."""
    edge = np.sqrt(6 / (rows + cols))
    return rng.uniform(-edge, edge, (rows, cols))


def _linear(rng, p: dict, name: str, rows: int, cols: int, bias: bool = True) -> None:
    p[f"{name}.w"] = xavier(rng, rows, cols)
    if bias:
        p[f"{name}.b"] = np.zeros(cols)


def _apply(p: dict, name: str, x: Value) -> Value:
    out = x @ p[f"{name}.w"]
    return out + p[f"{name}.b"] if f"{name}.b" in p else out


def _init_fusion(rng, p: dict, c: Context, dim: int) -> int:
    """Parameters of the learned alignment; returns the dimension the model sees."""
    if c.fusion is None:
        return c.features[0].shape[-1]
    if c.fusion not in ONLINE:
        raise ValueError(f"unknown learned fusion {c.fusion}; known: {', '.join(ONLINE)}")
    for i, f in enumerate(c.features):
        _linear(rng, p, f"align{i}", f.shape[-1], dim)
    if c.fusion in ("weighted_mean", "attention_weighted", "gated"):
        p["fuse.logits"] = np.zeros(len(c.features))
    if c.fusion == "adaptive_gated":
        if len(c.features) != 2:
            raise ValueError("adaptive_gated takes two sources")
        p["gate1.w"], p["gate1.b"] = np.zeros((2 * dim, dim)), np.zeros(dim)
        _linear(rng, p, "gate2", dim, dim)
    return dim


def fused(p: dict, c: Context, items: np.ndarray) -> Value:
    """Visual input of items: the features, or their learned fusion (projection, norm 1, operation)."""
    if c.fusion is None:
        return Constant(c.features[0][items])
    e = [_apply(p, f"align{i}", Constant(f[items])).unit() for i, f in enumerate(c.features)]
    if c.fusion == "adaptive_gated":
        g = _apply(p, "gate2", _apply(p, "gate1", concat(e)).tanh()).sigmoid()
        return g * e[0] + (1.0 - g) * e[1]
    if c.fusion in ("prod", "max_pool"):
        out = e[0]
        for x in e[1:]:
            out = out * x if c.fusion == "prod" else out.maximum(x)
        return out
    if c.fusion in ("weighted_mean", "attention_weighted"):
        w = p["fuse.logits"].softmax()
    elif c.fusion == "gated":
        s = p["fuse.logits"].sigmoid()
        w = s * Value(1.0 / s.data.sum()) if len(e) == 1 else s * _inverse(s.sum())
    else:
        w = Value(np.full(len(e), 1.0 if c.fusion == "sum" else 1.0 / len(e)))
    out = e[0] * w.take(np.array([0]))
    for i, x in enumerate(e[1:], 1):
        out = out + x * w.take(np.array([i]))
    return out


def _inverse(x: Value) -> Value:
    return Value(1 / x.data, (x,), lambda g: x._to(-g / x.data**2))


@dataclass(frozen=True)
class Model:
    """A recommender: what it takes, its order of priority, start values, and scores of paired users and items.

    takes is none, pooled or component. item_term, where set, makes the score a dot product: the user-independent visual
    vector of items, against the parameter visual_user; without it and with linear set, the score is that of user and item alone.
    """

    name: str
    priority: int
    takes: str
    start: Callable[[np.random.Generator, dict, Context, dict], None]
    score: Callable[[dict, Context, np.ndarray, np.ndarray], Value] | None = None
    item_term: Callable[[dict, Context, np.ndarray], Value] | None = None
    linear: bool = True


MODELS: dict[str, Model] = {}


def register_model(model: Model) -> Model:
    """Make a recommender known by its name."""
    MODELS[model.name] = model
    return model


def known(model: str) -> Model:
    """A registered recommender, or an error that lists them in their order."""
    if model not in MODELS:
        raise ValueError(f"unknown recommender {model}; known: {', '.join(sorted(MODELS, key=lambda m: MODELS[m].priority))}")
    return MODELS[model]


def init(model: str, c: Context, hp: dict, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Start values of a model's parameters."""
    own, k = known(model), int(hp.get("latent", 64))
    p: dict[str, np.ndarray] = {"user": rng.normal(0, 0.01, (c.n_users, k)), "item": rng.normal(0, 0.01, (c.n_items, k))}
    if own.takes != "none" and not c.features:
        raise ValueError(f"{model} needs item features")
    if (own.takes == "component") != (bool(c.features) and c.features[0].ndim == 3) and own.takes != "none":
        raise ValueError(f"{model} needs {own.takes} features")
    own.start(rng, p, c, hp)
    return p


def _start_bias(rng, p: dict, c: Context, hp: dict) -> None:
    p["bias"] = np.zeros((c.n_items, 1))


def _start_visual(rng, p: dict, c: Context, hp: dict) -> int:
    _start_bias(rng, p, c, hp)
    kv = int(hp.get("visual", hp.get("latent", 64)))
    p["visual_user"] = rng.normal(0, 0.01, (c.n_users, kv))
    _linear(rng, p, "project", _init_fusion(rng, p, c, int(hp.get("aligned", 128))), kv, bias=False)
    return kv


def _start_style(rng, p: dict, c: Context, hp: dict) -> None:
    kv = _start_visual(rng, p, c, hp)
    p["category"] = rng.normal(0, 0.01, (1 if c.categories is None else int(c.categories.max()) + 1, kv))


def _start_attentive(rng, p: dict, c: Context, hp: dict) -> None:
    kv, h = _start_visual(rng, p, c, hp), int(hp.get("att_hidden", 32))
    _linear(rng, p, "att1", kv, h)
    _linear(rng, p, "att2", h, kv)


def _start_neural(rng, p: dict, c: Context, hp: dict) -> None:
    k = p["user"].shape[1]
    _linear(rng, p, "visual", _init_fusion(rng, p, c, int(hp.get("aligned", 128))), k)
    width = 3 * k
    for i, h in enumerate([*hp.get("hidden", (64, 32)), 1]):
        _linear(rng, p, f"mlp{i}", width, int(h))
        width = int(h)


def _start_collaborative(rng, p: dict, c: Context, hp: dict) -> None:
    if c.history is None:
        raise ValueError("acf needs component features (items, components, dimension) and histories")
    _start_bias(rng, p, c, hp)
    k, h = p["user"].shape[1], int(hp.get("att_hidden", 32))
    kv = int(hp.get("visual", k))
    p["aux"] = rng.normal(0, 0.01, (c.n_items, k))
    _linear(rng, p, "component", c.features[0].shape[-1], kv, bias=False)
    _linear(rng, p, "latent", kv, k, bias=False)
    for name, rows in (("ca.user", k), ("ca.comp", kv), ("ia.user", k), ("ia.item", k), ("ia.aux", k), ("ia.vis", k)):
        _linear(rng, p, name, rows, h)
    _linear(rng, p, "ca.score", h, 1)
    _linear(rng, p, "ia.score", h, 1)


def _projected(p: dict, c: Context, items: np.ndarray) -> Value:
    return _apply(p, "project", fused(p, c, items))


def _style(p: dict, c: Context, items: np.ndarray) -> Value:
    return _projected(p, c, items) - p["category"].take(np.zeros(len(items), int) if c.categories is None else c.categories[items])


def _attentive(p: dict, c: Context, items: np.ndarray) -> Value:
    theta = _projected(p, c, items)
    return theta * _apply(p, "att2", _apply(p, "att1", theta).relu()).softmax()


def _attended(p: dict, c: Context, gamma: Value, items: np.ndarray) -> Value:
    """Component attention of items for users: (rows, latent)."""
    comps = _apply(p, "component", Constant(c.features[0][items]))
    query = _apply(p, "ca.user", gamma)
    energy = _apply(p, "ca.score", (query.reshape(len(items), 1, -1) + _apply(p, "ca.comp", comps)).relu())
    return _apply(p, "latent", (energy.softmax(axis=1) * comps).sum(1))


def _neural_score(p: dict, c: Context, users: np.ndarray, items: np.ndarray) -> Value:
    x = concat([p["user"].take(users), p["item"].take(items), _apply(p, "visual", fused(p, c, items)).relu()])
    i = 0
    while f"mlp{i + 1}.w" in p:
        x, i = _apply(p, f"mlp{i}", x).relu(), i + 1
    return _apply(p, f"mlp{i}", x).reshape(len(users))


def _neural_tile(p: dict[str, np.ndarray], c: Context, users: np.ndarray) -> np.ndarray:
    """Scores of users for all items with the first layer split in a part of the user and one of the item, each computed once."""
    k, v = p["user"].shape[1], {n: Value(x) for n, x in p.items()}
    w = p["mlp0.w"]
    seen = _apply(v, "visual", fused(v, c, np.arange(c.n_items))).relu().data
    x = (p["user"][users] @ w[:k])[:, None] + (p["item"] @ w[k : 2 * k] + seen @ w[2 * k :] + p["mlp0.b"])[None]
    i = 1
    while f"mlp{i}.w" in p:
        x = np.maximum(x, 0) @ p[f"mlp{i}.w"] + p[f"mlp{i}.b"]
        i += 1
    return x[:, :, 0]


def _collaborative_score(p: dict, c: Context, users: np.ndarray, items: np.ndarray) -> Value:
    g, q = p["user"].take(users), p["item"].take(items)
    hist, mask = c.history[users], c.mask[users]
    b, h = hist.shape
    flat, rep = hist.reshape(-1), np.repeat(np.arange(b), h)
    gg = g.take(rep)
    v = _attended(p, c, gg, flat)
    aux = p["aux"].take(flat)
    energy = _apply(p, "ia.score", (_apply(p, "ia.user", gg) + _apply(p, "ia.item", p["item"].take(flat)) + _apply(p, "ia.aux", aux) + _apply(p, "ia.vis", v)).relu())
    alpha = energy.reshape(b, h).softmax(axis=1, mask=mask)
    mine = g + ((aux + v).reshape(b, h, -1) * alpha.reshape(b, h, 1)).sum(1)
    return (mine * (q + _attended(p, c, g, items))).sum(1) + p["bias"].take(items).reshape(len(items))


register_model(Model("bpr", 0, "none", _start_bias))
register_model(Model("vbpr", 1, "pooled", _start_visual, item_term=_projected))
register_model(Model("vnpr", 2, "pooled", _start_neural, _neural_score, linear=False))
register_model(Model("deepstyle", 3, "pooled", _start_style, item_term=_style))
register_model(Model("avbpr", 4, "pooled", _start_attentive, item_term=_attentive))
register_model(Model("acf", 5, "component", _start_collaborative, _collaborative_score, linear=False))


def score(model: str, p: dict, c: Context, users: np.ndarray, items: np.ndarray) -> Value:
    """Scores of paired users and items."""
    own = known(model)
    if own.score:
        return own.score(p, c, users, items)
    out = (p["user"].take(users) * p["item"].take(items)).sum(1) + p["bias"].take(items).reshape(len(items))
    return out if own.item_term is None else out + (p["visual_user"].take(users) * own.item_term(p, c, items)).sum(1)


def factors(model: str, p: dict[str, np.ndarray], c: Context) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """User vectors, item vectors and item biases whose dot products are the scores of a linear model."""
    own = known(model)
    if not own.linear:
        raise ValueError(f"the scores of {model} are no dot products")
    if own.item_term is None:
        return p["user"], p["item"], p["bias"][:, 0]
    v, step = {n: Value(x) for n, x in p.items()}, 1 << 16
    term = np.concatenate([own.item_term(v, c, np.arange(a, min(a + step, c.n_items))).data for a in range(0, max(1, c.n_items), step)])
    return np.hstack([p["user"], p["visual_user"]]), np.hstack([p["item"], term]), p["bias"][:, 0]


def all_scores(model: str, p: dict[str, np.ndarray], c: Context, users: np.ndarray, budget: int = 1 << 22) -> np.ndarray:
    """Scores of users for the whole catalogue; linear models as one matrix product, the others in tiles."""
    if known(model).linear:
        mine, items, bias = factors(model, p, c)
        return mine[users] @ items.T + bias
    width = c.features[0][0].size if known(model).takes == "component" else 64
    step = max(1, budget // max(1, c.n_items * width))
    v, items = {n: Value(x) for n, x in p.items()}, np.arange(c.n_items)
    tile = (lambda u: _neural_tile(p, c, u)) if model == "vnpr" else lambda u: score(model, v, c, np.repeat(u, c.n_items), np.tile(items, len(u))).data.reshape(-1, c.n_items)
    tiles = [tile(users[a : a + step]) for a in range(0, len(users), step)]
    return np.concatenate(tiles) if tiles else np.empty((0, c.n_items))


def loss(model: str, p: dict, c: Context, users: np.ndarray, pos: np.ndarray, neg: np.ndarray, l2: float) -> Value:
    """-mean log(sigmoid(difference) + 1e-10) plus l2 times the squared norm of all parameters."""
    out = -((score(model, p, c, users, pos) - score(model, p, c, users, neg)).sigmoid().log(1e-10)).mean()
    if l2:
        for v in p.values():
            out = out + (v * v).sum() * l2
    return out


def nth_free(rows: np.ndarray, barred: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place-th item (from 0) that a row's group lacks; barred holds distinct (group, item) pairs sorted by group and item.

    The j-th barred item i of a group has i - j free items before it; the free item is the place plus the barred ones with at most
    that many.
    """
    heads = np.searchsorted(barred[:, 0], barred[:, 0])
    gaps = barred[:, 1] - (np.arange(len(barred)) - heads)
    wide = max(int(place.max(initial=0)), int(gaps.max(initial=0))) + 2
    return place + np.searchsorted(barred[:, 0] * wide + gaps, rows * wide + place, side="right") - np.searchsorted(barred[:, 0], rows)


def triples(train: np.ndarray, n_items: int, rng: np.random.Generator) -> np.ndarray:
    """Every distinct (user, item) once in random order with a negative item of the user: (user, positive, negative).

    A negative is drawn by its place among the items that the user lacks; users who have every item are left out. The places are
    looked up in the order of users, which in large tables is far quicker than in random order.
    """
    codes = np.sort(train[:, 0] * n_items + train[:, 1])
    pairs = np.column_stack(np.divmod(codes[np.diff(codes, prepend=-1) > 0], n_items))
    n_free = n_items - np.bincount(pairs[:, 0], minlength=1)[pairs[:, 0]]
    rows, n_free = pairs[n_free > 0], n_free[n_free > 0]
    order, place = rng.permutation(len(rows)), np.empty(len(rows), np.int64)
    place[order] = rng.integers(0, n_free[order])
    return np.column_stack([rows, nth_free(rows[:, 0], pairs, place)])[order]


def ranks_to(k: int, users: np.ndarray, items: np.ndarray, bias: np.ndarray, train: np.ndarray, val: np.ndarray, keys: np.ndarray, width: int = 2048) -> np.ndarray:
    """Rank of each row of val by the scores users · items + bias, or k + 1 where it is over k; train items masked, ties by keys.

    Items come in blocks, those that are high for the mean user first. A row is done with once k items are ahead of it, and leaves
    out blocks that can't hold one: with the mean user u0 a score is at most u0 · item + bias + |user - u0| · |item|. Floats of 4 bytes
    decide where they differ by more than their rounding; all nearer scores are taken again in 8 bytes, as sums in one order.
    """
    if not len(val):
        return np.empty(0, np.int64)
    mean, size = users[val[:, 0]].mean(0), np.sqrt((items**2).sum(1))
    base, apart = items @ mean + bias, np.sqrt(((users[val[:, 0]] - mean) ** 2).sum(1))
    order = np.argsort(-(base + np.median(apart) * size), kind="stable")
    items, bias, keys, base, size = items[order], bias[order], keys[order], base[order], size[order]
    items4, bias4 = items.astype(np.float32), bias.astype(np.float32)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    heads = np.array([0, width // 8, *range(width, len(items), width)])  # the first block is small: most rows are done with there
    heads = heads[heads < len(items)]
    ends = [*heads[1:], len(items)]
    high, long = np.maximum.reduceat(base, heads), np.maximum.reduceat(size, heads)
    by_user = train[np.argsort(train[:, 0], kind="stable")]
    out = np.empty(len(val), np.int64)
    for at in range(0, len(val), width):
        u, h = users[val[at : at + width, 0]], place[val[at : at + width, 1]]
        own = (u * items[h]).sum(1) + bias[h]
        reach = np.sqrt((u**2).sum(1)) * size.max() + np.abs(bias).max()
        near = 1.2e-7 * (4 + u.shape[1]) * reach + 1e-35
        short, below, above = u.astype(np.float32), np.nextafter((own - near).astype(np.float32), -np.inf), np.nextafter((own + near).astype(np.float32), np.inf)
        least = own - 1e-9 * (reach + np.sqrt((mean**2).sum()) * size.max())
        lo, hi = (np.searchsorted(by_user[:, 0], val[at : at + width, 0], side=x) for x in ("left", "right"))
        row = np.concatenate([np.repeat(np.arange(len(u)), hi - lo), np.arange(len(u))])  # masked: the row's train items and its own
        barred = np.concatenate([place[by_user[np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo), 1]], h])
        sort = np.argsort(barred, kind="stable")
        row, barred = row[sort], barred[sort]
        cuts, ahead, active = np.searchsorted(barred, [0, *ends]), np.zeros(len(u), np.int64), np.empty(len(u), np.int64)
        for b, (head, end) in enumerate(zip(heads, ends)):
            todo = np.flatnonzero((ahead < k) & (high[b] + apart[at : at + width] * long[b] >= least))
            if not len(todo):
                continue
            s = short[todo] @ items4[head:end].T
            s += bias4[head:end]
            active[:] = -1
            active[todo] = np.arange(len(todo))
            r, i = active[row[cuts[b] : cuts[b + 1]]], barred[cuts[b] : cuts[b + 1]] - head
            s[r[r >= 0], i[r >= 0]] = -np.inf
            over = (s > above[todo, None]).sum(1)
            ahead[todo] += over
            even = np.flatnonzero((s >= below[todo, None]).sum(1) > over)
            x, i = np.nonzero((s[even] >= below[todo[even], None]) & (s[even] <= above[todo[even], None]))
            y, i = todo[even[x]], head + i
            again = (u[y] * items[i]).sum(1) + bias[i]
            ahead += np.bincount(y[(again > own[y]) | (again == own[y]) & (keys[i] < keys[h[y]])], minlength=len(u))
        out[at : at + width] = 1 + np.minimum(ahead, k)
    return out


def validate(model: str, p: dict, c: Context, train: np.ndarray, val: np.ndarray, keys: np.ndarray, k: int = 10, block: int = 512) -> float:
    """Mean ndcg@k of one held item per row of val, train items masked, ties by the seeded keys."""
    if not len(val):
        return 0.0
    if known(model).linear:
        users, items, bias = factors(model, p, c)
        if all((np.abs(x) < 1e15).all() for x in (users, items, bias)):  # finite, also as products of 4 bytes
            rank = ranks_to(k, users, items, bias, train, val, keys)
            return float((1 / np.log2(rank + 1))[rank <= k].sum() / len(val))
    order = np.argsort(train[:, 0], kind="stable")
    by_user, lo = train[order], None
    total = 0.0
    for at in range(0, len(val), block):
        u, h = val[at : at + block, 0], val[at : at + block, 1]
        s = all_scores(model, p, c, u)
        s[np.isnan(s)] = -np.inf
        own = s[np.arange(len(u)), h]
        for r, user in enumerate(u):
            lo, hi = np.searchsorted(by_user[:, 0], [user, user + 1])
            s[r, by_user[lo:hi, 1]] = -np.inf
        rank = 1 + (s > own[:, None]).sum(1) + ((s == own[:, None]) & (keys[None, :] < keys[h][:, None])).sum(1)
        total += (1 / np.log2(rank + 1))[rank <= k].sum()
    return float(total / len(val))


def fit(model: str, c: Context, train: np.ndarray, val: np.ndarray, hp: dict, seed: int = 42, log: Callable[[int, float], bool] | None = None, threads: int = 1) -> tuple[dict[str, np.ndarray], float, int]:
    """Adam with early stopping: the best parameters, their validation ndcg@10 (0: none was kept) and epoch.

    Improvement is strict; patience counts epochs; log(epoch, metric) may return True to prune the run. With more threads
    the rows that a penalty moves are shared between them; the result is the same.
    """
    rng = np.random.default_rng(seed)
    p = init(model, c, hp, rng)
    keys = np.random.default_rng(seed).permutation(c.n_items)
    epochs, every, patience = int(hp.get("epochs", 100)), int(hp.get("eval_every", 10)), int(hp.get("patience", 20))
    lr, l2, size = float(hp.get("lr", 0.001)), float(hp.get("l2", 0.0)), int(hp.get("batch", 4096))
    adam, best, best_metric, best_epoch, waited = Adam(p, lr, l2, threads=threads), p, 0.0, 0, 0
    for epoch in range(1, epochs + 1):
        rows = triples(train, c.n_items, np.random.default_rng([seed, epoch]))
        for at in range(0, len(rows), size):
            b = rows[at : at + size]
            leaves = adam.tables()
            loss(model, leaves, c, b[:, 0], b[:, 1], b[:, 2], 0.0).backward()  # the penalty is the optimiser's
            adam.step(leaves)
        if epoch % every == 0 or epoch == epochs:
            p = adam.values()
            metric = validate(model, p, c, train, val, keys)
            if metric > best_metric:
                best, best_metric, best_epoch, waited = p, metric, epoch, 0
            else:
                waited += every
            if (log is not None and log(epoch, metric)) or waited >= patience:
                break
    return best, best_metric, best_epoch


def spare_threads(hps: list[str], slots: int, most: int = 4) -> int:
    """Threads of a job with a penalty, which takes by far the longest: where slots are more than jobs, these jobs share the rest.

    More than a few threads gain nothing, as Python runs one at a time between the calls of numpy.
    """
    heavy = sum(float(json.loads(hp).get("l2", 0.0)) > 0 for hp in hps)
    return min(most, 1 + max(0, slots - len(hps)) // max(1, heavy))


JOB = "model string, hyperparams string, seed long"
RESULT = JOB + ", metric double, epoch long, n_parameters long"
STORED = RESULT + ", kind string, idx long, vector array<double>"
KEYS = ["model", "hyperparams", "seed"]


def trained(jobs: DataFrame, context: Context, train: np.ndarray, val: np.ndarray, most_bytes: int = 1 << 30, keep: bool = True) -> DataFrame:
    """Every job (model, hyperparams as JSON, seed) trained in a task of its own: its result, and its best parameters.

    The row without a kind is the result (metric, epoch, n_parameters). The others are the parameters: kind is the
    name of a table, idx its row (-1 for a single vector) and vector its values. The data of a cell must fit one
    task, as in any single-machine trainer; it is broadcast behind a size check. Write the rows before they are read twice.
    Without keep, only results are given.
    """
    size = train.nbytes + val.nbytes + sum(f.nbytes for f in context.features)
    if size > most_bytes:
        raise ValueError(f"{size} bytes of training data exceed the bound of one task")
    spark = jobs.sparkSession
    shared = spark.sparkContext.broadcast((context, train, val))
    names = [f.split()[0] for f in STORED.split(", ")]
    jobs = jobs.distinct()
    hps = [r["hyperparams"] for r in jobs.select("hyperparams").collect()]
    threads = spare_threads(hps, spark.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for model, hp, seed in zip(pdf["model"], pdf["hyperparams"], pdf["seed"]):
                c, t, v = shared.value
                p, metric, epoch = fit(model, c, t, v, json.loads(hp), int(seed), threads=threads)
                head = (model, hp, int(seed), metric, epoch, sum(x.size for x in p.values()))
                yield pd.DataFrame([(*head, None, None, None)], columns=names)
                for kind, x in p.items() if keep else ():
                    table = x[None] if x.ndim == 1 else x.reshape(len(x), -1)
                    for at in range(0, len(table), 10_000):
                        idx = np.full(1, -1) if x.ndim == 1 else np.arange(at, min(at + 10_000, len(table)))
                        rows = pd.DataFrame({"kind": kind, "idx": idx, "vector": list(table[at : at + 10_000])})
                        yield rows.assign(model=model, hyperparams=hp, seed=int(seed), metric=metric, epoch=epoch, n_parameters=head[-1])[names]

    # a number of range partitions of its own keeps adaptive execution from putting small jobs into one task
    return jobs.repartitionByRange(max(1, len(hps)), *KEYS).mapInPandas(run, STORED)


def results_of(stored: DataFrame) -> DataFrame:
    """One row per job."""
    return stored.where("kind is null").drop("kind", "idx", "vector")


def parameters_of(stored: DataFrame, most_bytes: int = 1 << 30) -> dict[str, np.ndarray]:
    """The parameters of one job, which were made in one task and fit one again; a larger table raises."""
    rows = stored.where("kind is not null").select("kind", "idx", "vector")
    if (rows.agg(F.sum(F.size("vector") * 8)).first()[0] or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes of parameters")
    table = rows.orderBy("kind", "idx").toArrow()
    kinds, idx = np.array(table.column("kind").to_pylist()), np.asarray(table.column("idx"))
    out = {}
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        lists = table.column("vector").take(at).combine_chunks()
        values = np.asarray(lists.flatten())
        out[str(kind)] = values if idx[at[0]] < 0 else values.reshape(len(at), -1)
    return out


def train_jobs(jobs: DataFrame, context: Context, train: np.ndarray, val: np.ndarray, most_bytes: int = 1 << 30) -> DataFrame:
    """One row per job with its validation metric; the parameters are not kept."""
    return results_of(trained(jobs, context, train, val, most_bytes, keep=False))


def best_jobs(results: DataFrame) -> DataFrame:
    """The best hyperparameters of every model and seed."""
    return results.groupBy("model", "seed").agg(F.max_by(F.struct("hyperparams", "metric", "epoch"), F.struct("metric", "hyperparams")).alias("b")).select("model", "seed", "b.*")


def sample_space(space: dict[str, dict], rng: np.random.Generator) -> dict:
    """One random point of a space of int, float (with log or step) and categorical parameters."""
    out = {}
    for name, s in sorted(space.items()):
        if s["type"] == "categorical":
            out[name] = s["choices"][int(rng.integers(len(s["choices"])))]
            continue
        lo, hi = s["low"], s["high"]
        x = float(np.exp(rng.uniform(np.log(lo), np.log(hi)))) if s.get("log") else float(rng.uniform(lo, hi))
        if s.get("step"):
            x = min(hi, lo + s["step"] * round((x - lo) / s["step"]))
        out[name] = int(round(x)) if s["type"] == "int" else x
    return out


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations of the listed values."""
    out: list[dict] = [{}]
    for name, values in space.items():
        out = [{**o, name: v} for o in out for v in values]
    return out


def median_pruner(history: list[dict[int, float]], warmup: int = 5):
    """log function that stops a run whose metric falls under the median of finished runs at the same epoch."""

    def stop(epoch: int, metric: float) -> bool:
        there = [h[epoch] for h in history if epoch in h]
        return len(there) >= warmup and metric < float(np.median(there))

    return stop


def trial_counts(trials: DataFrame) -> DataFrame:
    """n_trials, n_legit (COMPLETE and PRUNED) and n_failed of a search."""
    return trials.agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("state").isin("COMPLETE", "PRUNED")).alias("n_legit"), F.count_if(F.col("state") == "FAIL").alias("n_failed"))


TRIAL = "trial long, hyperparams string, state string, metric double, epoch long, history map<int,double>"


def trial_wave(spark: SparkSession, model: str, c: Context, train: np.ndarray, val: np.ndarray, space: dict, trials: list[int], seed: int, earlier: list[dict[int, float]]) -> DataFrame:
    """One wave of random trials, each in a task of its own, pruned against the finished runs of the waves before."""
    shared = spark.sparkContext.broadcast((c, train, val, earlier))
    points = [(t, json.dumps(sample_space(space, np.random.default_rng((seed, t))), sort_keys=True)) for t in trials]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for trial, hp in zip(pdf["trial"], pdf["hyperparams"]):
                own, t, v, before = shared.value
                stop, seen, pruned = median_pruner(before), {}, []

                def log(epoch: int, metric: float, stop=stop, seen=seen, pruned=pruned) -> bool:
                    seen[epoch] = metric
                    pruned += [epoch] * stop(epoch, metric)
                    return bool(pruned)

                _, metric, epoch = fit(model, own, t, v, json.loads(hp), seed, log)
                yield pd.DataFrame([(trial, hp, "PRUNED" if pruned else "COMPLETE", metric, epoch, seen)], columns=[f.split()[0] for f in TRIAL.split(", ")])

    rows = spark.createDataFrame(points, "trial long, hyperparams string")
    return rows.repartitionByRange(max(1, len(points)), "trial").mapInPandas(run, TRIAL)


def search(spark: SparkSession, model: str, c: Context, train: np.ndarray, val: np.ndarray, space: dict, n_trials: int, path: str, wave: int = 8, seed: int = 42) -> DataFrame:
    """Random search with median pruning, in waves of trials over the cluster; every wave is appended to the table at path.

    Trials that stand there already count, so that a search resumes; COMPLETE and PRUNED trials count toward n_trials.
    A wave's trials see the runs of earlier waves. Only one small row per trial comes to the driver.
    """
    held = spark.read.schema(TRIAL).parquet(path).collect() if exists(spark, path) else []
    while len(held) < n_trials:
        taken = {r["trial"] for r in held}
        todo = [t for t in range(n_trials) if t not in taken][:wave]
        trial_wave(spark, model, c, train, val, space, todo, seed, [r["history"] for r in held if r["state"] == "COMPLETE"]).write.mode("append").parquet(path)
        held = spark.read.schema(TRIAL).parquet(path).collect()
    return spark.read.schema(TRIAL).parquet(path)
