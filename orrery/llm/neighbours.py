"""Most similar vectors for every vector: learned partitions of a neighbour graph and a router to them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.skew import ranked_within
from orrery.staging import stage

DIMENSION = r"_(?:D|pcaD)([0-9]+)$"


def graph(x: np.ndarray, k: int = 10, block: int = 1024) -> np.ndarray:
    """The k nearest others of every row by dot product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halved(x: np.ndarray, parts: int, labels: np.ndarray, rows: np.ndarray, first: int) -> None:
    """Start of the partitioning: cut along the main direction, again and again, in equal shares."""
    if parts == 1:
        labels[rows] = first
        return
    own = x[rows] - x[rows].mean(0)
    v = np.ones(own.shape[1]) / math.sqrt(own.shape[1])
    for _ in range(8):
        v = own.T @ (own @ v)
        v /= max(1e-30, np.linalg.norm(v))
    order, left = np.argsort(own @ v, kind="stable"), parts // 2
    cut = len(rows) * left // parts
    _halved(x, left, labels, rows[order[:cut]], first)
    _halved(x, parts - left, labels, rows[order[cut:]], first + left)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Label of every row: parts of at most slack times the mean size that cut few edges of the graph."""
    n, labels = len(x), np.zeros(len(x), np.int64)
    _halved(x, parts, labels, np.arange(n), 0)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.r_[src, dst], np.r_[dst, src]
    most = math.ceil(slack * n / parts)
    for _ in range(rounds):
        votes = np.bincount(src * parts + labels[dst], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), labels]
        movers = np.flatnonzero(gain > 0)
        sizes, moved = np.bincount(labels, minlength=parts), 0
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            if sizes[best[i]] < most:
                sizes[labels[i]] -= 1
                sizes[best[i]] += 1
                labels[i] = best[i]
                moved += 1
        if moved <= n // 500:
            break
    return labels


def fit_router(x: np.ndarray, labels: np.ndarray, near: np.ndarray, parts: int, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Softmax classifier from a vector to the parts of itself and its graph neighbours."""
    goal = np.zeros((len(x), parts), np.float32)
    goal[np.arange(len(x)), labels] = 1 + near.shape[1] / 2
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), labels[near].ravel()), 1)
    goal /= goal.sum(1, keepdims=True)
    w, b = np.stack([x[labels == p].mean(0) if (labels == p).any() else np.zeros(x.shape[1]) for p in range(parts)], 1).astype(np.float32) * 10, np.zeros(parts, np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - goal) / len(x)
        for i, (theta, g) in enumerate(((w, x.T @ d + 1e-6 * w), (b, d.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta -= (rate * (1 - t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
    return w, b


class Router:
    """A tree of classifiers per name; its leaves are the partitions, numbered over the whole tree."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, int]] = {}  # (name, node) → weights, bias, first child
        self.next: dict[str, int] = {}

    def add(self, name: str, node: int, w: np.ndarray, b: np.ndarray) -> None:
        """Make a leaf (0: the root) an inner node with new leaves as children."""
        first = self.next.get(name, 1)
        self.nodes[name, node] = w, b, first
        self.next[name] = first + len(b)

    def nbytes(self) -> int:
        """Bytes to broadcast."""
        return sum(w.nbytes + b.nbytes for w, b, _ in self.nodes.values())

    def route(self, name: str, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, order) of the most probable leaves of every row, at most probes, order 0 first."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(x)), np.zeros(len(x), np.float32))]
        while todo:
            node, rows, score = todo.pop()
            if (name, node) not in self.nodes:
                found.append((rows, np.full(len(rows), node), score))
                continue
            w, b, first = self.nodes[name, node]
            z = x[rows] @ w + b
            z -= z.max(1, keepdims=True)
            z += score[:, None] - np.log(np.exp(z).sum(1, keepdims=True))
            k = min(probes, z.shape[1])
            top = np.argpartition(-z, k - 1, axis=1)[:, :k]
            for child in np.unique(top):
                i, j = np.nonzero(top == child)
                todo.append((first + child, rows[i], z[i, child]))
        rows, leaves, scores = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-scores, rows))
        rows, leaves = rows[order], leaves[order]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(heads, np.diff(np.r_[heads, len(rows)]))
        keep = place < probes
        return rows[keep], leaves[keep], place[keep]


def _units(raw: np.ndarray, block: int = 4096) -> np.ndarray:
    """Rows of float32 at norm 1, in bounded blocks."""
    out = np.empty_like(raw)
    for at in range(0, len(raw), block):
        x = raw[at : at + block].astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        out[at : at + block] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _good_rows(features: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): not null, of length dim, finite, not all zero."""
    sizes = np.asarray(features.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim) if dim > 0 else np.empty(0, np.int64)
    flat = features.take(pa.array(rows)).flatten()
    raw = np.asarray(flat.cast(pa.float32()).fill_null(np.nan)).reshape(len(rows), max(dim, 1))
    size = np.abs(raw).max(1, initial=0)
    good = np.isfinite(size) & (size > 0)
    return rows[good], raw[good]


def prepared(df: DataFrame, name: str, item: str, features: str) -> DataFrame:
    """name, item, hash (of the vector at norm 1) and vec (binary float32) of the rows that take part: see nearest; staged by the caller, read several times."""
    dim = F.regexp_extract(name, DIMENSION, 1)
    rows = df.where(F.col(name).isNotNull() & F.col(item).isNotNull() & (dim != "")).select(F.col(name).alias("name"), dim.cast("int").alias("dim"), F.col(item).alias("item"), F.col(features).alias("features"))

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
            codes = np.asarray(names.indices)
            for code, one in enumerate(names.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                good, raw = _good_rows(batch.column(3).take(pa.array(at)), int(dims[at[0]]))
                if len(good):
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(good)), batch.column(2).take(pa.array(at[good])), pa.array(vector_hashes(_units(raw))), _vectors(raw)], ["name", "item", "hash", "vec"])

    return rows.mapInArrow(valid, "name string, item long, hash long, vec binary")


def _by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, items, unit vectors, vectors as they are) per name and batch of columns name, item, vec."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes = np.asarray(names.indices)
        for code, name in enumerate(names.dictionary.to_pylist()):
            at = pa.array(np.flatnonzero(codes == code))
            if len(at):
                raw = _matrix(batch.column(2).take(at))
                yield name, np.asarray(batch.column(1).take(at)), _units(raw), raw


def vector_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hash of every row of float32 vectors; equal rows have equal hashes."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(17).integers(0, 2**63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (bits + np.uint64(0x9E3779B97F4A7C15)) * odd
    return ((mixed ^ (mixed >> np.uint64(29))) * odd[::-1]).sum(1, dtype=np.uint64).astype(np.int64)


def _vectors(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def _train(children: dict[tuple[str, int], int]):
    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), -1)
        x = x[np.argsort(pdf["item"].to_numpy(), kind="stable")]
        parts = min(children[key[0], int(key[1])], max(1, len(x) // 8))
        if parts < 2:
            return pd.DataFrame({"name": [], "node": [], "w": [], "b": []})
        near = graph(x)
        labels = balanced_parts(x, near, parts)
        w, b = fit_router(x, labels, near, parts)
        return pd.DataFrame({"name": [key[0]], "node": [int(key[1])], "w": [w.tobytes()], "b": [b.tobytes()]})

    return train


def _exact(raw: np.ndarray, size: np.ndarray, q: np.ndarray, c: np.ndarray, cells: int) -> np.ndarray:
    """Cosines of the pairs (q, c) of rows, whose squared norms are given, in double precision and bounded blocks; 1 for equal rows."""
    out, block = np.empty(len(q)), max(1, cells // raw.shape[1])
    for at in range(0, len(q), block):
        s = slice(at, at + block)
        out[s] = np.einsum("ij,ij->i", raw[q[s]].astype(np.float64), raw[c[s]].astype(np.float64))
    return out / np.sqrt(size[q] * size[c])


def _within(s: np.ndarray, k: int, margin: float) -> np.ndarray:
    """The least value of every row of s that may belong to its k greatest, if values are off by half the margin."""
    return (np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else s.min(1)) - margin


def _search(k: int, least: float | None, cells: int = 4_000_000):
    def search(table: pa.Table) -> pa.Table:
        """One partition: home rows against home rows and visitors, both directions."""
        name = table.column("name")[0].as_py()
        items, home = np.asarray(table.column("item")), np.asarray(table.column("home"))
        raw = _matrix(table.column("vec"))
        order = np.lexsort((items, ~home))
        items, home, raw = items[order], home[order], raw[order]
        x = _units(raw)
        again = np.r_[False, (items[1:] == items[:-1]) & (home[1:] == home[:-1]) & (x[1:] == x[:-1]).all(1)]
        items, home, x, raw = items[~again], home[~again], x[~again], raw[~again]
        n, lead = int(home.sum()), bool(table.column("lead")[0].as_py())
        every = np.arange(len(x))
        size = _exact(raw, np.ones(len(x)), every, every, cells)
        # twice the bound of the error of a float32 product of unit rows, whose norms are themselves rounded
        margin = 2 * (x.shape[1] * 2.0**-24 + 2.0**-22)
        qs, cs, found = [], [], []

        def narrow(own: np.ndarray, others: np.ndarray, keep: np.ndarray, most: int) -> None:
            """Narrow keep for rows with many near ties by double precision products, in bounded blocks."""
            tied = np.flatnonzero(keep.sum(1) > 4 * most)
            wide, high = max(1, cells // x.shape[1]), max(1, cells // (2 * len(others)))
            for lo in range(0, len(tied), high):
                rows = tied[lo : lo + high]
                mine, t = raw[own[rows]].astype(np.float64), np.empty((len(rows), len(others)))
                for at in range(0, len(others), wide):
                    c = others[at : at + wide]
                    t[:, at : at + wide] = mine @ raw[c].astype(np.float64).T / np.sqrt(size[own[rows], None] * size[c])
                t[~keep[rows]] = -2
                keep[rows] &= t >= _within(t, most, 4 * x.shape[1] * 2.0**-53)[:, None]

        def best(rows: np.ndarray, others: np.ndarray) -> None:
            """The k nearest of rows among others (positions), by exact cosine and then by item."""
            block = max(16, cells // max(1, len(others)))  # bounds the candidates held at once, also among near copies
            most = min(k + len(others) - len(np.unique(items[others])), len(others))  # rows of one item count once
            for at in range(0, len(rows) if most else 0, block):
                own = rows[at : at + block]
                s = x[own] @ x[others].T
                s[items[own][:, None] == items[others][None, :]] = -2
                keep = (s >= _within(s, most, margin)[:, None]) & (s > -2)
                if least is not None:
                    keep &= s >= least - margin
                narrow(own, others, keep, most)
                i, j = np.nonzero(keep)
                if len(i):
                    cos = _exact(raw, size, own[i], others[j], cells)
                    o = np.lexsort((-cos, items[others][j], i))
                    i, j, cos = i[o], j[o], cos[o]
                    once = np.r_[True, (i[1:] != i[:-1]) | (items[others][j][1:] != items[others][j][:-1])]
                    i, j, cos = i[once], j[once], cos[once]
                    o = np.lexsort((items[others][j], -cos, i))
                    i, j, cos = i[o], j[o], cos[o]
                    heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    place = np.arange(len(i)) - np.repeat(heads, np.diff(np.r_[heads, len(i)]))
                    top = place < k
                    qs.append(own[i[top]])
                    cs.append(others[j[top]])
                    found.append(cos[top])

        if n:
            best(np.arange(n), np.arange(0 if lead else n, len(x)))
            if len(x) > n:
                best(np.arange(n, len(x)), np.arange(n))
        q, c = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (qs, cs))
        cos = np.concatenate(found) if found else np.empty(0)
        if least is not None:
            q, c, cos = q[cos >= least], c[cos >= least], cos[cos >= least]
        return pa.table({"name": pa.array([name] * len(q), pa.string()), "item": pa.array(items[q], pa.int64()), "other": pa.array(items[c], pa.int64()), "cosine": pa.array(cos, pa.float64())})

    return search


def _with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their vectors at norm 1, by which copies are told."""
    for batch in batches:
        wide = np.asarray(pc.binary_length(batch.column(3)))
        for n in np.unique(wide):
            part = batch.take(pa.array(np.flatnonzero(wide == n)))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], _vectors(_units(_matrix(part.column(3))))], ["name", "item", "hash", "vec", "unit"])


def copy_groups(rows: DataFrame, n_rows: int, k: int, most: int = 10_000) -> tuple[DataFrame, DataFrame | None]:
    """rows without most members of large groups of equal vectors, and the neighbours (name, item, other, cosine) of those left out.

    A member of a group of more than k items has the k least other items of the group as its nearest, all at cosine 1,
    and no vector needs more than the k + 1 least of them. So the other members need no search. Groups of at
    least 4(k + 1) rows and n_rows / most of all rows count as large: at most that many groups, whose vectors are
    broadcast. The groups are found by hashes, but only rows whose vector equals that of the group's least item are members.
    """
    spark = rows.sparkSession
    floor = max(4 * (k + 1), math.ceil(n_rows / most))
    large = rows.groupBy("name", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor).select("name", "hash").toArrow()
    if not large.num_rows:
        return rows, None
    found = F.broadcast(spark.createDataFrame(large))
    units = lambda part: part.select("name", "item", "hash", "vec").mapInArrow(_with_units, "name string, item long, hash long, vec binary, unit binary")
    own = units(rows.join(found, ["name", "hash"]))
    models = spark.createDataFrame(own.groupBy("name", "hash").agg(F.min(F.struct("item", "unit")).alias("m")).select("name", "hash", F.col("m.unit").alias("model")).toArrow())  # at most so many rows
    members = own.join(F.broadcast(models), ["name", "hash"]).where("unit = model").select("name", "hash", "item").distinct()
    ranked = ranked_within(members.withColumn("copies", F.concat_ws(":", "name", "hash")), "copies", ["item"], "copies")
    first = ranked.where(F.col("rank") <= k + 1).groupBy("name", "hash").agg(F.array_sort(F.collect_list("item")).alias("leaders"))
    leaders = F.broadcast(spark.createDataFrame(first.join(F.broadcast(models), ["name", "hash"]).toArrow()))
    other = own.join(leaders, ["name", "hash"]).where((F.col("unit") != F.col("model")) | F.array_contains("leaders", F.col("item")))
    kept = rows.join(found, ["name", "hash"], "left_anti").unionByName(other.select(*rows.columns))
    rest = ranked.where(F.col("rank") > k + 1).join(leaders.select("name", "hash", "leaders"), ["name", "hash"])
    return kept, rest.select("name", "item", F.explode(F.slice("leaders", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))


def nearest(df: DataFrame, name: str, item: str, features: str, k: int = 10, least: float | None = None, probes: int = 4, target: int = 1000, split_above: int = 4000, fit_rows: int = 6000, max_children: int = 128, depth: int = 3, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """The k most similar other items of every item of the same name: name, item, other, cosine, rank.

    Per name a bounded sample (about fit_rows vectors, by a hash of the item) gives a neighbour graph, which is cut
    in balanced parts; a softmax classifier learns which parts hold a vector's neighbours. Parts that turn out
    larger than split_above are cut again by their own sample, to the given depth. Every vector lives
    in its most probable part and visits the next probes - 1; within a part all home vectors meet home vectors and
    visitors as blocked matrix products, and exact cosines decide. A part that stays large (near copies)
    or has many visitors is a grid of units: chunks of target home rows times groups of visitors. The classifiers are broadcast behind a check of their size.

    Of a large group of equal vectors only the k + 1 least items are searched; copy_groups gives the others' neighbours.

    least keeps cosines of at least that value. Vectors that are null, not of the name's dimension (the number at
    the end of the name; names without one take no part), not finite or all zero take no part; rows with a null
    name or item neither. Repeated rows of an item count once. Equal cosines are ordered by other.
    """
    spark = df.sparkSession
    rows = stage(prepared(df, name, item, features), "vectors")
    found = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).collect()  # one row per embedding name
    if not found:
        return spark.createDataFrame([], "name string, item long, other long, cosine double, rank int")
    rows, spared = copy_groups(rows, sum(r["n"] for r in found), k)
    rows, wide = rows.select("name", "item", "vec"), {r["name"]: r["bytes"] for r in found}
    router = Router()
    open_nodes = {(r["name"], 0): r["n"] for r in found if r["n"] > split_above // 2}
    sizes: dict[tuple[str, int], tuple[int, int]] = {}
    for _ in range(depth):
        if not open_nodes:
            break
        shares = {at: fit_rows / n for at, n in open_nodes.items()}
        children = {at: min(max_children, math.ceil(n / target)) for at, n in open_nodes.items()}
        state = spark.sparkContext.broadcast((router, shares))

        def sample(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own, take = state.value
            for at, items, x, _ in _by_name(batches):
                _, leaf, _ = own.route(at, x, 1)
                chance = (items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(float) / 2**24
                keep = chance < np.array([take.get((at, int(v)), 0.0) for v in np.unique(leaf)])[np.searchsorted(np.unique(leaf), leaf)]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at] * int(keep.sum())), pa.array(leaf[keep], pa.int64()), pa.array(items[keep], pa.int64()), _vectors(x[keep])], ["name", "node", "item", "vec"])

        drawn = rows.mapInArrow(sample, "name string, node long, item long, vec binary").dropDuplicates(["name", "node", "item"])
        for r in drawn.groupBy("name", "node").applyInPandas(_train(children), "name string, node long, w binary, b binary").collect():
            b = np.frombuffer(r["b"], np.float32)
            router.add(r["name"], r["node"], np.frombuffer(r["w"], np.float32).reshape(-1, len(b)), b)
        if router.nbytes() > broadcast_bytes:
            raise ValueError("the classifiers are too large to broadcast; raise target")
        sizes = _leaf_sizes(rows, router, probes)
        open_nodes = {at: n for at, (n, _) in sizes.items() if n > split_above and at not in open_nodes}
    sizes = sizes or _leaf_sizes(rows, router, probes)
    # a part is one unit of work, or a grid of home chunks times groups of visitors where it is large
    chunks = {at: math.ceil(n / target) if n > 2 * split_above else 1 for at, (n, _) in sizes.items()}
    grids = {at: (chunks[at], max(1, math.ceil((v + n * (chunks[at] > 1)) / (4 * split_above)))) for at, (n, v) in sizes.items()}
    state = spark.sparkContext.broadcast((router, {at: g for at, g in grids.items() if g != (1, 1)}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = state.value
        for at, items, x, raw in _by_name(batches):
            i, leaf, order = own.route(at, x, probes)
            home, unit, lead = order == 0, np.zeros(len(i), np.int64), np.ones(len(i), bool)
            kinds, inverse = np.unique(leaf, return_inverse=True)
            many = np.array([cut.get((at, int(v)), (1, 1)) for v in kinds], np.int64).reshape(-1, 2)[inverse]
            if (many > 1).any():
                # every row goes to all units of its part first; a home row stays at home in its own chunk and visits the
                # others, and a visitor (also a visiting home row) stays in one group of each chunk
                rep = np.repeat(np.arange(len(i)), many.prod(1))
                heads = np.cumsum(many.prod(1)) - many.prod(1)
                unit = np.arange(len(rep)) - heads[rep]
                i, leaf, home, many = i[rep], leaf[rep], home[rep], many[rep]
                chunk, group = unit // many[:, 1], unit % many[:, 1]
                mixed = items[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                home &= chunk == (mixed % many[:, 0].astype(np.uint64)).astype(np.int64)
                stays = home | (group == (mixed // many[:, 0].astype(np.uint64) % many[:, 1].astype(np.uint64)).astype(np.int64))
                i, leaf, home, unit, lead = i[stays], leaf[stays], home[stays], unit[stays], (group == 0)[stays]
            for lo in range(0, len(i), 20_000):
                s = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * len(i[s])), pa.array(leaf[s], pa.int64()), pa.array(unit[s], pa.int64()), pa.array(home[s]), pa.array(lead[s]), pa.array(items[i[s]], pa.int64()), _vectors(raw[i[s]])],
                    ["name", "leaf", "unit", "home", "lead", "item", "vec"],
                )

    # every home row and visitor is sent to each unit of its grid column or row; tasks grow from 4 to 128 MB with the square root of all bytes
    total = sum((n * (chunks[at] > 1) * chunks[at] + n + v * chunks[at]) * (wide[at[0]] + 64) for at, (n, v) in sizes.items())
    n_tasks = max(1, math.ceil(total / min(128 << 20, max(4 << 20, math.sqrt(total * 1e5)))))
    placed = rows.mapInArrow(place, "name string, leaf long, unit long, home boolean, lead boolean, item long, vec binary").repartition(n_tasks, "name", "leaf", "unit")
    met = placed.groupBy("name", "leaf", "unit").applyInArrow(_search(k, least), "name string, item long, other long, cosine double")
    met = (met if spared is None else met.unionByName(spared)).repartition("name", "item")  # one exchange for both steps
    once = met.groupBy("name", "item", "other").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("name", "item").orderBy(F.desc("cosine"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_nearest(df: DataFrame, name: str, item: str, features: str, every: int = 100, k: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """The k most similar other items, by brute force over all rows, of the items divisible by every: name, item, other, cosine, rank.

    The stated query set is broadcast in blocks of at most about block_bytes, each one pass over all rows; every task passes on
    its own k best per query. Which rows take part, and ties, as in nearest.
    """
    spark = df.sparkSession
    rows = stage(prepared(df, name, item, features), "exact-vectors").select("name", "item", "vec")
    queries = rows.where(F.col("item") % every == 0).distinct()
    held = queries.agg(F.sum(F.octet_length("vec") + 64)).first()[0] or 0
    n_blocks, out = max(1, -(-held // block_bytes)), None
    for b in range(n_blocks):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("name", "item"), F.lit(n_blocks)) == b)
        table, block = own.orderBy("name", "item").toArrow(), {}
        for one in set(table.column("name").to_pylist()):
            part = table.filter(pc.equal(table.column("name"), one))
            block[one] = np.asarray(part.column("item")), _matrix(part.column("vec"))
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            unit = lambda x: x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
            best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for one, items, _, raw in _by_name(batches):
                if one not in shared.value:
                    continue
                asked, vectors = shared.value[one]
                top, who = best.setdefault(one, (np.full((len(asked), k), -2.0), np.full((len(asked), k), -1)))
                for at in range(0, len(asked), 1024):
                    for lo in range(0, len(items), 4096):
                        cos = unit(vectors[at : at + 1024]) @ unit(raw[lo : lo + 4096]).T
                        other = np.broadcast_to(items[lo : lo + 4096], cos.shape)
                        cos[asked[at : at + 1024, None] == other] = -2
                        cos, other = np.hstack([top[at : at + 1024], cos]), np.hstack([who[at : at + 1024], other])
                        order = np.lexsort((-cos, other))
                        cos, other = np.take_along_axis(cos, order, 1), np.take_along_axis(other, order, 1)
                        cos[:, 1:][other[:, 1:] == other[:, :-1]] = -2  # repeated rows of an item count once
                        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                        top[at : at + 1024], who[at : at + 1024] = np.take_along_axis(cos, order, 1), np.take_along_axis(other, order, 1)
            for one, (top, who) in best.items():
                i, j = np.nonzero(top > -2)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(i)), pa.array(shared.value[one][0][i]), pa.array(who[i, j]), pa.array(top[i, j])], ["name", "item", "other", "cosine"])

        part = rows.mapInArrow(search, "name string, item long, other long, cosine double")
        out = part if out is None else out.unionAll(part)
    once = out.groupBy("name", "item", "other").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("name", "item").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)


def _leaf_sizes(rows: DataFrame, router: Router, probes: int) -> dict[tuple[str, int], tuple[int, int]]:
    """(home rows, visitors) per partition, counted over all rows; as many numbers as there are partitions."""
    state = rows.sparkSession.sparkContext.broadcast(router)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for at, _, x, _ in _by_name(batches):
            _, leaf, order = state.value.route(at, x, probes)
            for visit in (0, 1):
                for one, n in zip(*np.unique(leaf[(order > 0) == visit], return_counts=True)):
                    held.setdefault((at, int(one)), [0, 0])[visit] += int(n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in held]), pa.array([b for _, b in held], pa.int64()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], ["name", "leaf", "n", "visits"])

    counted = rows.mapInArrow(count, "name string, leaf long, n long, visits long").groupBy("name", "leaf").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits")).collect()
    return {(r["name"], r["leaf"]): (r["n"], r["visits"]) for r in counted}


def evaluated(vectors: DataFrame, evaluation: DataFrame, few: int = 10_000) -> DataFrame:
    """The vectors whose embedding_name occurs in the evaluation table.

    Up to few distinct names the filter is a literal list, which also reaches the Parquet scan; beyond, a semi-join.
    """
    names = evaluation.select("embedding_name").where("embedding_name is not null").distinct()
    found = [r[0] for r in names.limit(few + 1).collect()]
    if len(found) > few:
        return vectors.join(names, "embedding_name", "left_semi")
    return vectors.where(F.col("embedding_name").isin(found))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """name, item_a < item_b of neighbours in either direction, once."""
    return neighbours.select("name", F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()
