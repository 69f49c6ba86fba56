"""Adam over parameter tables of which a step reads few rows, with the result of updating every row in every step.

In Adam every row moves in every step: its first moment lives on, and a penalty pulls at it. Doing so for each batch costs
rows × steps numbers in memory. Here a row is brought up to date when it is read.

Without a penalty a row that gets no gradient moves by sums that depend on its moments m, v and the step alone. All that it will
still move from step t on is m · Σ_j w_j / (√v · h_j + eps) with known w_j, h_j (j = 1, 2, …), which a Gauss quadrature of these
weights gives to rounding with some nodes. So the table holds where each row would come to rest, which doesn't change with time.

With a penalty the pull depends on the row itself, and its steps are done one by one, but on pieces that stay in the processor's
cache: no row falls behind by more than `behind` steps. Pieces don't depend on each other and can be shared between threads.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np

from orrery.operators.autodiff import Table

B1, B2, EPS = 0.9, 0.999, 1e-8


def rest_rule(t: int, terms: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Nodes h and weights w with Σ_q w_q / (s · h_q + eps) = Σ_j B1^j / (1 - B1^(t+j)) / (s · h_j + eps), h_j = √(B2^j / (1 - B2^(t+j))).

    B1^400 is under 1e-18. The h_j differ most in the first steps, which take more nodes.
    """
    j, nodes = np.arange(1, terms + 1), 24 if t < 10 else 12 if t < 100 else 8 if t < 300 else 6 if t < 1000 else 5
    w, h = B1**j / (1 - B1 ** (t + j)), np.sqrt(B2**j / (1 - B2 ** (t + j)))
    basis, diag, off = np.zeros((nodes, terms)), np.zeros(nodes), np.zeros(nodes)
    basis[0] = np.sqrt(w / w.sum())
    for q in range(nodes):  # Lanczos with full orthogonalisation
        u = h * basis[q]
        diag[q] = basis[q] @ u
        for _ in range(2):
            u -= (basis[: q + 1] @ u) @ basis[: q + 1]
        off[q] = np.sqrt(u @ u)
        if q + 1 < nodes:
            basis[q + 1] = u / off[q]
    at, vectors = np.linalg.eigh(np.diag(diag) + np.diag(off[:-1], 1) + np.diag(off[:-1], -1))
    return at, w.sum() * vectors[0] ** 2


class Adam:
    """Parameters, their moments, and the step that each row has reached.

    With c = 2 · l2 (1 without a penalty) the moments are kept divided by (1 - B1) · c and (1 - B2) · c², so that a step adds the
    row and its square to them. A row and its two moments lie side by side, as in large tables the time goes where memory is far apart.
    """

    def __init__(self, p: dict[str, np.ndarray], lr: float, l2: float = 0.0, behind: int = 64, piece: int = 65_536, threads: int = 1) -> None:
        self.shape = {n: x.shape for n, x in p.items()}
        self.state = {n: np.hstack([x.reshape(len(x), -1), np.zeros((len(x), 2 * x[:1].size))]) for n, x in p.items()}
        self.x, self.m, self.v = ({n: np.split(x, 3, 1)[i] for n, x in self.state.items()} for i in range(3))
        self.at = {n: np.zeros(len(x), np.int64) for n, x in self.x.items()}
        self.lr, self.l2, self.t, self.behind, self.piece = lr, l2, 0, behind, piece
        self.c = 2 * l2 if l2 else 1.0
        self.rule, self.fade = rest_rule(0), np.array([[B1, B2]]) ** np.arange(1024)[:, None]
        self.pool = ThreadPoolExecutor(threads) if l2 and threads > 1 else None

    def tables(self) -> dict[str, Table]:
        """The parameters as leaves of one step's loss."""
        return {n: Table(shape, lambda rows, n=n: self.rows(n, rows)) for n, shape in self.shape.items()}

    def rows(self, name: str, rows: np.ndarray | None) -> np.ndarray:
        """Rows of a table (None: all) as they are after the steps so far."""
        if self.l2:
            behind = np.arange(len(self.x[name])) if rows is None else np.unique(rows)
            self._catch_up(name, behind[self.at[name][behind] < self.t])
        if rows is None:
            rows = slice(None)
        if self.l2:
            return self.x[name][rows].reshape(-1, *self.shape[name][1:])
        x, m, v = self._held(name, rows)
        return (x + self._to_rest(m, v)).reshape(-1, *self.shape[name][1:])

    def values(self) -> dict[str, np.ndarray]:
        """All parameters after the steps so far, as arrays of their own."""
        out = {}
        for n, x in self.x.items():
            out[n] = np.empty_like(x)
            step = max(1, self.piece // x.shape[1])
            for a in range(0, len(x), step):
                rows = np.arange(a, min(a + step, len(x)))
                out[n][rows] = self.rows(n, rows).reshape(len(rows), -1)
            out[n] = out[n].reshape(self.shape[n])
        return out

    def step(self, tables: dict[str, Table]) -> None:
        """One step along the gradients of the leaves; a leaf that was never used stays."""
        found = {n: leaf.gradient() for n, leaf in tables.items()}
        now = self.t + 1
        scale, eps = self._scale(now)
        rule = None if self.l2 else rest_rule(now)
        for n, (rows, x, g) in found.items():
            if g is None:
                continue
            if rows is None:
                rows = slice(None)
            x, g = x.reshape(len(x), -1), g.reshape(len(g), -1) / self.c
            _, m, v = self._held(n, rows)
            g = g + x if self.l2 else g
            m, v = B1 * m + g, B2 * v + g * g
            x = x - scale * m / (np.sqrt(v) + eps)
            self.state[n][rows] = np.hstack([x if self.l2 else x - self._to_rest(m, v, rule), m, v])
            self.at[n][rows] = now
        self.t = now
        if self.l2:
            if now % self.behind == 0:
                for n, at in self.at.items():
                    self._catch_up(n, np.flatnonzero(at < now))
        else:
            self.rule = rule

    def _scale(self, t: int) -> tuple[float, float]:
        """Step t moves a row by the first of these times m / (√v + the second)."""
        size = self.c * np.sqrt((1 - B2) / (1 - B2**t))
        return self.lr * (1 - B1) * self.c / (1 - B1**t) / size, EPS / size

    def _held(self, name: str, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a table, and the moments that they have by now; without a penalty, no gradient came since."""
        own = self.state[name]
        x, m, v = np.split(own if isinstance(rows, slice) else own.take(rows, 0), 3, 1)
        if self.l2:
            return x, m, v
        if self.t >= len(self.fade):
            self.fade = np.array([[B1, B2]]) ** np.arange(2 * self.t)[:, None]
        fade = self.fade[self.t - self.at[name][rows]]
        return x, m * fade[:, :1], v * fade[:, 1:]

    def _to_rest(self, m: np.ndarray, v: np.ndarray, rule: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """How far rows still move down if no gradient comes."""
        s, out = np.sqrt(v), np.zeros_like(m)
        room, own = np.empty_like(m), np.sqrt(1 - B2)
        for h, w in zip(*(rule or self.rule)):
            np.add(s, EPS / (h * own), out=room)
            np.divide(w / (h * own) * self.lr * (1 - B1), room, out=room)
            out += room
        out *= m
        return out

    def _catch_up(self, name: str, rows: np.ndarray) -> None:
        """The steps that rows have left out, under the penalty alone."""
        if not len(rows):
            return
        at, k = self.at[name], self.x[name].shape[1]
        rows = rows[np.argsort(at[rows], kind="stable")]
        first = int(at[rows[0]]) + 1
        scales = [self._scale(t) for t in range(first, self.t + 1)]
        size = max(1, self.piece // k)

        def piece(a: int) -> None:
            own = rows[a : a + size]
            since = at[own]
            x, m, v = (y.ravel() for y in np.split(self.state[name].take(own, 0), 3, 1))
            room = np.empty_like(x)
            start = int(since[0]) + 1
            sizes = np.searchsorted(since, np.arange(start, self.t + 1)) * k
            for n, (scale, eps) in zip(sizes.tolist(), scales[start - first :]):
                xs, ms, vs, r = x[:n], m[:n], v[:n], room[:n]
                ms *= B1
                ms += xs
                vs *= B2
                np.multiply(xs, xs, out=r)
                vs += r
                np.sqrt(vs, out=r)
                r += eps
                np.divide(ms, r, out=r)
                r *= scale
                xs -= r
            self.state[name][own], at[own] = np.hstack([y.reshape(-1, k) for y in (x, m, v)]), self.t

        list((self.pool.map if self.pool else map)(piece, range(0, len(rows), size)))
