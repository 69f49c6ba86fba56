"""A small reverse-mode differentiator over numpy arrays, enough for pairwise-ranking models."""

from __future__ import annotations

import numpy as np


class Value:
    """An array with the operations that made it; backward() fills grad of everything it depends on."""

    __array_priority__ = 100

    def __init__(self, data, parents: tuple[Value, ...] = (), back=None) -> None:
        self.data = np.asarray(data, np.float64)
        self.parents, self.back, self.grad = parents, back, None

    def _to(self, g: np.ndarray) -> None:
        while g.ndim > self.data.ndim:
            g = g.sum(0)
        for axis, n in enumerate(self.data.shape):
            if n == 1 and g.shape[axis] != 1:
                g = g.sum(axis, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g

    def backward(self) -> None:
        """Gradients of this scalar."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                v.back(v.grad)

    def __add__(self, other):
        o = as_value(other)
        return Value(self.data + o.data, (self, o), lambda g: (self._to(g), o._to(g)))

    __radd__ = __add__

    def __mul__(self, other):
        o = as_value(other)
        return Value(self.data * o.data, (self, o), lambda g: (self._to(g * o.data), o._to(g * self.data)))

    __rmul__ = __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + (-as_value(other))

    def __rsub__(self, other):
        return as_value(other) + (-self)

    def __matmul__(self, other):
        o = as_value(other)

        def back(g):
            if not isinstance(self, Constant):
                self._to(g @ np.swapaxes(o.data, -1, -2))
            a = self.data.reshape(-1, self.data.shape[-1]) if o.data.ndim == 2 else self.data
            h = g.reshape(-1, g.shape[-1]) if o.data.ndim == 2 else g
            o._to(np.swapaxes(a, -1, -2) @ h)

        return Value(self.data @ o.data, (self, o), back)

    def take(self, rows: np.ndarray) -> Value:
        """Rows of a table."""

        def back(g):
            full = np.zeros_like(self.data)
            np.add.at(full, rows, g)
            self._to(full)

        return Value(self.data[rows], (self,), back)

    def sum(self, axis=None, keepdims: bool = False) -> Value:
        """Sum over an axis."""

        def back(g):
            self._to(np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.data.shape))

        return Value(self.data.sum(axis, keepdims=keepdims), (self,), back)

    def mean(self) -> Value:
        """Mean of all elements."""
        return self.sum() * (1.0 / max(1, self.data.size))

    def reshape(self, *shape: int) -> Value:
        """Another shape of the same elements."""
        return Value(self.data.reshape(*shape), (self,), lambda g: self._to(g.reshape(self.data.shape)))

    def _unary(self, out: np.ndarray, slope: np.ndarray) -> Value:
        return Value(out, (self,), lambda g: self._to(g * slope))

    def relu(self) -> Value:
        """max(x, 0)"""
        return self._unary(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def tanh(self) -> Value:
        """Hyperbolic tangent."""
        t = np.tanh(self.data)
        return self._unary(t, 1 - t * t)

    def sigmoid(self) -> Value:
        """Logistic function."""
        s = 0.5 * (1 + np.tanh(0.5 * self.data))
        return self._unary(s, s * (1 - s))

    def log(self, add: float = 0.0) -> Value:
        """log(x + add)"""
        return self._unary(np.log(self.data + add), 1 / (self.data + add))

    def softmax(self, axis: int = -1, mask: np.ndarray | None = None) -> Value:
        """Softmax; masked places and wholly masked rows are 0."""
        z = self.data if mask is None else np.where(mask, self.data, -np.inf)
        top = z.max(axis, keepdims=True)
        e = np.exp(z - np.where(np.isfinite(top), top, 0))
        s = e / np.maximum(e.sum(axis, keepdims=True), 1e-300)
        return Value(s, (self,), lambda g: self._to(s * (g - (g * s).sum(axis, keepdims=True))))

    def unit(self) -> Value:
        """Rows at norm 1; zero rows stay."""
        n = np.sqrt((self.data**2).sum(-1, keepdims=True))
        n = np.where(n > 0, n, 1)
        u = self.data / n
        return Value(u, (self,), lambda g: self._to((g - u * (g * u).sum(-1, keepdims=True)) / n))

    def maximum(self, other: Value) -> Value:
        """Element-wise maximum; the first wins a tie."""
        first = self.data >= other.data
        return Value(np.where(first, self.data, other.data), (self, other), lambda g: (self._to(g * first), other._to(g * ~first)))


class Constant(Value):
    """Data without a gradient."""

    def _to(self, g: np.ndarray) -> None:
        pass


class Table(Value):
    """A leaf whose rows are read by read(rows), where None means all, and whose gradient is kept for the rows that were taken."""

    def __init__(self, shape: tuple[int, ...], read) -> None:
        self.shape, self.read, self.whole, self.held, self.taken = shape, read, None, [], []
        self.parents, self.back, self.grad = (), None, None

    @property
    def data(self) -> np.ndarray:
        """The whole table."""
        if self.whole is None:
            self.whole = self.read(None).reshape(self.shape)
        return self.whole

    def take(self, rows: np.ndarray) -> Value:
        """Rows of the table; the whole of it is not read, and its gradient not filled up."""
        own = next((x for r, x in self.held if r is rows), None)
        if own is None:
            flat = np.asarray(rows).reshape(-1)
            own = self.read(flat).reshape(*np.shape(rows), *self.shape[1:])
            self.held.append((rows, own))
        shape = (-1, *self.shape[1:])
        return Value(own, (self,), lambda g: self.taken.append((np.asarray(rows).reshape(-1), own.reshape(shape), g.reshape(shape))))

    def gradient(self) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
        """Distinct rows, their values and their gradient. Rows are None for the whole table; all are None if nothing used it."""
        if not self.taken:
            return None, None if self.grad is None else self.data, self.grad
        rows = np.concatenate([r for r, _, _ in self.taken])
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.diff(rows[order], prepend=-1))
        rows, first = rows[order][at], order[at]
        g = np.add.reduceat(np.concatenate([g for _, _, g in self.taken])[order], at, axis=0)
        if self.grad is None:
            return rows, np.concatenate([x for _, x, _ in self.taken])[first], g
        full = self.grad.copy()
        full[rows] += g
        return None, self.data, full


def as_value(x) -> Value:
    """x as a Value."""
    return x if isinstance(x, Value) else Value(x)


def concat(values: list[Value]) -> Value:
    """Values side by side along the last axis."""
    cuts = np.cumsum([v.data.shape[-1] for v in values])[:-1]

    def back(g):
        for v, part in zip(values, np.split(g, cuts, axis=-1)):
            v._to(part)

    return Value(np.concatenate([v.data for v in values], -1), tuple(values), back)
