"""Vector and fusion functions as column expressions over arrays; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean norm; 0 for an empty vector, null for null."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """v at norm 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def finite(v: Column) -> Column:
    """Whether v is not null and all its elements are finite numbers."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _fold(vs: list[Column], op) -> Column:
    out = vs[0]
    for v in vs[1:]:
        out = F.zip_with(out, v, op)
    return out


def _scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(by))


def same_size(vs: list[Column]) -> Column:
    """Whether all vectors have one length, as the element-wise fusions need."""
    out = F.lit(True)
    for v in vs[1:]:
        out = out & (F.size(vs[0]) == F.size(v))
    return out


def fuse_sum(vs: list[Column]) -> Column:
    """Element-wise sum."""
    return _fold(vs, lambda a, b: a + b)


def fuse_mean(vs: list[Column]) -> Column:
    """Element-wise mean."""
    return F.transform(fuse_sum(vs), lambda x: x / len(vs))


def fuse_prod(vs: list[Column]) -> Column:
    """Element-wise product."""
    return _fold(vs, lambda a, b: a * b)


def fuse_max(vs: list[Column]) -> Column:
    """Element-wise maximum."""
    return _fold(vs, lambda a, b: F.greatest(a, b))


def fuse_weighted(vs: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean; weights are brought to sum 1 and are equal by default; a sum of 0 is an error."""
    w = [1.0] * len(vs) if weights is None else [float(x) for x in weights]
    if len(w) != len(vs):
        raise ValueError(f"{len(vs)} sources need as many weights, not {len(w)}")
    if sum(w) == 0:
        raise ValueError("the weights sum to 0")
    return fuse_sum([_scaled(v, x / sum(w)) for v, x in zip(vs, w)])


def fuse_attention(vs: list[Column], logits: list[float] | None = None) -> Column:
    """Weighted mean with the softmax of the logits (all 0 by default)."""
    z = [0.0] * len(vs) if logits is None else [float(x) for x in logits]
    return fuse_weighted(vs, [math.exp(x - max(z)) for x in z])


def fuse_gated(vs: list[Column], logits: list[float] | None = None) -> Column:
    """Weighted mean with sigmoid gates, brought to sum 1."""
    z = [0.0] * len(vs) if logits is None else [float(x) for x in logits]
    return fuse_weighted(vs, [1 / (1 + math.exp(-x)) for x in z])


def fuse_concat(vs: list[Column]) -> Column:
    """All vectors one after the other; lengths may differ."""
    return F.concat(*vs)


#: Offline fusions: function and whether the lengths must agree.
FUSIONS = {
    "mean": (fuse_mean, True),
    "sum": (fuse_sum, True),
    "prod": (fuse_prod, True),
    "max_pool": (fuse_max, True),
    "weighted_mean": (fuse_weighted, True),
    "attention_weighted": (fuse_attention, True),
    "gated": (fuse_gated, True),
    "concat": (fuse_concat, False),
}


def register_fusion(name: str, equal_lengths: bool = True):
    """Decorator that makes a function of source vectors (columns of equal meaning) and options a fusion known by name."""

    def add(function):
        FUSIONS[name] = (function, equal_lengths)
        return function

    return add


def fuse(strategy: str, vs: list[Column], normalize: bool = True, **options) -> Column:
    """One fusion by name; sources are normalised first unless told otherwise; unequal lengths raise."""
    if strategy not in FUSIONS:
        raise ValueError(f"unknown fusion {strategy}; known: {', '.join(sorted(FUSIONS))}")
    function, equal = FUSIONS[strategy]
    own = [l2_normalize(v) if normalize else F.transform(v, lambda x: x.cast("double")) for v in vs]
    out = function(own, **options)
    return F.when(same_size(vs), out).otherwise(F.raise_error(F.lit(f"{strategy}: the sources differ in length"))) if equal else out


def expand_grid(strategy: str, weights=(0.3, 0.5, 0.7), components=(64, 128, 256), per_source=(32, 64, 128)) -> dict[str, dict]:
    """Name suffix → options of a strategy's variants."""
    if strategy == "weighted_mean":
        return {f"_w{w}": {"weights": [w, round(1 - w, 10)]} for w in weights}
    if strategy in ("pca", "concat_pca"):
        return {f"_nc{n}": {"components": n} for n in components}
    if strategy == "pca_per_model":
        return {f"_nc{n}": {"components": n} for n in per_source}
    return {"": {}}
