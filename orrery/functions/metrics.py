"""Ranking metrics: for lists with any number of relevant items, and from the rank of one held-out item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (5, 10, 20)
METRICS = ("precision", "recall", "f1", "map", "ndcg")


def _hits(top: Column, truth: Column, k: int) -> Column:
    """1 or 0 at each of the first k places of the list."""
    return F.transform(F.slice(top, 1, k), lambda x: F.when(F.array_contains(truth, x), 1.0).otherwise(0.0))


def list_metrics(top: Column, truth: Column, k: int) -> dict[str, Column]:
    """The five metrics of a ranked list against a set of relevant items (arrays without nulls).

    Precision divides by k also for shorter lists. Without relevant items, or with an empty list, all are 0.
    """
    hits, wanted = _hits(top, truth, k), F.size(truth)
    found = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x)
    p, r = found / k, F.when(wanted > 0, found / wanted).otherwise(0.0)
    best = F.least(F.lit(k), wanted)
    summed = F.aggregate(
        F.transform(hits, lambda x, i: F.struct(x.alias("hit"), i.alias("i"))),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct((acc.n + x.hit).alias("n"), (acc.s + x.hit * (acc.n + x.hit) / (x.i + 1)).alias("s")),
        lambda acc: acc.s,
    )
    gain = F.aggregate(F.transform(hits, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = wanted > 0
    return {
        "precision": p,
        "recall": r,
        "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0),
        "map": F.when(some, summed / best).otherwise(0.0),
        "ndcg": F.when(some, gain / ideal).otherwise(0.0),
    }


def rank_metrics(rank: Column, k: int) -> dict[str, Column]:
    """The metrics of one held-out item at a rank >= 1; smaller ranks raise."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rank = F.when(rank < 1, F.raise_error(F.lit("ranks start at 1")).cast("long")).otherwise(rank)
    hit = F.when(rank <= k, 1.0).otherwise(0.0)
    return {
        "hitrate": hit,
        "precision": hit / k,
        "recall": hit,
        "f1": 2 * hit / (k + 1),
        "map": hit / rank,
        "mrr": hit / rank,
        "ndcg": hit / F.log2(rank + 1.0),
    }


def long_metrics(df: DataFrame, keys: list[str], by_k, ks: tuple[int, ...] = KS) -> DataFrame:
    """keys, metric, k, value: one row per metric and k; by_k(k) gives name → column."""
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), c.cast("double").alias("value")) for k in ks for m, c in by_k(k).items()]
    return df.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.metric", "m.k", "m.value")


def mean_metrics(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean over users per metric and k."""
    return long.groupBy(*by, "metric", "k").agg(F.count(F.lit(1)).alias("n_users"), F.avg("value").alias("mean"))


def selected(long: DataFrame, metrics: tuple[str, ...] = ("recall", "ndcg"), ks: tuple[int, ...] = KS, derived: bool = False) -> DataFrame:
    """The rows of the primary metrics at the wanted k; with derived, all other metrics too."""
    rows = long.where(F.col("k").isin(*ks))
    return rows if derived else rows.where(F.col("metric").isin(*metrics))
