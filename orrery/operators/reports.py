"""Consolidation, cross-seed aggregates, best cells and classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import names


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Columns metric@k → keys, metric, k, metric_value; other columns are left out."""
    found = [c for c in wide.columns if "@" in c and c.split("@")[1].isdigit()]
    long = wide.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in found], "_name", "metric_value")
    return long.select(*keys, F.split("_name", "@")[0].alias("metric"), F.split("_name", "@")[1].cast("int").alias("k"), "metric_value")


def evaluation_long(wide: DataFrame, keys: list[str], model: str = "model_name", embedding: str = "embedding_name") -> DataFrame:
    """The tidy evaluation table: long metrics with the parts of the embedding name."""
    parts = names.parse_embedding_name(F.col(embedding))
    return to_long(wide, keys).withColumn("_p", parts).select(*keys, "metric", "k", "metric_value", "_p.extractor", "_p.fusion", F.col("_p.condition").alias("cond"), "_p.embedding_dim")


def pairwise_long(tests: DataFrame) -> DataFrame:
    """The pairwise table with the parts of both configurations and its test type."""
    out = tests.withColumn("test_type", F.lit("wilcoxon"))
    for s in ("a", "b"):
        c = names.split_config(F.col(f"config_{s}"))
        e = names.parse_embedding_name(c["embedding_name"])
        out = out.withColumns({f"recommender_{s}": c["recommender"], f"extractor_{s}": e["extractor"], f"fusion_{s}": e["fusion"], f"cond_{s}": e["condition"], f"embedding_dim_{s}": e["embedding_dim"]})
    return out


def friedman_long(tests: DataFrame) -> DataFrame:
    """The Friedman table with its test type."""
    return tests.withColumn("test_type", F.lit("friedman"))


def cell_means(df: DataFrame, keys: list[str], value: str = "metric_value") -> DataFrame:
    """n_users (all rows of the cell) and the mean of its values; NaN and null values don't enter the mean; null keys are kept."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"), F.avg(v).alias("mean"))


def across(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (null for one repeat), median, extremes and number over repeats such as seeds."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def best_per(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of the largest value per key, ties by the smallest tie columns: an aggregate of one struct, combined before the shuffle.

    Rows are compared as structs (minus the value, tie columns); value must be a number without nulls.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(value)).alias("_v"), *tie)).alias("_r"))
    return pick.select(*keys, "_r.*")


def summary_long(summary: DataFrame, metric: str, k: int, config: str = "config") -> DataFrame:
    """The tidy form of a bootstrap summary (config, n_users, mean, ci_lower, ci_upper, ci_width) with the parts of the configuration."""
    c = names.split_config(F.col(config))
    e = names.parse_embedding_name(c["embedding_name"])
    parts = [c["recommender"].alias("recommender"), c["embedding_name"].alias("embedding_name"), e["extractor"].alias("extractor"), e["fusion"].alias("fusion"), e["condition"].alias("cond"), e["embedding_dim"].alias("embedding_dim")]
    return summary.select(*(x for x in summary.columns if x not in ("metric", "k")), F.coalesce(*(F.col(x) for x in ("metric",) if x in summary.columns), F.lit(metric)).alias("metric"), F.coalesce(*(F.col(x) for x in ("k",) if x in summary.columns), F.lit(k)).alias("k"), *parts)


def consolidated(parts: dict[str, DataFrame | None], keys: list[str]) -> dict[str, DataFrame]:
    """One table per kind that is there: the long evaluation with one row per cell, bootstrap intervals, and both kinds of tests together."""
    out = {}
    if parts.get("evaluation") is not None:
        out["evaluation"] = cell_means(parts["evaluation"], keys)
    if parts.get("bootstrap") is not None:
        out["bootstrap"] = parts["bootstrap"]
    tests = [f(parts[k]) for k, f in (("friedman", friedman_long), ("pairwise", pairwise_long)) if parts.get(k) is not None]
    if tests:
        out["tests"] = tests[0] if len(tests) == 1 else tests[0].unionByName(tests[1], allowMissingColumns=True)
    return out


def report_sections(means: DataFrame, n: int = 10, metric: str = "ndcg", k: int = 10) -> dict[str, DataFrame]:
    """The sections of a report on cell means (dataset, recommender, embedding_name, metric, k, n_users, mean): the best n, the best per recommender, frozen against finetuned."""
    rows = means.where((F.col("metric") == metric) & (F.col("k") == k) & F.col("mean").isNotNull()).withColumn("cond", names.condition_of(F.col("embedding_name")))
    return {
        f"Best {n} by {metric}@{k}": top_n(rows, "mean", n, ["dataset", "recommender", "embedding_name"]),
        "Best per recommender": best_per(rows, ["dataset", "cond", "recommender"], "mean", ["embedding_name"]),
        "Frozen and finetuned": condition_delta(rows, ["dataset", "recommender"], "cond", "mean"),
    }


def top_n(df: DataFrame, value: str, n: int, tie: list[str]) -> DataFrame:
    """The n rows of the largest value (the report's length)."""
    return df.orderBy(F.desc(value), *tie).limit(n)


def condition_delta(df: DataFrame, keys: list[str], cond: str, value: str) -> DataFrame:
    """Best frozen and best finetuned value per key and their difference."""
    wide = df.groupBy(*keys).pivot(cond, ["frozen", "finetuned"]).agg(F.max(value))
    return wide.withColumn("delta", F.col("finetuned") - F.col("frozen"))


def remaining_cost(cells: DataFrame) -> DataFrame:
    """role, n_open, mean_seconds, estimate_seconds of cells (role, state, duration_seconds); no estimate without a finished cell."""
    done = cells.where("state = 'done' and duration_seconds is not null").groupBy("role").agg(F.avg("duration_seconds").alias("mean_seconds"))
    left = cells.where("state in ('pending', 'failed', 'running')").groupBy("role").agg(F.count(F.lit(1)).alias("n_open"))
    return left.join(done, "role", "left").select("role", "n_open", "mean_seconds", (F.col("n_open") * F.col("mean_seconds")).alias("estimate_seconds"))


def latest_state(log: DataFrame, key: str, order: str, more: list[str] = ()) -> DataFrame:
    """The last state of every cell of an append-only log, with more columns of that row."""
    return log.groupBy(key).agg(F.max_by(F.struct("state", *more), order).alias("_last")).select(key, "_last.*")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """actual, predicted, n over all pairs of classes, zeros kept; classes are the few values of both columns."""
    counted = df.groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = counted.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    grid = classes.select(F.col("c").alias("actual")).join(classes.select(F.col("c").alias("predicted")))
    return grid.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support from a confusion table; undefined ratios are 0."""
    diag = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(diag).alias("tp"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return rows.join(cols, "label").select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def report_means(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of a class report."""
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    one = report.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(w(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return one


def topk_accuracy(df: DataFrame, truth: str, scores: Column, k: int = 5) -> DataFrame:
    """top1, topk and summed cross-entropy of rows with an array of class scores (classes 0, 1, …)."""
    own = F.element_at(scores, F.col(truth).cast("int") + 1)
    ahead = F.size(F.filter(scores, lambda s: s > own))
    peak = F.array_max(scores)
    loss = F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - peak))) + peak - own
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(ahead < 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.when(ahead < F.least(F.lit(k), F.size(scores)), 1.0).otherwise(0.0)).alias("topk"), F.sum(loss).alias("loss"))
