"""Paired comparison of configurations: rank tests, corrections, effect sizes, intervals, families.

Per-user values are first counted per distinct value (of a configuration, or of a pair's difference), so that ranks,
effect sizes and resamples work on histograms: a configuration with a third of all rows never meets one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import names

FAMILIES = ("backbone_within_model", "model_within_backbone", "fusion_within_model", "frozen_vs_finetuned", "all_pairs")


def clean_values(df: DataFrame, keys: list[str], value: str = "metric_value") -> DataFrame:
    """One value per key: nulls and NaN are left out, repeated rows count once (the least of differing values)."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.min(value).alias("value"))


GROUP = ["model", "base", "condition"]
#: What the configurations of a family's group have in common, and their kind.
_SHARED = {"backbone_within_model": ("backbone", ("model", "condition")), "model_within_backbone": ("backbone", ("base", "condition")), "fusion_within_model": ("fusion", ("model", "condition")), "all_pairs": (None, ())}


def families(cells: DataFrame, wanted: tuple[str, ...] = FAMILIES[:4]) -> DataFrame:
    """family, model, base, condition, config_a < config_b of cells (model, embedding_name).

    model, base and condition are those of the group that the pair belongs to, null where a group is not about them. In
    frozen_vs_finetuned the frozen configuration comes first.
    """
    unknown = [f for f in wanted if f not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown families {unknown}; known: {sorted(FAMILIES)}")
    e = F.col("embedding_name")
    c = cells.select("model", "embedding_name").dropna().distinct()
    c = c.select("model", names.config_key(F.col("model"), e).alias("config"), names.embedding_kind(e).alias("kind"), names.backbone_base(e).alias("base"), names.condition_of(e).alias("condition"))
    out = None
    for family in wanted:
        if family == "frozen_vs_finetuned":
            of = lambda condition: F.max(F.when(F.col("condition") == condition, F.col("config")))
            pairs = c.where("kind <> 'none'").groupBy("model", "base").agg(of("frozen").alias("config_a"), of("finetuned").alias("config_b")).dropna().withColumn("condition", F.lit(None).cast("string"))
        else:
            kind, shared = _SHARED[family]
            rows = c.where(F.col("kind") == kind) if kind else c
            rows = rows.select(*(F.col(g) if g in shared else F.lit(None).cast("string").alias(g) for g in GROUP), "config")
            other = rows.select(*(F.col(g).alias(f"_{g}") for g in shared), F.col("config").alias("config_b"))
            met = F.col("config") < F.col("config_b")
            for g in shared:
                met = met & (F.col(g) == F.col(f"_{g}"))
            pairs = rows.join(other, met).withColumnRenamed("config", "config_a")
        own = pairs.select(F.lit(family).alias("family"), *GROUP, "config_a", "config_b")
        out = own if out is None else out.unionByName(own)
    return out


def differences(values: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, config_a, config_b, user_id, a, b of every pair of configurations and complete user."""
    ab = pairs.select("config_a", "config_b").distinct()
    left = values.select(*by, "user_id", F.col("config").alias("config_a"), F.col("value").alias("a"))
    right = values.select(*by, "user_id", F.col("config").alias("config_b"), F.col("value").alias("b"))
    return left.join(ab, "config_a").join(right, [*by, "config_b", "user_id"])


def wilcoxon(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank statistic (Pratt zeros, normal approximation) per keys, without p: n_pairs, n_nonzero, mean_a, mean_b, statistic, z.

    Average ranks of |a - b| include zeros, whose ranks are then dropped. z is null where all differences are 0.
    """
    d = F.round(F.col("a") - F.col("b"), 12)
    hist = diffs.groupBy(*keys, F.abs(d).alias("size")).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(d > 0).alias("pos"), F.count_if(d < 0).alias("neg"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b")
    )
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("rank", before + (F.col("t") + 1) / 2)
    zero = F.col("size") == 0
    agg = hist.groupBy(*keys).agg(
        F.sum("t").alias("n_pairs"),
        F.sum(F.when(zero, 0).otherwise(F.col("t"))).alias("n_nonzero"),
        (F.sum("sum_a") / F.sum("t")).alias("mean_a"),
        (F.sum("sum_b") / F.sum("t")).alias("mean_b"),
        F.sum(F.col("rank") * F.col("pos")).alias("up"),
        F.sum(F.col("rank") * F.col("neg")).alias("down"),
        F.sum(F.when(zero, 0.0).otherwise(F.pow(F.col("t").cast("double"), 3) - F.col("t"))).alias("ties"),
    )
    n, z = F.col("n_pairs").cast("double"), (F.col("n_pairs") - F.col("n_nonzero")).cast("double")
    t = F.least("up", "down")
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("ties") / 2) / 24
    return agg.select(*keys, "n_pairs", "n_nonzero", "mean_a", "mean_b", t.alias("statistic"), F.when(F.col("n_nonzero") > 0, F.abs(t - mean) / F.sqrt(var)).alias("z"))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p; 1 for null (all differences 0)."""
    return z.map(lambda v: 1.0 if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def chi2_survival(x: float, k: float) -> float:
    """P(X > x) of a chi-squared variable with k degrees of freedom: series or continued fraction of the incomplete gamma."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Survival of the chi-squared distribution; null for null."""
    return pd.Series([None if pd.isna(s) or pd.isna(k) else chi2_survival(float(s), float(k)) for s, k in zip(stat, df)], dtype=float)


def friedman(values: DataFrame, by: list[str]) -> DataFrame:
    """by, n_users, n_configs, statistic, p_value over users with a value in every configuration.

    Fewer than three configurations, or ties throughout, give a null statistic. The ranks of one user form
    one small window (as many rows as configurations).
    """
    k = values.groupBy(*by).agg(F.countDistinct("config").alias("_k"))
    own = Window.partitionBy(*by, "user_id")
    full = values.join(k, by).withColumn("n_here", F.count(F.lit(1)).over(own)).where("n_here = _k")
    tied = Window.partitionBy(*by, "user_id", "value")
    ranked = full.withColumn("t", F.count(F.lit(1)).over(tied)).withColumn("rank", F.rank().over(own.orderBy("value")) + (F.col("t") - 1) / 2)
    sums = ranked.groupBy(*by, "_k", "config").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("t") - 1.0).alias("ties"))
    agg = sums.groupBy(*by, "_k").agg(F.max("n").alias("n_users"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("ties").alias("ties"))
    n, kk = F.col("n_users").cast("double"), F.col("_k").cast("double")
    correction = 1 - F.col("ties") / (n * kk * (kk * kk - 1))
    stat = (12 / (n * kk * (kk + 1)) * F.col("rr") - 3 * n * (kk + 1)) / correction
    out = agg.withColumn("statistic", F.when((F.col("_k") >= 3) & (correction > 1e-12), stat))
    return out.select(*by, "n_users", F.col("_k").alias("n_configs"), "statistic", chi2_p("statistic", (F.col("_k") - 1).cast("double")).alias("p_value"))


def corrected(tests: DataFrame, instance: list[str], order: list[str], method: str = "holm", alpha: float = 0.05) -> DataFrame:
    """tests with p_corrected and significant; the family instance (its m pairs) is the unit of correction."""
    own = Window.partitionBy(*instance)
    p, m = F.col("p_value"), F.count(F.lit(1)).over(own)
    if method == "holm":
        up = own.orderBy("p_value", *order)
        stepped = F.least(p * (F.col("_m") - F.col("_i") + 1), F.lit(1.0))
        out = tests.withColumn("_m", m).withColumn("_i", F.row_number().over(up)).withColumn("_s", stepped)
        out = out.withColumn("p_corrected", F.max("_s").over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_i", "_s")
    elif method == "bonferroni":
        out = tests.withColumn("p_corrected", F.least(p * m, F.lit(1.0)))
    elif method == "none":
        out = tests.withColumn("p_corrected", p)
    else:
        raise ValueError(f"unknown correction {method}")
    return out.withColumn("significant", F.col("p_corrected") < alpha)


def cohens_d(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over sample deviation of the paired differences; 0 if they don't vary."""
    d = F.col("a") - F.col("b")
    sd = F.stddev_samp(d)
    return diffs.groupBy(*keys).agg(F.when(sd > 1e-12, F.avg(d) / sd).otherwise(0.0).alias("cohens_d"))


def cliffs_delta(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """(#a > b - #a < b) / (n m) over all cross pairs, from running counts of the two value histograms; with its magnitude."""
    values = diffs.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    hist = values.groupBy(*keys, "s.v").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    below = F.coalesce(F.sum("y").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("below", below).withColumn("m", F.sum("y").over(Window.partitionBy(*keys)))
    wins = F.sum(F.col("x") * (F.col("below") - (F.col("m") - F.col("below") - F.col("y"))))
    delta = hist.groupBy(*keys).agg((wins / (F.sum("x").cast("double") * F.max("m"))).alias("cliffs_delta"))
    return delta.withColumn("magnitude", magnitude(F.col("cliffs_delta")))


def magnitude(delta: Column) -> Column:
    """Label of an effect size."""
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def bootstrap_mean(values: DataFrame, keys: list[str], value: Column, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """keys, n_users, mean, ci_lower, ci_upper, ci_width: percentile interval of the mean over resampled users.

    Users are resampled through the histogram of their values (a multinomial draw), which has the same distribution
    as drawing users one by one and whose size is that of the distinct values.
    """
    hist = values.groupBy(*keys, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys) + ", n_users long, mean double, ci_lower double, ci_upper double, ci_width double"

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        total = int(n.sum())
        rng = np.random.default_rng(seed)
        means = np.concatenate([rng.multinomial(total, n / total, size=min(100, draws - at)) @ v / total for at in range(0, draws, 100)])
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(*key, total, float(v @ n / total), lo, hi, hi - lo)], columns=[*keys, "n_users", "mean", "ci_lower", "ci_upper", "ci_width"])

    return hist.groupBy(*keys).applyInPandas(resample, schema)


def pairwise(values: DataFrame, pairs: DataFrame, by: list[str], method: str = "holm", alpha: float = 0.05, draws: int = 1000, seed: int = 42) -> DataFrame:
    """The full pairwise table: test, p, corrected p, means, difference interval, Cliff's delta, per family instance."""
    keys = [*by, "config_a", "config_b"]
    d = differences(values, pairs, by)
    tests = wilcoxon(d, keys).withColumn("p_value", normal_two_sided("z"))
    spread = bootstrap_mean(d, keys, F.round(F.col("a") - F.col("b"), 12), draws, alpha, seed).select(*keys, F.col("mean").alias("mean_diff"), F.col("ci_lower").alias("diff_ci_lower"), F.col("ci_upper").alias("diff_ci_upper"))
    rows = tests.join(spread, keys).join(cliffs_delta(d, keys), keys).join(pairs, ["config_a", "config_b"])
    return corrected(rows, [*by, "family", *GROUP], ["config_a", "config_b"], method, alpha)


def user_set_mismatch(values: DataFrame, by: list[str]) -> DataFrame:
    """by, config, n_missing: users that some configuration has and this one lacks; no row means equal user sets."""
    users = values.groupBy(*by).agg(F.countDistinct("user_id").alias("n_all"))
    own = values.groupBy(*by, "config").agg(F.countDistinct("user_id").alias("n_own"))
    return own.join(users, by).where("n_own < n_all").select(*by, "config", (F.col("n_all") - F.col("n_own")).alias("n_missing"))


def paired_matrix(values: DataFrame, configs: list[str]) -> DataFrame:
    """user_id and one column per configuration, for users that have them all."""
    wide = values.groupBy("user_id").pivot("config", configs).agg(F.first("value"))
    return wide.dropna(subset=configs)


def most_frequent(df: DataFrame, column: str, n: int) -> list[str]:
    """The n most frequent values, ties by value: the few systems that a matrix compares."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), column).limit(n).collect()]
