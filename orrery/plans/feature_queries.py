"""Queries on feature tables, fusions and recommenders, and their SQL."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics, vectors
from orrery.functions.names import FINETUNED, HYBRID
from orrery.operators import features, ranking, recommenders, splits
from orrery.plans.pipeline import factor_tables, feature_matrix, history_arrays, training_arrays
from orrery.plans.ranking_queries import named_vectors, sidecar_categories
from orrery.sources.tables import table
from orrery.staging import shared_dir, stage

OPTIONS = {"weighted_mean": {"weights": [0.3, 0.7]}, "attention_weighted": {"logits": [0.5, -0.5]}, "gated": {"logits": [1.0, 0.0]}}


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """name_a < name_b, item_idx, s0, s1, dims: every pair of feature tables, on the items that both cover."""
    v = named_vectors(spark, sf)
    side = lambda x, i: v.select("item_idx", F.col("embedding_name").alias(f"name_{x}"), F.col("vector").alias(f"s{i}"), F.col("dim").alias(f"dim_{i}"))
    return side("a", 0).join(side("b", 1), "item_idx").where("name_a < name_b")


def _summary(df: DataFrame, column: str, keys: tuple[str, ...] = ("item_idx",)) -> DataFrame:
    """Size, first and last element, sum of squares and sum of place times element of a vector column, to compare engines."""
    v = F.col(column)
    placed = F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.select(*keys, F.size(v).cast("long").alias("dim"), F.round(v[0], 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"), F.round(vectors.dot(v, v), 6).alias("squares"), F.round(placed, 5).alias("placed"))


def _fusion(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _pairs(spark, sf) if name == "concat" else _pairs(spark, sf).where("dim_0 = dim_1")
        df = rows.select("name_a", "name_b", "item_idx", vectors.fuse(name, [F.col("s0"), F.col("s1")], **OPTIONS.get(name, {})).alias("f"))
        return _summary(df, "f", ("name_a", "name_b", "item_idx"))

    query.__doc__ = f"Fusion {name} of every pair of feature tables, normalised first."
    query.__name__ = {"mean": "fuse_mean", "sum": "fuse_sum", "prod": "fuse_prod", "max_pool": "fuse_max_pool", "weighted_mean": "fuse_weighted_mean", "attention_weighted": "fuse_attention", "gated": "fuse_gated", "concat": "fuse_concat"}[name]
    return query


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of every finite vector of the table of labelled vectors."""
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_idx"), vectors.l2_normalize(F.col("embedding")).alias("f"))
    return _summary(df, "f")


def feature_norm_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate of every feature table."""
    df = table(spark, sf, "visual_embeddings")
    dim = F.regexp_extract("embedding_name", r"_(?:D|pcaD)([0-9]+)$", 1)
    g = features.feature_gate(df, "embedding_name", "features", F.when(dim != "", dim.cast("int")))
    return g.select("embedding_name", "n_rows", "n_null", "n_bad_dim", "n_not_finite", "n_zero", *(F.round(c, 5).alias(c) for c in ("norm_mean", "norm_std", "norm_min", "norm_max")))


def aligned_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Items that both tables of a pair cover, with their dimensions."""
    return _pairs(spark, sf).select("name_a", "name_b", "item_idx", "dim_0", "dim_1")


def _train_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "train").select("item_idx").dropna().distinct()


def pca_explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of every feature table's train rows, the share of its first 8 components and that of all its components together."""
    v, rows = stage(named_vectors(spark, sf), "named-vectors"), []
    for r in v.groupBy("embedding_name").agg(F.max("dim").alias("dim")).orderBy("embedding_name").collect():  # one fit per feature table
        own = v.where(F.col("embedding_name") == r["embedding_name"]).select("item_idx", "vector")
        share = features.TrainPca(own, "vector", _train_items(spark, sf), "item_idx", r["dim"]).explained
        rows += [(r["embedding_name"], i, float(x), float(sum(share))) for i, x in enumerate(share[:8])]
    return spark.createDataFrame(rows, "embedding_name string, component long, share double, all_components double")


def pca_total_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and total variance of every feature table's train rows, as the components preserve it."""
    v, rows = stage(named_vectors(spark, sf), "named-vectors"), []
    for r in v.groupBy("embedding_name").agg(F.max("dim").alias("dim")).orderBy("embedding_name").collect():
        own = v.where(F.col("embedding_name") == r["embedding_name"]).select("item_idx", "vector")
        pca = features.TrainPca(own, "vector", _train_items(spark, sf), "item_idx", r["dim"])
        if pca.model is not None:
            held = pca.transform(own.join(_train_items(spark, sf), "item_idx", "left_semi"), "vector", "projected")
            spread = held.select(F.posexplode("projected").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"), F.count(F.lit(1)).alias("n"))
            one = spread.agg(F.max("n").alias("n"), F.sum("v").alias("v")).first()
            rows.append((r["embedding_name"], one["n"], round(one["v"], 5)))
    return spark.createDataFrame(rows, "embedding_name string, n_rows long, variance double")


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """The first two frozen plain tables of equal dimension by name, aligned: item_idx, s0, s1."""
    v = named_vectors(spark, sf)
    found = [(r["dim"], r["embedding_name"]) for r in v.select("dim", "embedding_name").distinct().collect() if not r["embedding_name"].startswith(HYBRID) and FINETUNED not in r["embedding_name"]]
    names = next((sorted(n for d, n in found if d == dim)[:2] for dim in sorted({d for d, _ in found}) if sum(d == dim for d, _ in found) >= 2), [])
    if len(names) < 2:
        raise ValueError("there are no two plain feature tables of equal dimension")
    dims = dict(map(reversed, found))
    return features.aligned_sources(table(spark, sf, "visual_embeddings"), "embedding_name", "item_idx", "features", {n: dims[n] for n in names}), names


def pca_joint(spark: SparkSession, sf: str) -> DataFrame:
    """Joint components of two sources."""
    return features.pca_fused(_two(spark, sf)[0], "item_idx", ["s0", "s1"], _train_items(spark, sf), 16)


def pca_per_model(spark: SparkSession, sf: str) -> DataFrame:
    """Components of each source, concatenated."""
    return features.pca_fused(_two(spark, sf)[0], "item_idx", ["s0", "s1"], _train_items(spark, sf), 8, per_source=True)


def pca_aligned_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Components of every source of a pair of unequal tables brought to one length, then their mean."""
    return features.pca_aligned(_two(spark, sf)[0], "item_idx", ["s0", "s1"], _train_items(spark, sf), 8, "mean")


def training_data(spark: SparkSession, sf: str) -> tuple[int, int, DataFrame, DataFrame]:
    """Numbers of users and items, and the train and val pairs inside the id maps."""
    n = {r["kind"]: r["n"] for r in table(spark, sf, "id_map").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    users, items = n.get("user", 0), n.get("item", 0)
    inside = f"user_idx >= 0 and user_idx < {users} and item_idx >= 0 and item_idx < {items}"
    train = splits.seen_items(table(spark, sf, "train")).where(inside)
    held = table(spark, sf, "heldout").where("split = 'val'").select("user_idx", "item_idx").dropna().distinct().where(inside)
    return users, items, train, held.join(train, ["user_idx", "item_idx"], "left_anti")


def _context(spark: SparkSession, sf: str, kind: str = "pooled") -> tuple[recommenders.Context, np.ndarray, np.ndarray]:
    """What a model sees: one table (pooled), its vectors cut in four components with histories (component), or two tables (fused)."""
    users, items, train, val = training_data(spark, sf)
    c = recommenders.Context(users, items)
    if kind != "none":
        two, names = _two(spark, sf)
        dim = int(names[0].rpartition("D")[2])
        c.features = [feature_matrix(two, s, items, dim) for s in ("s0", "s1")[: 2 if kind == "fused" else 1]]
        labels = sidecar_categories(spark, sf).join(table(spark, sf, "id_map").where("kind = 'item'").select(F.col("ext_id").alias("item_id"), F.col("idx").alias("item_idx")), "item_id")
        found = labels.select("item_idx", F.array(F.col("category_label").cast("double")).alias("v"))
        own = feature_matrix(found.withColumn("v", F.transform("v", lambda x: x + 1)), "v", items, 1)[:, 0].astype(int)
        c.categories = np.where(own > 0, own - 1, own.max(initial=0))  # the unlabelled share an extra group
    if kind == "component":
        c.features = [c.features[0].reshape(items, 4, -1)]
        c.history, c.mask = history_arrays(train, users, 5)
    return c, *training_arrays(train, val)


def _jobs(spark: SparkSession, models: tuple[str, ...], hps: list[dict]) -> DataFrame:
    return spark.createDataFrame([(m, json.dumps(hp, sort_keys=True), 42) for m in models for hp in hps], recommenders.JOB)


def _trained(models: tuple[str, ...], hps: list[dict], kind: str = "none", fusion: str | None = None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        context, train, val = _context(spark, sf, kind)
        context.fusion = fusion
        return recommenders.train_jobs(_jobs(spark, models, hps), context, train, val)

    query.__doc__ = f"Training of {', '.join(models)}{f' with learned fusion {fusion}' if fusion else ''}, one task per cell."
    return query


_SMALL = {"latent": 16, "visual": 16, "epochs": 4, "eval_every": 2, "batch": 1024}
_GRID = recommenders.grid({"lr": [0.01, 0.05], "l2": [0.0, 1e-5]})
bpr_train = _trained(("bpr",), [{**_SMALL, **g} for g in _GRID])
vbpr_train = _trained(("vbpr", "deepstyle", "avbpr"), [{**_SMALL, "lr": 0.01, "att_hidden": 8}], "pooled")
vnpr_train = _trained(("vnpr",), [{**_SMALL, "latent": 8, "hidden": [8], "epochs": 2, "lr": 0.01}], "pooled")
acf_train = _trained(("acf",), [{**_SMALL, "latent": 8, "visual": 8, "att_hidden": 8, "epochs": 2, "lr": 0.01}], "component")
learned_fusion_train = _trained(("vbpr",), [{**_SMALL, "lr": 0.01, "aligned": 16}], "fused", "adaptive_gated")


def best_hyperparameters(spark: SparkSession, sf: str) -> DataFrame:
    """Best cell of the bpr grid."""
    return recommenders.best_jobs(bpr_train(spark, sf))


def hyperparameter_search(spark: SparkSession, sf: str) -> DataFrame:
    """Random search for bpr in two waves of trials, with median pruning."""
    context, train, val = _context(spark, sf, "none")
    space = {"latent": {"type": "int", "low": 8, "high": 16, "step": 8}, "lr": {"type": "float", "low": 0.005, "high": 0.05, "log": True}, "epochs": {"type": "categorical", "choices": [2]}, "eval_every": {"type": "categorical", "choices": [1]}, "batch": {"type": "categorical", "choices": [1024]}}
    return recommenders.search(spark, "bpr", context, train, val, space, 8, f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}/trials", 4).drop("history")


def trained_full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The final protocol end to end: train the grid, keep all parameters, rank every test item by the best model's factors, metrics at 10."""
    context, train, val = _context(spark, sf, "none")
    stored = stage(recommenders.trained(_jobs(spark, ("bpr",), [{**_SMALL, **g} for g in _GRID]), context, train, val), "models")
    best = recommenders.best_jobs(recommenders.results_of(stored)).first()
    p = recommenders.parameters_of(stored.where(F.col("hyperparams") == best["hyperparams"]))
    _, items, pairs, held = training_data(spark, sf)
    test = table(spark, sf, "heldout").where("split = 'test'").select("user_idx", "item_idx")
    keys = ranking.tie_keys(spark.range(items).select(F.col("id").alias("item_idx")))
    records = ranking.dot_ranking(*factor_tables(spark, "bpr", p, context), keys, pairs.unionByName(held), test)
    m = metrics.rank_metrics(F.col("rank"), 10)
    return records.select("*", m["recall"].alias("recall_10"), F.round(m["ndcg"], 6).alias("ndcg_10"))


QUERIES = {f.__name__: f for f in (*map(_fusion, vectors.FUSIONS), l2_normalize, feature_norm_gate, aligned_sources, pca_explained_variance, pca_total_variance, pca_joint, pca_per_model, pca_aligned_mean, best_hyperparameters, hyperparameter_search, trained_full_ranking)} | {"bpr_train": bpr_train, "vbpr_train": vbpr_train, "vnpr_train": vnpr_train, "acf_train": acf_train, "learned_fusion_train": learned_fusion_train}

_SRC = """
with v as (select embedding_name as n, item_idx, list_transform(min(features), lambda x: x::double) as v from visual_embeddings where embedding_name is not null and item_idx is not null
  and len(features) = try_cast(regexp_extract(embedding_name, '_(?:D|pcaD)([0-9]+)$', 1) as int) and len(list_filter(features, lambda x: x is null or not isfinite(x))) = 0 group by 1, 2),
m as (select *, sqrt(list_dot_product(v, v)) as size from v),
u as (select n, item_idx, list_transform(v, lambda x: case when size > 0 then x / size else x end) as v from m),
j as (select x.n as name_a, y.n as name_b, item_idx, x.v as a, y.v as b from u x join u y using (item_idx) where x.n < y.n),
"""
_SUM = "len(f)::bigint as dim, round(f[1], 6) as first, round(f[-1], 6) as last, round(list_dot_product(f, f), 6) as squares, round(list_dot_product(f, list_transform(generate_series(1, len(f)), lambda i: i::double)), 5) as placed from z"


def _zip(op: str) -> str:
    return _SRC + f"z as (select name_a, name_b, item_idx, list_transform(generate_series(1, len(a)), lambda i: {op}) as f from j where len(a) = len(b)) select name_a, name_b, item_idx, " + _SUM


_E5, _G1 = "(exp(0.5::double) / (exp(0.5::double) + exp(-0.5::double)))", "((1 / (1 + exp(-1.0::double))) / (1 / (1 + exp(-1.0::double)) + 0.5::double))"

SQL = {
    "fuse_mean": _zip("(a[i] + b[i]) / 2"),
    "fuse_sum": _zip("a[i] + b[i]"),
    "fuse_prod": _zip("a[i] * b[i]"),
    "fuse_max_pool": _zip("greatest(a[i], b[i])"),
    "fuse_weighted_mean": _zip("0.3::double * a[i] + 0.7::double * b[i]"),
    "fuse_attention": _zip(f"{_E5} * a[i] + (1 - {_E5}) * b[i]"),
    "fuse_gated": _zip(f"{_G1} * a[i] + (1 - {_G1}) * b[i]"),
    "fuse_concat": _SRC + "z as (select name_a, name_b, item_idx, list_concat(a, b) as f from j) select name_a, name_b, item_idx, " + _SUM,
    "l2_normalize": "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select vec_id, v, sqrt(list_dot_product(v, v)) as m from e), z as (select vec_id as item_idx, list_transform(v, lambda x: case when m > 0 then x / m else x end) as f from n) select item_idx, " + _SUM,
    "aligned_sources": _SRC + "z as (select name_a, name_b, item_idx, len(a)::int as dim_0, len(b)::int as dim_1 from j) select * from z",
    "pca_total_variance": _SRC.replace("j as (", "t as (select n, item_idx, v from v where item_idx in (select item_idx from train)), x as (select n, i, var_samp(x) as s, count(*) as c from (select n, generate_subscripts(v, 1) as i, unnest(v) as x from t) group by 1, 2 having count(*) > 1), j as (").rstrip().rstrip(",") + " select n as embedding_name, max(c) as n_rows, round(sum(s), 5) as variance from x group by 1",
    "feature_norm_gate": """
with d as (select embedding_name, features, try_cast(regexp_extract(embedding_name, '_(?:D|pcaD)([0-9]+)$', 1) as int) as dim from visual_embeddings),
c as (select embedding_name, features is null as null_row, features is not null and not coalesce(len(features) = dim, false) as bad_dim,
  features is not null and coalesce(len(features) = dim, false) and len(list_filter(features, lambda x: x is null or not isfinite(x))) > 0 as odd, features from d),
s as (select *, case when not null_row and not bad_dim and not odd then sqrt(list_dot_product(list_transform(features, lambda x: x::double), list_transform(features, lambda x: x::double))) end as m from c)
select embedding_name, count(*) as n_rows, count(*) filter (null_row) as n_null, count(*) filter (bad_dim) as n_bad_dim, count(*) filter (odd) as n_not_finite, count(*) filter (m < 1e-8) as n_zero,
  round(avg(m) filter (m >= 1e-8), 5) as norm_mean, round(stddev_pop(m) filter (m >= 1e-8), 5) as norm_std, round(min(m) filter (m >= 1e-8), 5) as norm_min, round(max(m) filter (m >= 1e-8), 5) as norm_max from s group by 1""",
}
