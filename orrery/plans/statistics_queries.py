"""Queries on evaluation results: tests, effect sizes, reports, names and cells, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import names, vectors
from orrery.operators import reports
from orrery.operators import statistics as st
from orrery.sources.tables import table

BY = ["dataset", "metric", "k"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evaluation_long").where("recommender is not null and embedding_name is not null and user_id is not null")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    df = _rows(spark, sf).withColumn("config", names.config_key(F.col("recommender"), F.col("embedding_name")))
    return st.clean_values(df, [*BY, "config", "user_id"])


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select(F.col("recommender").alias("model"), "embedding_name").distinct()


PLANNED = ("mean", "sum", "max_pool")


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the evaluation and those that fusing its plain tables would add: every recommender that is there × both conditions."""
    cells = _cells(spark, sf)
    dims = cells.where(names.embedding_kind(F.col("embedding_name")) == "backbone").select("model", names.parse_embedding_name(F.col("embedding_name"))["embedding_dim"].cast("string").alias("d")).dropna().distinct()
    marks = F.explode(F.array(*(F.concat(F.lit(f"hybrid_{op}{mark}_D"), "d") for op in PLANNED for mark in ("", "_finetuned"))))
    return cells.unionByName(dims.select("model", marks.alias("embedding_name"))).distinct()


def _family(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return st.families(_planned(spark, sf), (name,))

    query.__doc__ = f"Pairs of configurations of family {name}."
    query.__name__ = {"backbone_within_model": "family_backbone", "model_within_backbone": "family_model", "fusion_within_model": "family_fusion", "frozen_vs_finetuned": "family_frozen_finetuned", "all_pairs": "family_all_pairs"}[name]
    return query


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return st.differences(_values(spark, sf), st.families(_cells(spark, sf)), BY)


PAIR = [*BY, "config_a", "config_b"]


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return st.wilcoxon(_diffs(spark, sf), PAIR)


def wilcoxon_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Signed-rank statistics of every pair of the four families."""
    t = _tests(spark, sf)
    return t.select(*PAIR, "n_pairs", "n_nonzero", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "statistic", F.round("z", 6).alias("z"))


def n_nonzero_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of users that differ."""
    return _tests(spark, sf).select(*PAIR, "n_pairs", "n_nonzero")


def friedman_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Friedman statistic over complete users."""
    # per model, as no user has every one of the many configurations
    v = _values(spark, sf).withColumn("model", names.split_config(F.col("config"))["recommender"])
    f = st.friedman(v, [*BY, "model"])
    return f.select(*BY, "model", "n_users", "n_configs", F.round("statistic", 5).alias("statistic"))


def friedman_p(spark: SparkSession, sf: str) -> DataFrame:
    """Friedman tests with their p value."""
    v = _values(spark, sf).withColumn("model", names.split_config(F.col("config"))["recommender"])
    f = reports.friedman_long(st.friedman(v, [*BY, "model"]))
    return f.select(*BY, "model", "n_users", "n_configs", F.round("statistic", 5).alias("statistic"), F.round("p_value", 8).alias("p_value"), "test_type")


def _p(spark: SparkSession, sf: str) -> DataFrame:
    """Tests of every pair of the families with their two-sided p, to 12 digits."""
    t = _tests(spark, sf).withColumn("p_value", F.round(st.normal_two_sided("z"), 12))
    return t.join(st.families(_cells(spark, sf)), ["config_a", "config_b"])


def _correction(method: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        c = st.corrected(_p(spark, sf), [*BY, "family", *st.GROUP], ["config_a", "config_b"], method)
        return c.select(*PAIR, "family", *st.GROUP, F.round("p_value", 9).alias("p_value"), F.round("p_corrected", 9).alias("p_corrected"), "significant")

    query.__doc__ = f"Correction {method} within each family instance."
    query.__name__ = {"holm": "holm", "bonferroni": "bonferroni", "none": "no_correction"}[method]
    return query


def cliffs_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Cliff's delta of every pair."""
    return st.cliffs_delta(_diffs(spark, sf), PAIR).withColumn("cliffs_delta", F.round("cliffs_delta", 6))


def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's d of every pair; null where a single user remains."""
    return st.cohens_d(_diffs(spark, sf), PAIR).withColumn("cohens_d", F.round("cohens_d", 5))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and percentile interval of every configuration."""
    return st.bootstrap_mean(_values(spark, sf), [*BY, "config"], F.col("value"))


def pairwise_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The pairwise table in long form."""
    return reports.pairwise_long(st.pairwise(_values(spark, sf), st.families(_cells(spark, sf)), BY))


def user_set_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations that lack users others have."""
    return st.user_set_mismatch(_values(spark, sf), BY)


def paired_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ndcg of every user under the two embeddings of the most rows, for users who have both."""
    rows = _rows(spark, sf)
    systems = st.most_frequent(rows, "embedding_name", 2)
    v = rows.where((F.col("metric") == "ndcg") & F.col("metric_value").isNotNull() & ~F.isnan("metric_value")).groupBy("user_id", F.col("embedding_name").alias("config")).agg(F.round(F.avg("metric_value"), 9).alias("value"))
    wide = st.paired_matrix(v, systems)
    return wide.select("user_id", *(x for i, c in zip("ab", systems) for x in (F.lit(c).alias(f"system_{i}"), F.col(c).alias(f"value_{i}"))))


def bootstrap_long(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of every configuration in tidy form, with the parts of its name."""
    return reports.summary_long(bootstrap_ci(spark, sf), "ndcg", 10)


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean of every cell, and the Friedman tests, as one long table of kinds."""
    v = _values(spark, sf).withColumn("model", names.split_config(F.col("config"))["recommender"])
    t = reports.consolidated({"evaluation": table(spark, sf, "evaluation_long"), "friedman": st.friedman(v, [*BY, "model"])}, CELL)
    cells = t["evaluation"].select(F.lit("evaluation").alias("kind"), "dataset", "recommender", "embedding_name", "metric", "k", "n_users", F.round("mean", 9).alias("value"))
    tests = t["tests"].select(F.col("test_type").alias("kind"), "dataset", F.col("model").alias("recommender"), F.lit(None).cast("string").alias("embedding_name"), "metric", "k", "n_users", F.round("statistic", 5).alias("value"))
    return cells.unionByName(tests)


def report_best(spark: SparkSession, sf: str) -> DataFrame:
    """The section of a report with the best recommender cells."""
    return reports.report_sections(cell_mean(spark, sf))["Best per recommender"]


CELL = ["dataset", "recommender", "embedding_name", "metric", "k"]


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cell_means(table(spark, sf, "evaluation_long"), CELL)


def cell_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean per cell, metric and k."""
    return _means(spark, sf).withColumn("mean", F.round("mean", 10))


def cross_seed_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of a cell's mean over repeats (here the data sets)."""
    m = _means(spark, sf).where("mean is not null").withColumn("mean", F.round("mean", 10))
    a = reports.across(m, CELL[1:], "mean")
    return a.select(*CELL[1:], *(F.round(c, 12).alias(c) for c in ("mean", "std", "median", "min", "max")), "n")


def best_per_recommender(spark: SparkSession, sf: str) -> DataFrame:
    """Best embedding per data set, condition, recommender, metric and k."""
    m = cell_mean(spark, sf).where("mean is not null").withColumn("cond", names.condition_of(F.col("embedding_name")))
    return reports.best_per(m, ["dataset", "cond", "recommender", "metric", "k"], "mean", ["embedding_name"])


def frozen_finetuned_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Best frozen against best finetuned mean."""
    m = cell_mean(spark, sf).withColumn("cond", names.condition_of(F.col("embedding_name")))
    return reports.condition_delta(m, ["dataset", "recommender", "metric", "k"], "cond", "mean").withColumn("delta", F.round("delta", 9))


def top_n_configs(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best cells by ndcg@10."""
    return reports.top_n(cell_mean(spark, sf).where("metric = 'ndcg' and k = 10 and mean is not null"), "mean", 10, ["dataset", "recommender", "embedding_name"])


def evaluation_long(spark: SparkSession, sf: str) -> DataFrame:
    """Wide per-cell means melted back into the tidy table with parsed names."""
    keys = ["dataset", "recommender", "embedding_name"]
    m = cell_mean(spark, sf).where("recommender is not null and embedding_name is not null").withColumn("name", F.concat("metric", F.lit("@"), F.col("k").cast("string")))
    wide = m.groupBy(*keys).pivot("name", [f"{a}@{k}" for a in ("recall", "ndcg", "precision", "map", "f1") for k in (5, 10, 20)]).agg(F.max("mean"))
    return reports.evaluation_long(wide, keys, "recommender").where("metric_value is not null")


def parse_embedding_name(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of every embedding name in use."""
    n = table(spark, sf, "visual_embeddings").select("embedding_name").unionByName(table(spark, sf, "evaluation_long").select("embedding_name")).distinct().where("embedding_name is not null")
    return n.select("embedding_name", names.parse_embedding_name(F.col("embedding_name")).alias("p"), names.embedding_kind(F.col("embedding_name")).alias("kind"), names.backbone_base(F.col("embedding_name")).alias("base")).select("embedding_name", "p.*", "kind", "base")


def parse_config(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of every configuration in use."""
    c = _cells(spark, sf).select(names.config_key(F.col("model"), F.col("embedding_name")).alias("config")).distinct()
    p = names.split_config(F.col("config"))
    return c.select("config", p["recommender"].alias("recommender"), p["embedding_name"].alias("embedding_name"))


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """File-safe names, cell keys, seeds and conditions of every cell."""
    c = _cells(spark, sf)
    key = names.cell_key(F.lit("all"), F.col("model"), F.col("embedding_name"))
    return c.select(key.alias("cell_key"), names.safe_name(F.concat("model", F.lit("/"), "embedding_name")).alias("safe"), names.seed_of(key, 42).alias("seed"), F.explode(names.conditions_of(F.col("embedding_name"))).alias("condition"))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """States of all cells of the evaluation, as its rows show them.

    A cell is a data set, recommender and embedding that occur. It is done if it has a value for every (metric, k) that its
    data set evaluates, failed if it has rows but no value, else pending. Its role is search for the first data set by
    name, and the number of its rows stands for its duration.
    """
    rows = _rows(spark, sf).where("dataset is not null")
    good = F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
    wanted = rows.groupBy("dataset").agg(F.countDistinct("metric", "k").alias("wanted"))
    c = rows.groupBy("dataset", "recommender", "embedding_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(good, F.struct("metric", "k"))).alias("have"))
    first = rows.agg(F.min("dataset").alias("first"))
    state = F.when(F.col("have") == F.col("wanted"), "done").when(F.col("have") == 0, "failed").otherwise("pending")
    return c.join(wanted, "dataset").join(F.broadcast(first)).select("dataset", "recommender", "embedding_name", state.alias("state"), F.when(F.col("dataset") == F.col("first"), "search").otherwise("replay").alias("role"), F.when(state == "done", F.col("n").cast("double")).alias("duration_seconds"))


def cost_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Remaining cost per role."""
    r = reports.remaining_cost(_state(spark, sf))
    return r.select("role", "n_open", F.round("mean_seconds", 5).alias("mean_seconds"), F.round("estimate_seconds", 4).alias("estimate_seconds"))


def pending_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Open cells per data set and recommender, with totals."""
    g = _state(spark, sf).where("state <> 'done'").rollup("dataset", "recommender").agg(F.count(F.lit(1)).alias("n_open"))
    return g.where("n_open > 0")


def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per state."""
    return _state(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def cell_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    """Every eligible cell: data set, recommender and embedding, where bpr takes none and the others take vectors."""
    e = table(spark, sf, "visual_embeddings").select("embedding_name").where("embedding_name is not null").distinct()
    d = table(spark, sf, "train").select(F.col("source").alias("dataset")).where("source is not null").distinct()
    visual = spark.createDataFrame([(m,) for m in names.RECOMMENDERS if m not in ("bpr", "acf")], "recommender string")
    pooled = visual.join(e.where(~names.is_component(F.col("embedding_name"))))
    part = spark.createDataFrame([("acf",)], "recommender string").join(e.where(names.is_component(F.col("embedding_name"))))
    plain = spark.createDataFrame([("bpr", "none")], "recommender string, embedding_name string")
    cells = pooled.unionByName(part).unionByName(plain).withColumn("condition", names.condition_of(F.col("embedding_name")))
    return d.join(cells)  # a grid of names: data sets × recommenders × embeddings


def hp_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The default hyperparameter grid of the visual recommenders."""
    grid = spark.range(1)
    for name, values in (("latent", (64, 128)), ("lr", (0.001, 0.01)), ("l2", (0.0001, 0.001)), ("visual", (64, 128))):
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return grid.drop("id")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled vectors with a nearest-centroid score per class; centroids are one row per class and dimension."""
    v = table(spark, sf, "embeddings").where("label is not null").select("vec_id", "label", "embedding")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))
    one = c.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "c"))), lambda s: s.c).alias("centroids"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", "label", F.transform("centroids", lambda m: F.round(vectors.dot(F.col("embedding"), m), 6)).alias("scores"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("predicted", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    return reports.confusion(s, "label", "predicted")


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion of a nearest-centroid predictor."""
    return _matrix(spark, sf)


def class_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return reports.class_report(_matrix(spark, sf)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def class_means(spark: SparkSession, sf: str) -> DataFrame:
    """Macro and weighted means of the class report."""
    m = reports.report_means(reports.class_report(_matrix(spark, sf)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns if c != "support"), "support")


def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Top-1, top-5 and cross-entropy."""
    t = reports.topk_accuracy(_scored(spark, sf), "label", F.col("scores"))
    return t.select("n", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"), F.round("loss", 3).alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        *map(_family, st.FAMILIES), wilcoxon_stat, n_nonzero_pairs, friedman_stat, friedman_p, *map(_correction, ("holm", "bonferroni", "none")), cliffs_delta, cohens_d, bootstrap_ci, bootstrap_long, pairwise_tests, consolidated, report_best,
        user_set_mismatch, paired_matrix, cell_mean, cross_seed_stats, best_per_recommender, frozen_finetuned_delta, top_n_configs, evaluation_long, parse_embedding_name, parse_config, name_keys,
        cost_projection, pending_jobs, state_counts, cell_enumeration, hp_grid, confusion_matrix, class_prf, class_means, topk_accuracy,
    )
}

_FAMILIES = """
kinds as (
  select *, model || '_' || e as config,
    case when e = 'none' then 'none' when e like 'hybrid\\_%' escape '\\' then 'fusion' else 'backbone' end as kind,
    replace(regexp_replace(e, '_comp$', ''), '_finetuned', '') as base, case when contains(e, '_finetuned') then 'finetuned' else 'frozen' end as cond from cells),
g as (select 'backbone_within_model' as family, model, null as base, cond as condition, config from kinds where kind = 'backbone'
  union all select 'model_within_backbone', null, base, cond, config from kinds where kind = 'backbone'
  union all select 'fusion_within_model', model, null, cond, config from kinds where kind = 'fusion'
  union all select 'all_pairs', null, null, null, config from kinds),
every as (select a.family, a.model, a.base, a.condition, a.config as config_a, b.config as config_b from g a join g b
    on a.family = b.family and a.model is not distinct from b.model and a.base is not distinct from b.base and a.condition is not distinct from b.condition and a.config < b.config
  union all select 'frozen_vs_finetuned', model, base, null, max(config) filter (cond = 'frozen'), max(config) filter (cond = 'finetuned') from kinds where kind <> 'none' group by model, base having count(distinct cond) = 2),
pairs as (select * from every where family <> 'all_pairs')
"""
_OWN = "select distinct recommender as model, embedding_name as e from evaluation_long where recommender is not null and embedding_name is not null and user_id is not null"
_CELLS = f"with cells as ({_OWN}),{_FAMILIES}"
_PLANNED = f"""
with own as ({_OWN}),
dims as (select distinct model, regexp_extract(e, '_D([0-9]+)$', 1) as d from own where e <> 'none' and e not like 'hybrid\\_%' escape '\\' and regexp_matches(e, '_D[0-9]+$')),
cells as (select * from own union select model, 'hybrid_' || op || mark || '_D' || d from dims cross join (select unnest(['mean', 'sum', 'max_pool']) as op) cross join (select unnest(['', '_finetuned']) as mark)),{_FAMILIES}"""
_TESTS = (
    _CELLS
    + """,
vals as (select dataset, metric, k, recommender || '_' || embedding_name as config, user_id, min(metric_value) as v from evaluation_long
         where recommender is not null and embedding_name is not null and user_id is not null and metric_value is not null and not isnan(metric_value) group by all),
d as (select a.dataset, a.metric, a.k, config_a, config_b, a.user_id, a.v as a, b.v as b, round(a.v - b.v, 12) as d
      from (select distinct config_a, config_b from pairs) join vals a on a.config = config_a
      join vals b on b.config = config_b and b.user_id = a.user_id and a.dataset is not distinct from b.dataset and a.metric = b.metric and a.k = b.k
      where a.dataset is not null),
h as (select dataset, metric, k, config_a, config_b, abs(d) as size, count(*) as t, count(*) filter (d > 0) as pos, count(*) filter (d < 0) as neg, sum(a) as sa, sum(b) as sb from d group by all),
r as (select *, coalesce(sum(t) over (partition by dataset, metric, k, config_a, config_b order by size rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0::double as rank from h),
s as (select dataset, metric, k, config_a, config_b, sum(t)::bigint as n_pairs, coalesce(sum(t) filter (size <> 0), 0)::bigint as n_nonzero, sum(sa) / sum(t) as mean_a, sum(sb) / sum(t) as mean_b,
        least(sum(rank * pos), sum(rank * neg)) as statistic, coalesce(sum(t::double * t * t - t) filter (size <> 0), 0) as ties from r group by all),
w as (select *, n_pairs::double as n, (n_pairs - n_nonzero)::double as z0 from s),
tests as (select *, case when n_nonzero > 0 then abs(statistic - (n * (n + 1) / 4 - z0 * (z0 + 1) / 4)) / sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - ties / 2) / 24) end as z from w)
"""
)
# two-sided normal p and chi-squared survival by the series of the incomplete gamma function, exact to about 1e-13
_ERFC = "case when z is null then 1 when z > 8.5::double then 0 else 1 - list_sum(list_transform(range(0, 160), lambda i: exp(-z * z / 2 + (2 * i + 1) * ln(greatest(z, 1e-300::double) / sqrt(2)) - lgamma(i + 1.5::double)))) end"
_CORRECTED = (
    _TESTS
    + f""",
p as (select t.dataset, t.metric, t.k, config_a, config_b, family, model, base, condition, round(greatest({_ERFC}, 0), 12)::double as p_value from tests t join pairs using (config_a, config_b)),
m as (select *, count(*) over own as m, row_number() over (own order by p_value, config_a, config_b) as i from p window own as (partition by dataset, metric, k, family, model, base, condition))
"""
)
_OUT = "select dataset, metric, k, config_a, config_b, family, model, base, condition, round(p_value, 9) as p_value, round(pc, 9) as p_corrected, pc < 0.05::double as significant from "
_MEANS = "with cm as (select dataset, recommender, embedding_name, metric, k, count(*) as n_users, round(avg(metric_value) filter (not isnan(metric_value)), 10) as mean from evaluation_long group by all)\n"
_COND = "case when contains(embedding_name, '_finetuned') then 'finetuned' else 'frozen' end"
_PARSE = r"""
  case when embedding_name = 'none' then 'none' when stem like 'hybrid\_%' escape '\' then 'hybrid' else stem end as extractor,
  case when embedding_name <> 'none' and stem like 'hybrid\_%' escape '\' then stem[8:] else 'none' end as fusion,
  case when embedding_name = 'none' then 'both' when bare like '%\_finetuned' escape '\' then 'finetuned' else 'frozen' end as {cond},
  case when embedding_name <> 'none' then try_cast(regexp_extract(embedding_name, '_D([0-9]+)$', 1) as int) end as embedding_dim
"""
_STEM = "regexp_replace(embedding_name, '_D[0-9]+$', '') as bare, regexp_replace(regexp_replace(embedding_name, '_D[0-9]+$', ''), '_finetuned$', '') as stem"
_STATE = """
with er as (select *, metric_value is not null and not isnan(metric_value) as good from evaluation_long where recommender is not null and embedding_name is not null and user_id is not null and dataset is not null),
wn as (select dataset, count(distinct (metric, k)) filter (metric is not null and k is not null) as wanted from er group by 1),
cc as (select dataset, recommender, embedding_name, count(*) as n, count(distinct (metric, k)) filter (good) as have from er group by all),
st as (select dataset, recommender, embedding_name, n, case when have = wanted then 'done' when have = 0 then 'failed' else 'pending' end as state,
  case when dataset = (select min(dataset) from er) then 'search' else 'replay' end as role from cc join wn using (dataset))
"""
_SCORES = """
with cx as (select label, i, avg(x) as x from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings where label is not null) group by 1, 2),
c as (select label, list(x order by i) as c from cx group by 1),
sc as (select vec_id, e.label, c.label as class, round(list_dot_product(list_transform(embedding, lambda x: x::double), c), 6) as s from embeddings e cross join c where e.label is not null),
pr as (select vec_id, label, arg_max(class, struct_pack(s := s, o := -class)) as predicted from sc group by 1, 2),
classes as (select label as c from pr union select predicted from pr),
cmx as (select x.c as actual, y.c as predicted, count(pr.vec_id) as n from classes x cross join classes y left join pr on pr.label = x.c and pr.predicted = y.c group by 1, 2),
rep as (select c as label, coalesce(tp / nullif(called, 0), 0)::double as precision, coalesce(tp / nullif(support, 0), 0)::double as recall, coalesce(2 * tp::double / nullif(called + support, 0), 0) as f1, support from
  (select c, (select sum(n) from cmx where actual = c)::bigint as support, (select sum(n) from cmx where predicted = c)::bigint as called, (select sum(n) from cmx where actual = c and predicted = c)::double as tp from classes))
"""

_FRIEDMAN = (
    _TESTS
    + """,
fv as (select *, regexp_extract(config, '^(deepstyle|avbpr|vbpr|vnpr|acf|bpr)', 1) as model from vals where dataset is not null),
fk as (select dataset, metric, k, model, count(distinct config) as kk from fv group by all),
ffull as (select fv.*, kk, count(*) over (partition by dataset, metric, k, model, user_id) as here from fv join fk using (dataset, metric, k, model)),
fr as (select *, rank() over (partition by dataset, metric, k, model, user_id order by v) as rk, count(*) over (partition by dataset, metric, k, model, user_id, v) as t from ffull where here = kk),
fs as (select dataset, metric, k, model, kk, config, sum(rk + (t - 1) / 2.0::double) as rsum, count(*) as n, sum(t * t - 1.0::double) as ties from fr group by all),
fa as (select dataset, metric, k, model, kk, max(n) as n_users, sum(rsum * rsum) as rr, sum(ties) as ties from fs group by all),
ft as (select dataset, metric, k, model, n_users, kk as n_configs, case when kk >= 3 and 1 - ties / (n_users::double * kk * (kk * kk - 1)) > 1e-12 then
  (12 / (n_users::double * kk * (kk + 1)) * rr - 3 * n_users::double * (kk + 1)) / (1 - ties / (n_users::double * kk * (kk * kk - 1))) end as q from fa)
"""
)

SQL = {
    **{n: _PLANNED + f"select family, model, base, condition, config_a, config_b from every where family = '{f}'" for n, f in (("family_backbone", "backbone_within_model"), ("family_model", "model_within_backbone"), ("family_fusion", "fusion_within_model"), ("family_frozen_finetuned", "frozen_vs_finetuned"), ("family_all_pairs", "all_pairs"))},
    "wilcoxon_stat": _TESTS + "select dataset, metric, k, config_a, config_b, n_pairs, n_nonzero, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, statistic, round(z, 6) as z from tests",
    "n_nonzero_pairs": _TESTS + "select dataset, metric, k, config_a, config_b, n_pairs, n_nonzero from tests",
    "friedman_stat": _FRIEDMAN + "select dataset, metric, k, model, n_users, n_configs, round(q, 5) as statistic from ft",
    "friedman_p": _FRIEDMAN
    + """select dataset, metric, k, model, n_users, n_configs, round(q, 5) as statistic, 'friedman' as test_type, case when q is null then null when q > 600 then 0 else round(greatest(1 - list_sum(list_transform(range(0, 1000),
  lambda i: exp(-q / 2 + ((n_configs - 1) / 2.0::double + i) * ln(greatest(q, 1e-300::double) / 2) - lgamma((n_configs - 1) / 2.0::double + i + 1)))), 0), 8) end as p_value from ft""",
    "holm": _CORRECTED + _OUT + "(select *, max(least(p_value * (m - i + 1), 1)) over (partition by dataset, metric, k, family, model, base, condition order by i) as pc from m)",
    "bonferroni": _CORRECTED + _OUT + "(select *, least(p_value * m, 1) as pc from m)",
    "no_correction": _CORRECTED + _OUT + "(select *, p_value as pc from m)",
    "cliffs_delta": _TESTS
    + """,
av as (select dataset, metric, k, config_a, config_b, a as v, count(*) as n from d group by all), bv as (select dataset, metric, k, config_a, config_b, b as v, count(*) as n from d group by all),
cd as (select av.dataset, av.metric, av.k, av.config_a, av.config_b, sum(case when av.v > bv.v then av.n * bv.n when av.v < bv.v then -av.n * bv.n else 0 end)::double / sum(av.n * bv.n) as x from av join bv using (dataset, metric, k, config_a, config_b) group by all)
select dataset, metric, k, config_a, config_b, round(x, 6) as cliffs_delta, case when abs(x) < 0.147 then 'negligible' when abs(x) < 0.33 then 'small' when abs(x) < 0.474 then 'medium' else 'large' end as magnitude from cd""",
    "cohens_d": _TESTS + "select dataset, metric, k, config_a, config_b, round(case when stddev_samp(a - b) > 1e-12 then avg(a - b) / stddev_samp(a - b) else 0 end, 5) as cohens_d from d group by all",
    "user_set_mismatch": _TESTS
    + """, va as (select dataset, metric, k, count(distinct user_id) as n_all from vals where dataset is not null group by all), vo as (select dataset, metric, k, config, count(distinct user_id) as n_own from vals group by all)
select dataset, metric, k, config, n_all - n_own as n_missing from vo join va using (dataset, metric, k) where n_own < n_all""",
    "paired_matrix": """
with er as (select * from evaluation_long where recommender is not null and embedding_name is not null and user_id is not null),
top as (select embedding_name, row_number() over (order by count(*) desc, embedding_name) as i from er group by 1),
v as (select user_id, embedding_name, round(avg(metric_value), 9) as v from er where metric = 'ndcg' and metric_value is not null and not isnan(metric_value) group by 1, 2)
select a.user_id, x.embedding_name as system_a, a.v as value_a, y.embedding_name as system_b, b.v as value_b
from top x join top y on x.i = 1 and y.i = 2 join v a on a.embedding_name = x.embedding_name join v b on b.embedding_name = y.embedding_name and b.user_id = a.user_id""",
    "consolidated": _FRIEDMAN
    + """, cm as (select dataset, recommender, embedding_name, metric, k, count(*) as n_users, round(avg(metric_value) filter (not isnan(metric_value)), 9) as value from evaluation_long group by all)
select 'evaluation' as kind, dataset, recommender, embedding_name, metric, k, n_users, value from cm union all select 'friedman', dataset, model, null, metric, k, n_users, round(q, 5) from ft""",
    "report_best": _MEANS + f"select dataset, {_COND} as cond, recommender, embedding_name, metric, k, n_users, mean from cm where metric = 'ndcg' and k = 10 and mean is not null qualify row_number() over (partition by dataset, {_COND}, recommender order by mean desc, embedding_name nulls first) = 1",
    "cell_mean": _MEANS + "select * from cm",
    "cross_seed_stats": _MEANS + "select recommender, embedding_name, metric, k, round(avg(mean), 12) as mean, round(stddev_samp(mean), 12) as std, round(median(mean), 12) as median, round(min(mean), 12) as min, round(max(mean), 12) as max, count(mean) as n from cm where mean is not null group by all",
    "best_per_recommender": _MEANS + f"select dataset, {_COND} as cond, recommender, metric, k, embedding_name, n_users, mean from cm where mean is not null qualify row_number() over (partition by dataset, {_COND}, recommender, metric, k order by mean desc, embedding_name nulls first) = 1",
    "frozen_finetuned_delta": _MEANS + f"select dataset, recommender, metric, k, max(mean) filter ({_COND} = 'frozen') as frozen, max(mean) filter ({_COND} = 'finetuned') as finetuned, round(max(mean) filter ({_COND} = 'finetuned') - max(mean) filter ({_COND} = 'frozen'), 9) as delta from cm group by all",
    "top_n_configs": _MEANS + "select * from cm where metric = 'ndcg' and k = 10 and mean is not null order by mean desc, dataset, recommender, embedding_name limit 10",
    "evaluation_long": _MEANS + f"select dataset, recommender, embedding_name, metric, k, mean as metric_value, {_PARSE.format(cond='cond')} from (select *, {_STEM} from cm) where mean is not null and recommender is not null and embedding_name is not null",
    "parse_embedding_name": f"""
select embedding_name, {_PARSE.format(cond='condition')}, case when embedding_name = 'none' then 'none' when embedding_name like 'hybrid\\_%' escape '\\' then 'fusion' else 'backbone' end as kind,
  replace(regexp_replace(embedding_name, '_comp$', ''), '_finetuned', '') as base
from (select embedding_name, {_STEM} from (select embedding_name from visual_embeddings union select embedding_name from evaluation_long) where embedding_name is not null)""",
    "parse_config": _CELLS + "select distinct config, model as recommender, e as embedding_name from kinds",
    "name_keys": _CELLS
    + """select 'all__' || model || '__' || e as cell_key, regexp_replace(model || '/' || e, '[^A-Za-z0-9._-]+', '_', 'g') as safe,
('0x' || md5('42:all__' || model || '__' || e)[1:15])::bigint % 2147483648 as seed, unnest(case when e = 'none' then ['frozen', 'finetuned'] else [cond] end) as condition from kinds""",
    "cost_projection": _STATE + "select role, n_open, round(mean, 5) as mean_seconds, round(n_open * mean, 4) as estimate_seconds from (select role, count(*) as n_open from st where state <> 'done' group by 1) left join (select role, avg(n) as mean from st where state = 'done' group by 1) using (role)",
    "pending_jobs": _STATE + "select dataset, recommender, count(*) as n_open from st where state <> 'done' group by rollup (dataset, recommender) having count(*) > 0",
    "state_counts": _STATE + "select state, count(*) as n from st group by 1",
    "cell_enumeration": f"""
select dataset, recommender, embedding_name, {_COND} as condition from (select distinct source as dataset from train where source is not null) cross join (
  select recommender, embedding_name from (select unnest(['vbpr', 'vnpr', 'deepstyle', 'avbpr']) as recommender) cross join (select distinct embedding_name from visual_embeddings where embedding_name is not null and not suffix(embedding_name, '_comp'))
  union all select 'acf', embedding_name from (select distinct embedding_name from visual_embeddings where suffix(embedding_name, '_comp')) union all select 'bpr', 'none')""",
    "hp_grid": "select * from (select unnest([64, 128]) as latent) cross join (select unnest([0.001, 0.01]::double[]) as lr) cross join (select unnest([0.0001, 0.001]::double[]) as l2) cross join (select unnest([64, 128]) as visual)",
    "confusion_matrix": _SCORES + "select actual, predicted, n from cmx",
    "class_prf": _SCORES + "select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from rep",
    "class_means": _SCORES
    + """select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(precision * support) / sum(support), 6) as weighted_precision,
round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as support from rep""",
    "topk_accuracy": _SCORES
    + """, own as (select vec_id, s as o from sc where class = label), ra as (select sc.vec_id, count(*) filter (s > o) as ahead, ln(sum(exp(s - o))) as loss from sc join own using (vec_id) group by 1)
select count(*) as n, round(avg((ahead < 1)::int), 6) as top1, round(avg((ahead < 5)::int), 6) as topk, round(sum(loss), 3) as loss from ra""",
}
