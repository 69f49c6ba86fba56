"""Queries on ids, splits, rankings and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics, vectors
from orrery.operators import ids, ranking, splits
from orrery.sources.tables import table
from orrery.staging import stage


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "id_map").where("kind = 'item'").select(F.col("idx").alias("item_idx"))


def _held(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return table(spark, sf, "heldout").where(F.col("split") == split).select("user_idx", "item_idx").dropna().distinct()


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return splits.seen_items(table(spark, sf, "train"), _held(spark, sf, "val"))


def _popularity(spark: SparkSession, sf: str) -> DataFrame:
    counted = splits.seen_items(table(spark, sf, "train")).groupBy("item_idx").agg(F.count(F.lit(1)).alias("score"))
    return _catalogue(spark, sf).join(counted, "item_idx", "left").select("item_idx", F.coalesce("score", F.lit(0)).alias("score"))


def _order(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.global_order(_popularity(spark, sf), ranking.tie_keys(_catalogue(spark, sf)))


def full_ranking_popularity(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: rank of each test item by popularity over the whole catalogue, train and val masked, with metrics at 10."""
    records = ranking.rank_by_correction(_order(spark, sf), _seen(spark, sf), _held(spark, sf, "test"))
    m = metrics.rank_metrics(F.col("rank"), 10)
    return records.select("*", m["recall"].alias("recall_10"), F.round(m["ndcg"], 6).alias("ndcg_10"))


def rank_by_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Selection protocol: val items held, train masked."""
    return ranking.rank_by_correction(_order(spark, sf), splits.seen_items(table(spark, sf, "train")), _held(spark, sf, "val"))


def tie_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Tie statistics of the flagship ranking."""
    t = ranking.tie_statistics(ranking.rank_by_correction(_order(spark, sf), _seen(spark, sf), _held(spark, sf, "test")))
    return t.select("n_users", F.round("share_tied", 6).alias("share_tied"), F.round("mean_block", 6).alias("mean_block"), "max_block")


def top20_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 unseen items of every test user."""
    return ranking.top_by_correction(_order(spark, sf), _seen(spark, sf), _held(spark, sf, "test"), 20)


def metrics_from_rank(spark: SparkSession, sf: str) -> DataFrame:
    """All rank metrics at 5, 10 and 20, averaged over users."""
    records = ranking.rank_by_correction(_order(spark, sf), _seen(spark, sf), _held(spark, sf, "test"))
    long = metrics.long_metrics(records, ["user_idx"], lambda k: metrics.rank_metrics(F.col("rank"), k))
    return metrics.mean_metrics(long, []).select("metric", "k", "n_users", F.round("mean", 6).alias("mean"))


def metrics_general_multi_gt(spark: SparkSession, sf: str) -> DataFrame:
    """The five list metrics of every test user's top 20 against all of their test items."""
    top = top20_lists(spark, sf).groupBy("user_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item_idx"))), lambda x: x.item_idx).alias("top"))
    truth = _held(spark, sf, "test").groupBy("user_idx").agg(F.collect_list("item_idx").alias("truth"))
    long = metrics.long_metrics(top.join(truth, "user_idx"), ["user_idx"], lambda k: metrics.list_metrics(F.col("top"), F.col("truth"), k))
    return long.select("user_idx", "metric", "k", F.round("value", 6).alias("value"))


def metrics_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the list metrics over users."""
    return metrics.mean_metrics(metrics_general_multi_gt(spark, sf), []).select("metric", "k", "n_users", F.round("mean", 5).alias("mean"))


def named_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embedding_name, item_idx, vector, dim: every name's vectors of its dimension that are finite, the least of an item's."""
    dim = F.regexp_extract("embedding_name", r"_(?:D|pcaD)([0-9]+)$", 1)
    v = table(spark, sf, "visual_embeddings").where("embedding_name is not null and item_idx is not null").withColumn("dim", F.when(dim != "", dim.cast("int")))
    v = v.where((F.size("features") == F.col("dim")) & vectors.finite(F.col("features")))
    return v.groupBy("embedding_name", "item_idx", "dim").agg(F.transform(F.min("features"), lambda x: x.cast("double")).alias("vector"))


def _content(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Mean vector of every user's train items, and the items' vectors, per embedding name."""
    items = named_vectors(spark, sf).drop("dim")
    mine = splits.seen_items(table(spark, sf, "train")).join(items, "item_idx").select("embedding_name", "user_idx", F.posexplode("vector").alias("i", "x"))
    means = mine.groupBy("embedding_name", "user_idx", "i").agg(F.avg("x").alias("x")).groupBy("embedding_name", "user_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("vector"))
    return means, items


def content_full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each test item with a vector by the mean vector of the user's train items, for every embedding name."""
    users, items = _content(spark, sf)
    return ranking.dot_ranking(users, stage(items, "content-items"), ranking.tie_keys(_catalogue(spark, sf)), _seen(spark, sf), _held(spark, sf, "test"), digits=7, by="embedding_name")


def sampled_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each test item among 100 sampled unseen items."""
    scores = _popularity(spark, sf).join(ranking.tie_keys(_catalogue(spark, sf)), "item_idx")
    return ranking.sampled_ranking(scores, _seen(spark, sf), _held(spark, sf, "test"))


def negative_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled unseen items of every test user."""
    held = _held(spark, sf, "test")
    return ranking.negative_pool(held, _seen(spark, sf).unionByName(held), _catalogue(spark, sf).count(), 100)


def bpr_triples(spark: SparkSession, sf: str) -> DataFrame:
    """One epoch of (user, positive, negative) over all train pairs."""
    return ranking.user_negatives(table(spark, sf, "train"), _catalogue(spark, sf).count())


def loo_split(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out split of interactions by time."""
    return splits.leave_one_out(table(spark, sf, "interactions"), "user_id", "item_id", "ts")


def seen_items(spark: SparkSession, sf: str) -> DataFrame:
    """Train and val items of every user."""
    return _seen(spark, sf)


def min_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Users with at least 3 interactions, and their number."""
    rows = ids.clean_interactions(table(spark, sf, "interactions"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def dense_item_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Items of interactions numbered by first appearance."""
    return ids.dense_ids(ids.clean_interactions(table(spark, sf, "interactions")), "item_id", "row_id")


def mapped_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions with dense ids; rows with ids that are not in id_map are left out."""
    m = table(spark, sf, "id_map")
    side = lambda kind, name: m.where(F.col("kind") == kind).select(F.col("ext_id").alias(f"{name}_id"), F.col("idx").alias(f"{name}_idx"))
    rows = ids.clean_interactions(table(spark, sf, "interactions")).select("row_id", "user_id", "item_id")
    return rows.join(side("user", "user"), "user_id").join(side("item", "item"), "item_id").select("row_id", "user_idx", "item_idx")


def unmapped_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of interactions that the id map does not know."""
    m, rows = table(spark, sf, "id_map"), table(spark, sf, "interactions")
    side = lambda kind: rows.groupBy(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("ext_id")).agg(F.count(F.lit(1)).alias("n")).where("ext_id is not null").join(m, ["kind", "ext_id"], "left_anti")
    return side("user").unionByName(side("item"))


def id_map_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Contract of the id maps."""
    return ids.contiguity(table(spark, sf, "id_map"), "kind", "idx")


def index_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows whose index lies outside the id maps, per column."""
    n = {r["kind"]: r["n"] for r in table(spark, sf, "id_map").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    t = table(spark, sf, "train")
    part = lambda c, kind: ids.out_of_range(t, c, n.get(kind, 0)).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(c).alias("column_name"), "n_rows")
    return part("user_idx", "user").unionByName(part("item_idx", "item"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "id_map").where("kind = 'item'").select(F.col("ext_id").alias("item_id"), F.col("idx").alias("item_idx"))


def sidecar_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Valid labels of known items, last row wins, contiguous."""
    return ids.sidecar_categories(table(spark, sf, "categories"), _items(spark, sf))


def item_category_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Every item with its category, the unlabelled in an extra bucket."""
    return ids.item_categories(_items(spark, sf), sidecar_categories(spark, sf)).select("item_idx", "category")


def category_derive(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of parts with at least 5 items, contiguous."""
    return ids.derived_labels(table(spark, sf, "part"), "p_partkey", F.col("p_brand"), 5)


def taxonomy_label_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Label at depth 1 of a two-level path, else the deepest: image paths of interactions as taxonomies."""
    rows = table(spark, sf, "interactions").where("image_path is not null").select("image_path").distinct()
    paths = F.array(F.array().cast("array<string>"), F.split("image_path", "/"))
    return rows.select("image_path", ids.path_label(paths, 1).alias("label_1"), ids.path_label(paths, 9).alias("label_9"))


def item_image_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every known item with the path of its first row that has one."""
    first = ids.first_paths(table(spark, sf, "interactions").select("item_id", "image_path", "row_id"), "item_id", "image_path", "row_id")
    return _items(spark, sf).join(first, "item_id", "left").select("item_idx", "image_path")


def train_item_set(spark: SparkSession, sf: str) -> DataFrame:
    """Items with at least one train interaction."""
    return table(spark, sf, "train").select("item_idx").dropna().distinct()


def category_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that the label file declares against those that known items use, and whether they are equally many."""
    valid = table(spark, sf, "categories").where(F.col("category_label").rlike(r"\A[0-9]{1,4}\z"))
    declared = valid.agg(F.countDistinct(F.col("category_label").cast("int")).alias("n_declared"))
    used = sidecar_categories(spark, sf).agg(F.countDistinct("category_label").alias("n_used"))
    return declared.join(used).withColumn("holds", F.col("n_declared") == F.col("n_used"))  # one row each


def history_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of the first 5 items of every train user's history, per embedding name, with their place."""
    h = splits.truncated_history(table(spark, sf, "train"), "user_idx", "item_idx", 5)
    v = splits.history_vectors(h, "user_idx", named_vectors(spark, sf), "item_idx")
    return v.select("user_idx", "place", "item_idx", "embedding_name", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


def history_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 smallest item ids of every train user."""
    h = splits.truncated_history(table(spark, sf, "train"), "user_idx", "item_idx", 5)
    return h.select("user_idx", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """80/20 split of labelled vectors per label."""
    return splits.stratified(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")


def user_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """2,000 validation users drawn with the base seed."""
    return splits.user_subsample(_held(spark, sf, "val"), "user_idx", 2000)


QUERIES = {
    f.__name__: f
    for f in (
        full_ranking_popularity, rank_by_correction, tie_stats, top20_lists, metrics_from_rank, metrics_general_multi_gt, metrics_aggregate, content_full_ranking, sampled_ranking, negative_pool, bpr_triples,
        loo_split, seen_items, min_interactions, dense_item_ids, mapped_interactions, unmapped_ids, id_map_contiguous, index_out_of_range, sidecar_categories, item_category_bucket,
        category_derive, taxonomy_label_fallback, item_image_paths, train_item_set, history_truncated, history_vectors, category_contract, stratified_split, user_subsample,
    )
}

_BASE = """
with train_set as (select distinct user_idx, item_idx from train where user_idx is not null and item_idx is not null),
held as (select distinct split, user_idx, item_idx from heldout where user_idx is not null and item_idx is not null),
catalogue as (select idx as item_idx from id_map where kind = 'item'),
item_order as (
  select item_idx, coalesce(score, 0) as score, row_number() over (order by coalesce(score, 0) desc, md5('42:' || item_idx), item_idx) as place
  from catalogue left join (select item_idx, count(*) as score from train_set group by 1) using (item_idx)),
seen as (select user_idx, item_idx from train_set union select user_idx, item_idx from held where split = 'val'),
test as (select user_idx, item_idx from held where split = 'test' and (user_idx, item_idx) not in (select (user_idx, item_idx) from seen)),
"""


def _ranked(held: str, seen: str) -> str:
    return f"""
ranked as (
  select h.user_idx, h.item_idx, o.place - count(so.place) filter (so.place < o.place) as rank,
         (select count(*) from catalogue) - count(so.place) as n_candidates,
         any_value(t.n) - count(so.place) filter (so.score = o.score) as tie_block_size
  from {held} h join item_order o on o.item_idx = h.item_idx
  join (select score, count(*) as n from item_order group by 1) t on t.score = o.score
  left join {seen} s on s.user_idx = h.user_idx left join item_order so on so.item_idx = s.item_idx
  group by h.user_idx, h.item_idx, o.place, o.score)
"""


_VAL = "val as (select user_idx, item_idx from held where split = 'val' and (user_idx, item_idx) not in (select (user_idx, item_idx) from train_set)),"
_TOP = """
top as (
  select user_idx, item_idx, row_number() over (partition by user_idx order by place) as place
  from (select distinct user_idx from held where split = 'test') u cross join item_order o
  where not exists (select 1 from seen s where s.user_idx = u.user_idx and s.item_idx = o.item_idx)
  qualify row_number() over (partition by user_idx order by place) <= 20),
"""
_LISTS = (
    _TOP
    + """
ks as (select unnest([5, 10, 20]) as k),
truth as (select user_idx, count(*) as n from held where split = 'test' group by 1),
hits as (
  select t.user_idx, k, place, row_number() over (partition by t.user_idx, k order by place) as nth
  from top t join held h on h.split = 'test' and h.user_idx = t.user_idx and h.item_idx = t.item_idx join ks on place <= k),
base as (
  select u.user_idx, k, n, count(place) as found, coalesce(sum(nth::double / place), 0::double) as summed, coalesce(sum(1 / log2(place + 1)), 0::double) as gain
  from truth u cross join ks left join hits using (user_idx, k) group by 1, 2, 3),
ideal as (select k as m, (select sum(1 / log2(i + 1)) from range(1, k + 1) r(i)) as best from range(1, 21) t(k)),
five as (
  select user_idx, b.k, found::double / b.k as p, found::double / n as r, summed / least(b.k, n) as map, gain / best as ndcg from base b join ideal on m = least(b.k, n)),
long as (
  select user_idx, 'precision' as metric, k, p as value from five union all select user_idx, 'recall', k, r from five
  union all select user_idx, 'f1', k, case when p + r > 0 then 2 * p * r / (p + r) else 0 end from five
  union all select user_idx, 'map', k, map from five union all select user_idx, 'ndcg', k, ndcg from five)
"""
)
_CATEGORIES = """
with known as (select ext_id as item_id, idx from id_map where kind = 'item'),
last as (select item_id, arg_max(category_label, row_id)::int as label from categories
         where item_id is not null and regexp_full_match(category_label, '[0-9]{1,4}') and item_id in (select item_id from known) group by 1),
labelled as (select item_id, dense_rank() over (order by label) - 1 as category_label from last)
"""

_VECTORS = """,
f as (select embedding_name, item_idx, list_transform(min(features), lambda x: x::double) as v from visual_embeddings where embedding_name is not null and item_idx is not null
  and len(features) = try_cast(regexp_extract(embedding_name, '_(?:D|pcaD)([0-9]+)$', 1) as int) and len(list_filter(features, lambda x: x is null or not isfinite(x))) = 0 group by 1, 2)
"""
_POOL = """
barred as (select * from seen union select user_idx, item_idx from held where split = 'test'),
asked as (select distinct user_idx from test),
free as (select u.user_idx, c.item_idx, row_number() over (partition by u.user_idx order by c.item_idx) - 1 as at, count(*) over (partition by u.user_idx) as n
  from asked u cross join catalogue c anti join barred b on b.user_idx = u.user_idx and b.item_idx = c.item_idx),
sizes as (select user_idx, any_value(n) as n, least(100, any_value(n)) as size from free group by 1),
draws as (select user_idx, n, size, unnest(range(0, size)) as draw from sizes),
places as (select user_idx, draw, floor(draw * n / size::double)::bigint as lo, floor((draw + 1) * n / size::double)::bigint as hi from draws),
pool as (select p.user_idx, p.draw, f.item_idx from places p join free f on f.user_idx = p.user_idx and f.at = lo + ('0x' || md5('42:' || p.user_idx || ':' || p.draw)[1:15])::bigint % (hi - lo))
"""

SQL = {
    "full_ranking_popularity": _BASE + _ranked("test", "seen") + "select *, case when rank <= 10 then 1.0::double else 0::double end as recall_10, round(case when rank <= 10 then 1 / log2(rank + 1) else 0::double end, 6) as ndcg_10 from ranked",
    "rank_by_correction": _BASE + _VAL + _ranked("val", "train_set") + "select * from ranked",
    "tie_stats": _BASE + _ranked("test", "seen") + "select count(*) as n_users, round(avg((tie_block_size > 1)::int), 6) as share_tied, round(avg(tie_block_size), 6) as mean_block, max(tie_block_size) as max_block from ranked",
    "top20_lists": _BASE + _TOP.rstrip().rstrip(",") + " select user_idx, place::int as place, item_idx from top",
    "metrics_from_rank": _BASE
    + _ranked("test", "seen")
    + """, ks as (select unnest([5, 10, 20]) as k),
v as (select k, rank, (rank <= k)::int::double as hit from ranked cross join ks),
long as (select 'hitrate' as metric, k, hit as value from v union all select 'precision', k, hit / k from v union all select 'recall', k, hit from v
  union all select 'f1', k, 2 * hit / (k + 1) from v union all select 'map', k, hit / rank from v union all select 'mrr', k, hit / rank from v
  union all select 'ndcg', k, hit / log2(rank + 1) from v)
select metric, k, count(*) as n_users, round(avg(value), 6) as mean from long group by 1, 2""",
    "metrics_general_multi_gt": _BASE + _LISTS + "select user_idx, metric, k, round(value, 6) as value from long",
    "metrics_aggregate": _BASE + _LISTS + "select metric, k, count(*) as n_users, round(avg(round(value, 6)), 5) as mean from long group by 1, 2",
    "content_full_ranking": _BASE.rstrip().rstrip(",")
    + _VECTORS
    + """,
fx as (select f.* from f join catalogue using (item_idx)),
ux as (select embedding_name, user_idx, i, avg(x) as x from (select embedding_name, user_idx, generate_subscripts(v, 1) as i, unnest(v) as x from train_set join fx using (item_idx)) group by 1, 2, 3),
u as (select embedding_name, user_idx, list(x order by i) as w from ux group by 1, 2),
sc as (select embedding_name, user_idx, item_idx, round(list_dot_product(w, v), 7) as s, md5('42:' || item_idx) as k from u join fx using (embedding_name)
       where user_idx in (select user_idx from test) and not exists (select 1 from seen where seen.user_idx = u.user_idx and seen.item_idx = fx.item_idx))
select c.embedding_name, h.user_idx, h.item_idx, 1 + count(*) filter (c.s > hs.s or (c.s = hs.s and c.k < hs.k)) as rank, count(*) as n_candidates, count(*) filter (c.s = hs.s) as tie_block_size
from test h join sc hs on hs.user_idx = h.user_idx and hs.item_idx = h.item_idx join sc c on c.user_idx = h.user_idx and c.embedding_name = hs.embedding_name group by 1, 2, 3""",
    "sampled_ranking": _BASE
    + _POOL
    + """,
sp as (select p.user_idx, o.score as s, md5('42:' || p.item_idx) as k from pool p join item_order o using (item_idx)),
sh as (select t.user_idx, t.item_idx, o.score, md5('42:' || t.item_idx) as key from test t join item_order o using (item_idx))
select sh.user_idx, sh.item_idx, 1 + count(*) filter (s > score or (s = score and k < key)) as rank, 1 + count(s) as n_candidates, 1 + count(*) filter (s = score) as tie_block_size
from sh left join sp using (user_idx) group by 1, 2""",
    "negative_pool": _BASE + _POOL.replace("from test)", "from held where split = 'test')") + " select user_idx, draw, item_idx from pool",
    "bpr_triples": _BASE.rstrip().rstrip(",")
    + """,
inside as (select * from train_set where item_idx >= 0 and item_idx < (select count(*) from catalogue)),
free as (select u.user_idx, c.item_idx, row_number() over (partition by u.user_idx order by c.item_idx) - 1 as at, count(*) over (partition by u.user_idx) as n
  from (select distinct user_idx from inside) u cross join catalogue c anti join inside t on t.user_idx = u.user_idx and t.item_idx = c.item_idx)
select t.user_idx, t.item_idx, f.item_idx as negative_idx from inside t join free f on f.user_idx = t.user_idx
  and f.at = ('0x' || md5('42:1:' || t.user_idx || ':' || t.item_idx)[1:15])::bigint % f.n""",
    "category_contract": _CATEGORIES
    + """, c as (select (select count(distinct category_label::int) from categories where regexp_full_match(category_label, '[0-9]{1,4}')) as n_declared, (select count(distinct category_label) from labelled) as n_used)
select *, n_declared = n_used as holds from c""",
    "history_vectors": "with h as (select user_idx, list_sort(list(distinct item_idx))[1:5] as history from train where user_idx is not null and item_idx is not null group by 1), p as (select user_idx, generate_subscripts(history, 1) - 1 as place, unnest(history) as item_idx from h)"
    + _VECTORS
    + " select user_idx, place::int as place, item_idx, embedding_name, round(v[1], 6) as first, round(v[-1], 6) as last from p join f using (item_idx)",
    "user_subsample": "select user_idx from (select distinct user_idx from heldout where split = 'val' and user_idx is not null and item_idx is not null) order by md5('42:' || user_idx), user_idx limit 2000",
    "loo_split": """
with once as (select user_id, item_id, min(ts) as ts from interactions where user_id is not null and item_id is not null group by 1, 2),
p as (select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by ts desc nulls last, md5('42:' || user_id || ':' || item_id)) as place from once)
select user_id, item_id, case place when 1 then 'test' when 2 then 'val' else 'train' end as split from p where n >= 3""",
    "seen_items": _BASE.rstrip().rstrip(",") + " select user_idx, item_idx from seen",
    "min_interactions": "select user_id, count(*) as n from interactions where user_id is not null and item_id is not null group by 1 having count(*) >= 3",
    "dense_item_ids": "select item_id, row_number() over (order by first, item_id) - 1 as idx from (select item_id, min(row_id) as first from interactions where user_id is not null and item_id is not null group by 1)",
    "mapped_interactions": "select row_id, u.idx as user_idx, i.idx as item_idx from interactions join id_map u on u.kind = 'user' and u.ext_id = user_id join id_map i on i.kind = 'item' and i.ext_id = item_id",
    "unmapped_ids": """
select 'user' as kind, user_id as ext_id, count(*) as n from interactions where user_id not in (select ext_id from id_map where kind = 'user') group by 2
union all select 'item', item_id, count(*) from interactions where item_id not in (select ext_id from id_map where kind = 'item') group by 2""",
    "id_map_contiguous": "select kind, count(*) as n, count(distinct idx) as n_distinct, min(idx) as least, max(idx) as most, min(idx) = 0 and max(idx) = count(*) - 1 and count(distinct idx) = count(*) as contiguous from id_map group by 1",
    "index_out_of_range": """
select 'user_idx' as column_name, count(*) as n_rows from train where user_idx < 0 or user_idx >= (select count(*) from id_map where kind = 'user')
union all select 'item_idx', count(*) from train where item_idx < 0 or item_idx >= (select count(*) from id_map where kind = 'item')""",
    "sidecar_categories": _CATEGORIES + "select item_id, category_label::int as category_label from labelled",
    "item_category_bucket": _CATEGORIES + "select idx as item_idx, coalesce(category_label, (select coalesce(max(category_label), -1) + 1 from labelled))::int as category from known left join labelled using (item_id)",
    "category_derive": """
with kept as (select p_brand from part where p_brand <> '' group by 1 having count(*) >= 5), codes as (select p_brand, row_number() over (order by p_brand) - 1 as category_label from kept)
select p_partkey, category_label::int as category_label from part join codes using (p_brand)""",
    "taxonomy_label_fallback": """
select image_path, p[least(2, len(p))] as label_1, p[least(10, len(p))] as label_9 from (select distinct image_path, string_split(image_path, '/') as p from interactions where image_path is not null)""",
    "item_image_paths": "select idx as item_idx, p as image_path from id_map left join (select item_id, arg_min(image_path, row_id) filter (image_path is not null) as p from interactions where item_id is not null group by 1) on item_id = ext_id where kind = 'item'",
    "train_item_set": "select distinct item_idx from train where item_idx is not null",
    "history_truncated": "select user_idx, array_to_string(list_sort(list(distinct item_idx))[1:5], ',') as history from train where user_idx is not null and item_idx is not null group by 1",
    "stratified_split": """
select vec_id, label, case when row_number() over (partition by label order by md5('42:' || vec_id), vec_id) <= greatest(1, floor(count(*) over (partition by label) * 0.8::double)) then 'train' else 'eval' end as part
from embeddings where label is not null""",
}
