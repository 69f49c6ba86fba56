"""Splits, subsamples and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.skew import ranked_within


def draw(seed: int, *columns: Column) -> Column:
    """A reproducible order: the MD5 text of seed and values joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))


def leave_one_out(df: DataFrame, user: str, item: str, ts: str, least: int = 3, seed: int = 42) -> DataFrame:
    """user, item, split: per user the newest item is test, the next val, the rest train.

    Repeated (user, item) rows count once, at their first time, so that no held-out item is in train too; users with
    fewer than least items are left out. Equal times are ordered by the seeded draw; null times come last.
    """
    once = df.dropna(subset=[user, item]).groupBy(user, item).agg(F.min(ts).alias("_ts"))
    own = Window.partitionBy(user)
    placed = once.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_place", F.row_number().over(own.orderBy(F.desc_nulls_last("_ts"), draw(seed, F.col(user), F.col(item)))))
    split = F.when(F.col("_place") == 1, "test").when(F.col("_place") == 2, "val").otherwise("train")
    return placed.where(F.col("_n") >= least).select(user, item, split.alias("split"))


def stratified(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with part: per label max(1, floor(n * share)) rows are train, the rest eval, by a seeded order.

    A label with a third of all rows is ranked over several tasks.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn("_draw", draw(seed, F.col(key)))
    sizes = rows.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("_train"))
    ranked = ranked_within(rows, label, ["_draw", key], "stratified", "_rank")
    return ranked.join(sizes, label).withColumn("part", F.when(F.col("_rank") <= F.col("_train"), "train").otherwise("eval")).drop("_draw", "_rank", "_train")


def truncated_history(df: DataFrame, user: str, item: str, most: int) -> DataFrame:
    """user, history: the most smallest item ids of each user, ascending. Only most ids of a user leave a task."""
    once = df.dropna(subset=[user, item]).select(user, item).distinct()
    placed = once.withColumn("_place", F.row_number().over(Window.partitionBy(user).orderBy(item))).where(F.col("_place") <= most)
    return placed.groupBy(user).agg(F.sort_array(F.collect_list(item)).alias("history"))


def history_vectors(histories: DataFrame, user: str, vectors: DataFrame, item: str) -> DataFrame:
    """user, place (from 0), item and the columns of vectors: the vectors of every item of a history; items without one are left out."""
    return histories.select(user, F.posexplode("history").alias("place", item)).join(vectors, item)


def user_subsample(users: DataFrame, user: str, size: int, seed: int = 42) -> DataFrame:
    """size users without replacement, the first by the seeded draw; all if there are fewer. The size is that of the evaluation sample."""
    return users.select(user).dropna().distinct().orderBy(draw(seed, F.col(user)), user).limit(size)


def seen_items(*splits: DataFrame) -> DataFrame:
    """Distinct complete (user_idx, item_idx) rows of several splits."""
    out = splits[0].select("user_idx", "item_idx")
    for s in splits[1:]:
        out = out.unionByName(s.select("user_idx", "item_idx"))
    return out.dropna().distinct()
