"""Masked rankings of held-out items over the whole catalogue, with a seeded tie-break."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.skew import ranked_within
from orrery.operators.splits import draw
from orrery.staging import stage

RECORD = "user_idx long, item_idx long, rank long, n_candidates long, tie_block_size long"


def tie_keys(items: DataFrame, seed: int = 42) -> DataFrame:
    """item_idx, tie_key: the MD5 order, the same in any engine."""
    return items.select("item_idx", draw(seed, F.col("item_idx")).alias("tie_key"))


def permutation_keys(spark, n_items: int, seed: int = 42) -> DataFrame:
    """item_idx, tie_key: numpy's seeded permutation of a catalogue that fits the driver."""
    keys = np.random.default_rng(seed).permutation(n_items)
    return spark.createDataFrame(pd.DataFrame({"item_idx": np.arange(n_items), "tie_key": keys}))


def global_order(scores: DataFrame, keys: DataFrame) -> DataFrame:
    """item_idx, score, tie_key, place, tie: items by falling score, then tie key, numbered from 1; tie is the number of items of the same score.

    NaN counts as minus infinity. The order is staged when the DataFrame is built.
    """
    clean = scores.withColumn("score", F.when(F.isnan(F.col("score").cast("double")), F.lit(float("-inf"))).otherwise(F.col("score")))
    placed = ranked_within(clean.join(keys, "item_idx").withColumn("_down", -F.col("score")), None, ["_down", "tie_key", "item_idx"], "item-order", "place").drop("_down")
    return placed.join(_small(placed.groupBy("score").agg(F.count(F.lit(1)).alias("tie"))), "score")


def _small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df, marked for a broadcast if it has at most most_rows narrow rows: a join on a key that a third of the rows share then needs no shuffle of them."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def rank_by_correction(order: DataFrame, seen: DataFrame, held: DataFrame) -> DataFrame:
    """Rank of every held-out item where all users share the item scores: user_idx, item_idx, rank, n_candidates, tie_block_size.

    The rank is the item's place in the common order less the user's seen items before it, so the work is
    in proportion to the interactions, never users times items. seen is masked; a held item that is seen
    too is left out. Users without seen items are ranked on the whole catalogue. Duplicates count once.

    The order is broadcast where it is small; beyond, the join on the item is left to the engine, which splits its hot
    items. A user's window has at most as many rows as the catalogue has items.
    """
    n_items = order.count()
    marks = seen.select("user_idx", "item_idx", F.lit(1).alias("is_seen")).unionByName(held.select("user_idx", "item_idx", F.lit(0).alias("is_seen"))).dropna()
    marks = marks.groupBy("user_idx", "item_idx").agg(F.max("is_seen").alias("is_seen"))
    placed = marks.join(_small(order.select("item_idx", "score", "place", "tie")), "item_idx")
    own = Window.partitionBy("user_idx")
    before = own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # items of one score stand side by side in the order, so that the same sort serves all three
    out = placed.withColumns(
        {
            "rank": F.col("place") - F.sum("is_seen").over(before),
            "n_candidates": F.lit(n_items) - F.sum("is_seen").over(own),
            "tie_block_size": F.col("tie") - F.sum("is_seen").over(Window.partitionBy("user_idx", "score")),
        }
    )
    return out.where("is_seen = 0").select("user_idx", "item_idx", "rank", "n_candidates", "tie_block_size")


def top_by_correction(order: DataFrame, seen: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """user_idx, place, item_idx: the first n unseen items of the common order, places from 1.

    Only places up to n plus the user's own seen items can matter, so nothing is crossed.
    """
    places = seen.select("user_idx", "item_idx").dropna().distinct().join(order.select("item_idx", F.col("place").alias("at")), "item_idx")
    mine = users.select("user_idx").distinct().join(places.groupBy("user_idx").agg(F.collect_list("at").alias("taken")), "user_idx", "left")
    taken = F.coalesce("taken", F.array().cast("array<bigint>"))
    free = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.size(taken).cast("long") + n), taken), 1, n)
    rows = mine.select("user_idx", F.posexplode(free).alias("i", "at"))
    return rows.join(order.select("item_idx", F.col("place").alias("at")), "at").select("user_idx", (F.col("i") + 1).alias("place"), "item_idx")


def tie_statistics(records: DataFrame) -> DataFrame:
    """One row: held items, the share of them in a tie, mean and largest tie block."""
    return records.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg(F.when(F.col("tie_block_size") > 1, 1.0).otherwise(0.0)).alias("share_tied"),
        F.avg("tie_block_size").alias("mean_block"),
        F.max("tie_block_size").alias("max_block"),
    )


_TOP = ", top array<struct<down double, key string, item long>>"


def _masked(s: np.ndarray, idx: np.ndarray, seen: list[np.ndarray]) -> None:
    """Take the seen items of every row out of the candidates."""
    rows, flat = np.repeat(np.arange(len(seen)), [len(v) for v in seen]), np.concatenate([np.asarray(v, np.int64) for v in seen]) if len(seen) else np.empty(0, np.int64)
    if len(idx) and len(flat):
        at = np.minimum(np.searchsorted(idx, flat), len(idx) - 1)
        there = idx[at] == flat
        s[rows[there], at[there]] = np.nan


def _ranked(f: pd.DataFrame, s: np.ndarray, h: np.ndarray, idx: np.ndarray, tie: np.ndarray, top: int) -> pd.DataFrame:
    """Counts of one block of items for rows whose held item has score h and key own_key; NaN scores are no candidates."""
    mine = idx[None, :] == f["item_idx"].to_numpy()[:, None]
    equal = (s == h[:, None]) | mine
    ahead = ((s > h[:, None]) | (equal & (tie[None, :] < f["own_key"].to_numpy(str)[:, None]))) & ~mine
    out = pd.DataFrame({"user_idx": f["user_idx"], "item_idx": f["item_idx"], "rank": ahead.sum(1), "n_candidates": np.isfinite(s).sum(1), "tie_block_size": equal.sum(1)})
    if not top:
        return out.assign(top=None)
    lists = []
    for row in s:
        fine = np.flatnonzero(np.isfinite(row))
        if len(fine) > top:
            fine = fine[row[fine] >= np.partition(row[fine], len(fine) - top)[len(fine) - top]]  # with all ties at the cut
        best = fine[np.lexsort((tie[fine], -row[fine]))[:top]]
        lists.append([(-float(row[i]), str(tie[i]), int(idx[i])) for i in best])
    return out.assign(top=lists)


def dot_ranking(users: DataFrame, items: DataFrame, keys: DataFrame, seen: DataFrame, held: DataFrame, digits: int = 9, block_bytes: int = 64 << 20, users_per_block: int = 512, top: int = 0, by: str | None = None) -> DataFrame:
    """Rank of every held-out item by a dot-product score: [by,] user_idx, item_idx, rank, n_candidates, tie_block_size[, top_items].

    users (user_idx, vector), items (item_idx, vector, optional bias); with by, both hold that text column too and every value of it
    is a ranking of its own, all in one pass. Item vectors are taken in blocks of about block_bytes, each broadcast to a
    pass of blocked matrix products over the users; the counts of the blocks add up, so a catalogue larger than memory
    only means more passes. With several blocks the users' rows and the counts of every block are staged, so that one block is
    alive at a time. Scores are rounded to digits before they are compared. NaN scores are no candidates. Users or
    held items without a vector give no row. With top, the first top unseen items of the same pass come out too.
    """
    spark = users.sparkSession
    group = F.col(by) if by else F.lit("")
    seen = seen.select("user_idx", "item_idx").dropna().distinct()
    held = held.select("user_idx", "item_idx").dropna().distinct().join(seen, ["user_idx", "item_idx"], "left_anti")
    bias = F.col("bias") if "bias" in items.columns else F.lit(0.0)
    items = items.select(group.alias("by"), "item_idx", "vector", bias.alias("bias")).join(keys.select("item_idx", F.col("tie_key").cast("string").alias("tie_key")), "item_idx")
    both = seen.groupBy("user_idx").agg(F.collect_list("item_idx").alias("seen"))
    targets = held.join(items.select("by", "item_idx", F.col("vector").alias("own"), F.col("bias").alias("own_bias"), F.col("tie_key").alias("own_key")), "item_idx")
    rows = targets.join(users.select(group.alias("by"), "user_idx", "vector"), ["by", "user_idx"]).join(both, "user_idx", "left")
    rows = rows.select("by", "user_idx", "item_idx", "vector", "own", "own_bias", "own_key", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
    size = items.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows, counted, schema = stage(rows, "ranked-users") if n_blocks > 1 else rows, None, "`by` string, " + RECORD + _TOP
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("by", "item_idx"), F.lit(n_blocks)) == b)
        table, held_by = block.orderBy("by", "item_idx").toArrow(), {}  # about block_bytes
        names = np.array(table.column("by").to_pylist(), str)
        for name in np.unique(names):
            part = table.slice(int(np.searchsorted(names, name)), int((names == name).sum()))
            vectors = np.asarray(part.column("vector").combine_chunks().flatten()).reshape(part.num_rows, -1)
            held_by[str(name)] = np.asarray(part.column("item_idx")), vectors, np.asarray(part.column("bias")), np.array(part.column("tie_key").to_pylist(), str)
        shared = spark.sparkContext.broadcast(held_by)

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for name, own in whole.groupby("by"):
                    idx, x, add, tie = shared.value.get(name, (np.empty(0, np.int64), None, None, np.empty(0, str)))
                    for at in range(0, len(own), users_per_block):
                        f = own.iloc[at : at + users_per_block]
                        u, v = np.array(f["vector"].tolist(), float), np.array(f["own"].tolist(), float)
                        h = np.round(np.einsum("ij,ij->i", u, v) + f["own_bias"].to_numpy(float), digits)
                        s = np.round(u @ x.T + add, digits) if len(idx) else np.empty((len(f), 0))
                        _masked(s, idx, f["seen"].tolist())
                        yield _ranked(f, s, h, idx, tie, top).assign(by=name)[["by", "user_idx", "item_idx", "rank", "n_candidates", "tie_block_size", "top"]]

        part = rows.mapInPandas(score, schema)
        if n_blocks > 1:
            part = stage(part, f"ranks-{b}")
            shared.destroy()
        counted = part if counted is None else counted.unionByName(part)
    if n_blocks > 1:
        counted = counted.groupBy("by", "user_idx", "item_idx").agg(*(F.sum(c).alias(c) for c in ("rank", "n_candidates", "tie_block_size")), F.flatten(F.collect_list("top")).alias("top"))
    return _records(counted.withColumnRenamed("by", by) if by else counted.drop("by"), top)


def _records(counted: DataFrame, top: int) -> DataFrame:
    out = counted.withColumn("rank", F.col("rank") + 1)
    return out.withColumn("top_items", F.transform(F.slice(F.array_sort("top"), 1, top), lambda t: t.item)).drop("top") if top else out.drop("top")


def model_ranking(keys: DataFrame, seen: DataFrame, held: DataFrame, state: object, scores: Callable[[object, np.ndarray], np.ndarray], digits: int = 9, users_per_block: int = 256, top: int = 0) -> DataFrame:
    """The records of dot_ranking for a model whose scores are no dot products.

    scores(state, users) gives the scores of users for the items 0, 1, … of keys; state (a trained model, which fits one task) is
    broadcast.
    """
    spark = keys.sparkSession
    seen = seen.select("user_idx", "item_idx").dropna().distinct()
    held = held.select("user_idx", "item_idx").dropna().distinct().join(seen, ["user_idx", "item_idx"], "left_anti")
    table = keys.select("item_idx", F.col("tie_key").cast("string").alias("tie_key")).orderBy("item_idx").toArrow()
    shared = spark.sparkContext.broadcast((state, np.array(table.column("tie_key").to_pylist(), str)))
    rows = held.join(seen.groupBy("user_idx").agg(F.collect_list("item_idx").alias("seen")), "user_idx", "left").select("user_idx", "item_idx", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
    rows = rows.where((F.col("item_idx") >= 0) & (F.col("item_idx") < table.num_rows))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tie = shared.value
        idx = np.arange(len(tie))
        for whole in frames:
            for at in range(0, len(whole), users_per_block):
                f = whole.iloc[at : at + users_per_block]
                s, item = np.round(scores(own, f["user_idx"].to_numpy()), digits), f["item_idx"].to_numpy()
                h = s[np.arange(len(f)), item]
                _masked(s, idx, f["seen"].tolist())
                yield _ranked(f.assign(own_key=tie[item]), s, h, idx, tie, top)

    return _records(rows.mapInPandas(score, RECORD + _TOP), top)


def negative_pool(users: DataFrame, barred: DataFrame, n_items: int, n: int, seed: int = 42) -> DataFrame:
    """user_idx, draw, item_idx: n distinct items in [0, n_items) outside a user's barred ones; all of them if no more than n are free.

    The free items of a user are cut in n equal runs, and draw j takes one item of run j by the MD5 order of (seed, user, j): a
    stratified sample without replacement, the same in any engine and whatever the partitioning. The place among the free items
    becomes an item by counting the barred ones before it, in one sort per user, whose rows are its draws and barred items.
    """
    barred = barred.select("user_idx", "item_idx").dropna().distinct().where((F.col("item_idx") >= 0) & (F.col("item_idx") < n_items))
    every = users.select("user_idx").dropna().distinct()
    gap = F.col("item_idx") - F.row_number().over(Window.partitionBy("user_idx").orderBy("item_idx")) + 1
    free = every.join(barred.groupBy("user_idx").agg(F.count(F.lit(1)).alias("taken")), "user_idx", "left").select("user_idx", (F.lit(n_items) - F.coalesce("taken", F.lit(0))).alias("free")).where("free > 0")
    size = F.least(F.lit(n).cast("long"), F.col("free"))
    drawn = free.withColumn("size", size).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("draw"))
    low, high = F.floor(F.col("draw") * F.col("free") / F.col("size")), F.floor((F.col("draw") + 1) * F.col("free") / F.col("size"))
    drawn = drawn.select("user_idx", "draw", (low + whole_number(seed, F.col("user_idx"), F.col("draw")) % (high - low)).cast("long").alias("at"))
    return nth_free(drawn, barred.withColumn("at", gap))


def whole_number(seed: int, *columns: Column) -> Column:
    """A number below 2^60 from the MD5 text of seed and values."""
    return F.conv(F.substring(draw(seed, *columns), 1, 15), 16, 10).cast("long")


def nth_free(drawn: DataFrame, barred: DataFrame) -> DataFrame:
    """drawn with item_idx, the at-th item (from 0) that its user's barred ones leave free; barred has at, an item less the barred ones before it."""
    keys = [c for c in drawn.columns if c not in ("user_idx", "at")]
    rows = drawn.withColumn("is_barred", F.lit(0)).unionByName(barred.join(drawn.select("user_idx").distinct(), "user_idx", "left_semi").select("user_idx", "at", F.lit(1).alias("is_barred")), allowMissingColumns=True)
    before = F.sum("is_barred").over(Window.partitionBy("user_idx").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("item_idx", F.col("at") + before).where("is_barred = 0").select("user_idx", *keys, "item_idx")


def sampled_ranking(scores: DataFrame, seen: DataFrame, held: DataFrame, n_negatives: int = 100, seed: int = 42) -> DataFrame:
    """Rank of every held item among itself and n_negatives unseen items: user_idx, item_idx, rank, n_candidates, tie_block_size.

    scores (item_idx, score, tie_key) covers the items 0, 1, …; the pool of a user (negative_pool) leaves out its seen and held
    items. A held item that is seen too, or has no score, gives no row; if fewer items are free, all of them are the pool.
    """
    n_items = scores.count()
    seen = seen.select("user_idx", "item_idx").dropna().distinct()
    held = held.select("user_idx", "item_idx").dropna().distinct().join(seen, ["user_idx", "item_idx"], "left_anti")
    scored = _small(scores.select("item_idx", "score", "tie_key"))
    mine = held.join(scored, "item_idx")
    pool = negative_pool(held, seen.unionByName(held), n_items, n_negatives, seed).join(scored, "item_idx").select("user_idx", F.col("score").alias("s"), F.col("tie_key").alias("k"))
    ahead = (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("k") < F.col("tie_key")))
    return mine.join(pool, "user_idx", "left").groupBy("user_idx", "item_idx").agg(
        (F.count_if(ahead) + 1).alias("rank"), (F.count("s") + 1).alias("n_candidates"), (F.count_if(F.col("s") == F.col("score")) + 1).alias("tie_block_size")
    )


def user_negatives(train: DataFrame, n_items: int, seed: int = 42, epoch: int = 1) -> DataFrame:
    """user_idx, item_idx, negative_idx: every distinct train pair once with an item that the user lacks, for one epoch.

    The negative is drawn by its place among the free items, from the MD5 text of (seed, epoch, user, item); users who have every
    item are left out. Nothing is collected; a user's rows, at most the catalogue, are sorted once.
    """
    pairs = train.select("user_idx", "item_idx").dropna().distinct().where((F.col("item_idx") >= 0) & (F.col("item_idx") < n_items))
    own = Window.partitionBy("user_idx")
    pairs = pairs.withColumn("gap", F.col("item_idx") - F.row_number().over(own.orderBy("item_idx")) + 1).withColumn("free", F.lit(n_items) - F.count(F.lit(1)).over(own)).where("free > 0")
    place = (whole_number(seed, F.lit(epoch), F.col("user_idx"), F.col("item_idx")) % F.col("free")).cast("long")
    drawn = pairs.select("user_idx", F.col("item_idx").alias("positive"), place.alias("at"))
    return nth_free(drawn, pairs.withColumn("at", F.col("gap"))).select("user_idx", F.col("positive").alias("item_idx"), F.col("item_idx").alias("negative_idx"))
