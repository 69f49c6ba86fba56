"""Per-key results where a few keys hold most rows, and the keys that do."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.staging import stage


def per_key_profile(df: DataFrame, first: str, second: str, ts: str) -> DataFrame:
    """Rows, distinct partners and first and last time of every value of two columns.

    Columns field, key_value, n_rows, n_distinct, first_ts, last_ts. Equal (first, second) rows are
    combined before the shuffle. The combined rows are then range-partitioned on (field, key, partner),
    whose bounds Spark takes from sampled quantiles, so that a heavy key covers several partitions; every
    partition yields one partial state per key it touches, and the states of a key cut by a
    boundary are stitched together. Combined rows are distinct per (key, partner), so partner counts add up
    exactly across a cut.

    A null key is no key; a null partner counts as a row but not as a partner; null times are
    skipped (both null if a key has no other). Repeated rows count each. An empty table gives no row.
    """
    ranged = ranged_pairs(df, first, second, ts)
    return ranged.groupBy("field", "key_value").agg(F.sum("n").alias("n_rows"), F.count("other").alias("n_distinct"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))


def ranged_pairs(df: DataFrame, first: str, second: str, ts: str) -> DataFrame:
    """field, key_value, other, n, lo, hi: every pair of values once from both sides, range-partitioned on (field, key_value, other)."""
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    side = lambda key, other: F.struct(F.lit(key).alias("field"), F.col(key).cast("string").alias("key_value"), F.col(other).cast("string").alias("other"))
    sides = pairs.select(F.explode(F.array(side(first, second), side(second, first))).alias("s"), "n", "lo", "hi").select("s.*", "n", "lo", "hi").where("key_value is not null")
    return sides.repartitionByRange("field", "key_value", "other")


def ranked_within(df: DataFrame, group: str | None, order: list[str], label: str, rank: str = "rank") -> DataFrame:
    """1, 2, 3, … per group (None: over all rows) by order, with no group held by one task.

    Rows are range-partitioned, sorted and staged; a row's rank is its place in its partition plus the rows of its
    group in the partitions before. Over all rows that is one number per partition, which becomes a literal, so the
    result is a plain scan; per group the numbers are a small table that is joined.
    """
    keys = ([group] if group else []) + order
    placed = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rw_mid", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_rw_mid", 33), F.col("_rw_mid").bitwiseAND(F.lit((1 << 33) - 1))
    if group is None:
        sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()}
        before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]
        start = F.array(*(F.lit(n).cast("long") for n in before))[part.cast("int")]
        return placed.withColumn(rank, place + start + 1).drop("_rw_mid")
    placed = placed.withColumn("_rw_part", part)
    parts = placed.groupBy(group, "_rw_part").agg(F.count(F.lit(1)).alias("_rw_n"), F.min("_rw_mid").alias("_rw_first"))
    before = F.coalesce(F.sum("_rw_n").over(Window.partitionBy(group).orderBy("_rw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_rw_part", "_rw_first", before.alias("_rw_before"))
    return placed.join(parts, [group, "_rw_part"]).withColumn(rank, F.col("_rw_mid") - F.col("_rw_first") + F.col("_rw_before") + 1).drop("_rw_mid", "_rw_part", "_rw_first", "_rw_before")


def heavy_keys(profile: DataFrame, share: float = 0.5) -> DataFrame:
    """The smallest set of most frequent keys that hold at least the share of their field's rows.

    Columns field, key_value. Of keys equally frequent at the cut the first by value are taken. The cut is
    found on the histogram of frequencies, which has at most sqrt(2 * rows) entries, not on the keys.
    """
    states = stage(profile.select("field", "key_value", "n_rows"), "key-states")
    hist = states.groupBy("field", "n_rows").agg(F.count(F.lit(1)).alias("keys"))
    w = Window.partitionBy("field")
    held = F.col("n_rows") * F.col("keys")
    hist = hist.withColumn("goal", F.sum(held).over(w) * F.lit(share)).withColumn("upto", F.sum(held).over(w.orderBy(F.desc("n_rows")).rowsBetween(Window.unboundedPreceding, 0)))
    cut = hist.where("upto >= goal").groupBy("field").agg(F.max("n_rows").alias("cut"), F.max_by(F.struct("goal", "upto", "keys"), "n_rows").alias("at"))
    cut = cut.select("field", "cut", F.ceil((F.col("at.goal") - F.col("at.upto")) / F.col("cut") + F.col("at.keys")).alias("wanted"))
    marked = states.join(cut, "field")
    tied = ranked_within(marked.where("n_rows = cut"), "field", ["key_value"], "tied-keys").where("rank <= wanted")
    return marked.where("n_rows > cut").select("field", "key_value").unionByName(tied.select("field", "key_value"))
