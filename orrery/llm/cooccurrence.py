"""Items that appear together: sorted runs of packed pair codes, merged and run-length counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import estimated_bytes
from orrery.staging import numbered, stage


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes → each code once with its number."""
    heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[heads], np.diff(np.r_[heads, len(codes)]) if counts is None else np.add.reduceat(counts, heads)


def _pair_codes(left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Packed codes (smaller << 32 | larger) of one block; right None: pairs within left."""
    if right is None:
        left = np.sort(left)
        i, j = np.triu_indices(len(left), 1)
        return (left[i] << 32) | left[j]
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    return (np.minimum(a, b) << 32) | np.maximum(a, b)


def _same_size_codes(block: np.ndarray) -> np.ndarray:
    """Codes of many baskets of one size at once; block is baskets × size, each row sorted."""
    i, j = np.triu_indices(block.shape[1], 1)
    return ((block[:, i] << 32) | block[:, j]).ravel()


def _sorted_runs(batches: Iterator[pa.RecordBatch], hold: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Baskets (left, right) → sorted runs of (code, n), one run per hold codes; Spark spills and merges them."""
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        codes, n = _runs(np.sort(np.concatenate(parts)))
        for at in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["code", "n"])

    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        values, offsets = np.asarray(left.values).astype(np.int64), np.asarray(left.offsets).astype(np.int64)
        sizes, two = np.diff(offsets), np.asarray(right.value_lengths().fill_null(0)) > 0
        for size in np.unique(sizes[~two]):
            rows = np.flatnonzero((sizes == size) & ~two)
            step = max(1, int(4 * hold // max(1, size * size)))
            for at in range(0, len(rows) if size > 1 else 0, step):
                block = np.sort(values[offsets[rows[at : at + step], None] + np.arange(size)], axis=1)
                parts.append(_same_size_codes(block))
                held += len(parts[-1])
                if held >= hold:
                    yield from flush()
                    parts, held = [], 0
        for row in np.flatnonzero(two):
            parts.append(_pair_codes(values[offsets[row] : offsets[row + 1]], np.asarray(right[int(row)].values).astype(np.int64)))
            held += len(parts[-1])
            if held >= hold:
                yield from flush()
                parts, held = [], 0
    if held:
        yield from flush()


def _run_lengths(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merged runs sorted by code → code, n with n >= least; the open run is carried on."""
        code, total = None, 0

        def out(codes, n):
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(codes[keep]), pa.array(n[keep])], ["code", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, n = _runs(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            if codes[0] == code:
                n[0] += total
            elif code is not None:
                yield out(np.array([code]), np.array([total]))
            yield out(codes[:-1], n[:-1])
            code, total = codes[-1], n[-1]
        if code is not None:
            yield out(np.array([code]), np.array([total]))

    return count


def item_pairs(df: DataFrame, basket: str, item: str, least: int = 8, least_lift: float | None = None, chunk: int = 1000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Shared baskets of item pairs: item_a < item_b, n_a, n_b, n_ab, lift, odds_ratio, for n_ab >= least.

    A basket is the set of distinct non-null items of one non-null basket id. Two exact prunings come first:
    an item in fewer than least baskets is in no result, and, with least_lift, nor is one in more than
    N / least_lift baskets, as n_ab <= min(n_a, n_b). The other items get 31-bit numbers; a pair is one
    64-bit code. Every task sorts its codes in runs of bounded size and counts equal ones; Spark's sort shuffle
    spills the runs and merges them per hash range; the merged runs are run-length counted.

    A basket of more than chunk items is cut in chunks, and each pair of chunks is its own row of work, so that
    no task holds all pairs of a basket. The odds ratio has 0.5 added to each cell (Haldane-Anscombe).
    Repeated rows count once; an empty table gives no row.
    """
    pairs = stage(df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct(), "basket-items")
    baskets = pairs.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    total = baskets.count()
    kept = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= least)
    if least_lift is not None:
        kept = kept.where(F.col("n_item") * F.lit(float(least_lift)) <= total)
    items = numbered(kept, "pair-items")
    small = lambda d: F.broadcast(d) if estimated_bytes(d) <= broadcast_bytes else d
    rows = pairs.join(small(items.select("item", F.col("code").cast("int").alias("code"))), "item").select("basket", "code")
    wide = stage(baskets.where(F.col("size") > chunk).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).select("basket", "chunks"), "wide-baskets")
    narrow = rows.join(wide, "basket", "left_anti").groupBy("basket").agg(F.collect_list("code").alias("a")).select("a", F.expr("cast(null as array<int>)").alias("b"))
    at = rows.join(wide, "basket").withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")).select("basket", "code", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    blocks = at.groupBy("basket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("code"))).alias("a"), F.collect_list(F.when(F.col("own") > F.col("other"), F.col("code"))).alias("b")
    )
    blocks = blocks.where((F.col("i") == F.col("j")) | ((F.size("a") > 0) & (F.size("b") > 0))).select("a", "b")
    runs = narrow.unionByName(blocks).mapInArrow(_sorted_runs, "code long, n long")
    counted = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths(least), "code long, n long")
    side = lambda s: small(items.select(F.col("code").alias(f"c_{s}"), F.col("item").alias(f"i_{s}"), F.col("n_item").alias(f"n_{s}")))
    out = counted.select(F.shiftright("code", 32).alias("c_x"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("c_y"), F.col("n").alias("n_ab")).join(side("x"), "c_x").join(side("y"), "c_y")
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_x") * F.col("n_y"))
    if least_lift is not None:
        out = out.where(F.col("n_ab") * F.lit(total) >= F.col("n_x") * F.col("n_y") * F.lit(least_lift))
    half, first = F.lit(0.5), F.col("i_x") < F.col("i_y")
    neither = F.lit(total) - F.col("n_x") - F.col("n_y") + F.col("n_ab")
    odds = (F.col("n_ab") + half) * (neither + half) / ((F.col("n_x") - F.col("n_ab") + half) * (F.col("n_y") - F.col("n_ab") + half))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return out.select(pick("i_x", "i_y").alias("item_a"), pick("i_y", "i_x").alias("item_b"), pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "n_ab", lift.alias("lift"), odds.alias("odds_ratio"))
