"""Same or near-same profiles across splits: a weighted cosine join on inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.skew import ranked_within
from orrery.staging import stage

SPREAD = 2.0  # squared term weights lie in [1, SPREAD]
_POST = "term long, unit long, side boolean, key long, size long, reach double, least double, total double, terms array<long>, weights array<float>"
_KNOWN = ("left", "right", "least_left", "least_right", "most_left", "most_right")


def term_sets(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """split (null for train), user_idx, source, terms (sorted, distinct), n, and shared: how many of them the user has in train.

    Rows with a null user or item are left out, heldout rows with a null split too; the source is the least of the
    profile's rows. Repeated rows are combined before the one shuffle, which is on the user; a profile is at most as
    long as the catalogue.
    """
    t = train.where("user_idx is not null and item_idx is not null").select(F.lit(None).cast("string").alias("split"), "user_idx", "item_idx", F.lit(None).cast("string").alias("source"))
    h = heldout.where("split is not null and user_idx is not null and item_idx is not null").select("split", "user_idx", "item_idx", F.col("source").cast("string").alias("source"))
    users = t.unionByName(h).groupBy("user_idx").agg(F.collect_set(F.struct("split", "item_idx")).alias("rows"), F.collect_set(F.struct("split", "source")).alias("sources"))
    own = lambda split: F.array_sort(F.transform(F.filter("rows", lambda r: r.split.eqNullSafe(split)), lambda r: r.item_idx))
    parts = users.withColumn("in_train", own(F.lit(None).cast("string"))).withColumn("split", F.explode(F.array_distinct(F.transform("rows", lambda r: r.split))))
    source = F.array_min(F.transform(F.filter("sources", lambda s: s.split.eqNullSafe(F.col("split"))), lambda s: s.source))
    parts = parts.select("split", "user_idx", source.alias("source"), own(F.col("split")).alias("terms"), "in_train")
    shared = F.when(F.col("split").isNull(), 0).otherwise(F.size(F.array_intersect("terms", "in_train")))
    return parts.select("split", "user_idx", "source", "terms", F.size("terms").cast("long").alias("n"), shared.cast("long").alias("shared"))


@dataclass
class Terms:
    """What the join knows of terms: profiles with it per side (0: none), and the least and largest size of such a profile."""

    left: np.ndarray
    right: np.ndarray
    least_left: np.ndarray
    least_right: np.ndarray
    most_left: np.ndarray
    most_right: np.ndarray

    def take(self, at: np.ndarray) -> Terms:
        """The entries at places."""
        return Terms(*(getattr(self, c)[at] for c in _KNOWN))


@dataclass
class Dictionary:
    """The terms that both sides hold, sorted, with their entries; the last entry stands for all other terms."""

    term: np.ndarray
    entries: Terms

    def of(self, flat: np.ndarray) -> Terms:
        """The entries of any terms."""
        at = np.minimum(np.searchsorted(self.term, flat), max(0, len(self.term) - 1))
        return self.entries.take(np.where(self.term[at] == flat, at, len(self.term)) if len(self.term) else np.zeros(len(flat), np.int64))


def squared_weights(n: int, df: np.ndarray) -> np.ndarray:
    """Squared weight of terms that df of n sets hold: 1 for one that all hold, up to SPREAD for the rarest."""
    return 1 + (SPREAD - 1) * np.log(n / np.maximum(df, 1)) / np.log(max(n, 2))


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in its row) of every element of rows of the given lengths."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def least_cosines(upto: np.ndarray, starts: np.ndarray, sizes: np.ndarray, jaccard: float) -> np.ndarray:
    """The least weighted cosine that a set can have with any set of Jaccard similarity >= jaccard.

    upto holds the running sums of squared weights of every set, its terms from light to heavy. A similar set lacks a of
    the n terms, at worst the heaviest, and adds at most b = floor((n - a) / jaccard) - n terms of squared weight
    SPREAD; the least over all a bounds every case.
    """
    rows, a = _runs(np.floor(sizes * (1 - jaccard) + 1e-9).astype(np.int64) + 1)
    n = sizes[rows]
    b = np.floor((n - a) / jaccard + 1e-9) - n
    rest, whole = upto[starts[rows] + n - a - 1], upto[starts[rows] + n - 1]
    out = np.full(len(sizes), 1.0)
    np.minimum.at(out, rows, rest / np.sqrt(whole * (rest + SPREAD * b)))
    return out


def _post(n_sets: int, jaccard: float, shared, list_rows: int, carry: int):
    """Sets (terms, l, r, key[, known]) → entries of the inverted lists; known holds the terms' entries where they aren't broadcast."""

    def entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(0)
        sizes, flat = np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(lists.flatten()).astype(np.int64)
        if not len(flat):
            return
        t = shared.value.of(flat) if shared is not None else Terms(*(np.asarray(c).astype(np.int64) for c in batch.column(4).flatten().flatten()))
        w2 = squared_weights(n_sets, t.left + t.right)
        rows, _ = _runs(sizes)
        order = np.lexsort((flat, w2, rows))  # from frequent to rare
        flat, w2, t = flat[order], w2[order], t.take(order)
        starts, running = np.cumsum(sizes) - sizes, np.cumsum(w2)
        upto = running - np.repeat(running[starts] - w2[starts], sizes)
        total = upto[starts + sizes - 1]
        least, reach, weights, n = least_cosines(upto, starts, sizes, jaccard), np.sqrt(upto / total[rows]), np.sqrt(w2).astype(np.float32), sizes[rows]
        key, salt = np.asarray(batch.column(3)), np.abs(np.asarray(batch.column(3)) >> 7)
        for side, flag, mine, others, smallest, largest in ((True, batch.column(1), t.left, t.right, t.least_right, t.most_right), (False, batch.column(2), t.right, t.left, t.least_left, t.most_left)):
            # a similar set has at least jaccard times as many terms; the weight of a term on the other side is at most that in its smallest set
            fewest = np.ceil(jaccard * n - 1e-9)
            able = (others > 0) & (largest >= fewest) & (jaccard * smallest <= n + 1e-9)
            top = np.where(able, w2 / np.sqrt(total[rows] * np.maximum(smallest, fewest)), 0.0)
            summed = np.cumsum(top)
            bound = np.minimum(reach, summed - np.repeat(summed[starts] - top[starts], sizes))
            keep = np.flatnonzero(able & (bound >= least[rows] - 1e-6) & np.asarray(flag).astype(bool)[rows])
            # a term with many sets is a grid of list chunks: an entry goes to one chunk of its side, against all of the other
            chunks, grid = np.maximum(1, -(-mine[keep] // list_rows)), np.maximum(1, -(-others[keep] // list_rows))
            again, copy = _runs(grid)
            at, own = keep[again], (salt[rows[keep]] % chunks)[again]
            unit = own * grid[again] + copy if side else copy * chunks[again] + own
            for lo in range(0, len(at), 20_000):
                s = at[lo : lo + 20_000]
                r = rows[s]
                inner, place = _runs(np.where(sizes[r] <= carry, sizes[r], 0))
                offsets = pa.array(np.r_[0, np.cumsum(np.where(sizes[r] <= carry, sizes[r], 0))].astype(np.int32))
                take = starts[r][inner] + place
                columns = [flat[s], unit[lo : lo + 20_000], np.full(len(s), side), key[r], sizes[r], reach[s], least[r], total[r]]
                whole = [pa.ListArray.from_arrays(offsets, pa.array(v[take])) for v in (flat, weights)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *whole], [c.split()[0] for c in _POST.split(", ")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from entries(batch)

    return post


class _Lists:
    """Whole units of inverted lists, and the sets in them that are similar."""

    def __init__(self, table: pa.Table, jaccard: float) -> None:
        table = table.combine_chunks()
        column = lambda name: np.asarray(table.column(name).chunk(0))
        self.jaccard = jaccard
        self.term, unit, self.side, self.key, self.size = (column(c) for c in ("term", "unit", "side", "key", "size"))
        self.reach, self.least, self.total = (column(c) for c in ("reach", "least", "total"))
        self.group = np.cumsum(np.r_[False, (self.term[1:] != self.term[:-1]) | (unit[1:] != unit[:-1])])
        terms, weights = table.column("terms").chunk(0), table.column("weights").chunk(0)
        self.flat, self.weights = np.asarray(terms.flatten()), np.asarray(weights.flatten())
        self.length = np.asarray(terms.value_lengths()).astype(np.int64)
        self.first = np.cumsum(self.length) - self.length

    def meetings(self, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left, right) rows of one unit whose sizes and residual norms allow similarity, in bounded blocks."""
        b = np.flatnonzero(~self.side)
        b = b[np.lexsort((self.size[b], self.group[b]))]
        wide = int(self.size.max()) * 4 + 4
        code, a = self.group[b] * wide + self.size[b], np.flatnonzero(self.side)
        lo = np.searchsorted(code, self.group[a] * wide + np.ceil(self.jaccard * self.size[a] - 1e-9).astype(np.int64))
        hi = np.searchsorted(code, self.group[a] * wide + np.floor(self.size[a] / self.jaccard + 1e-9).astype(np.int64), side="right")
        n = np.maximum(hi - lo, 0)
        upto, begin = np.cumsum(n), 0
        while begin < len(a):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + cells, side="right")))  # a row alone meets one unit, which is bounded
            i, place = _runs(n[begin:end])
            left, right = a[begin:end][i], b[lo[begin:end][i] + place]
            near = self.reach[left] * self.reach[right] >= np.maximum(self.least[left], self.least[right]) - 1e-6
            yield left[near], right[near]
            begin = end

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the meetings are similar sets whose rarest common term is that of the meeting; true where a set is not carried."""
        carried = (self.length[a] > 0) & (self.length[b] > 0)
        out, (a, b) = ~carried, (a[carried], b[carried])
        if not len(a):
            return out
        (rows, place), (other, step) = _runs(self.length[a]), _runs(self.length[b])
        mine, theirs = self.first[a][rows] + place, self.first[b][other] + step
        values, codes = np.unique(np.r_[self.flat[mine], self.flat[theirs]], return_inverse=True)
        left, right = rows * len(values) + codes[: len(rows)], np.sort(other * len(values) + codes[len(rows) :])
        both = right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left
        shared = np.bincount(rows, both, len(a))
        dot = np.bincount(rows, both * self.weights[mine].astype(float) ** 2, len(a)) / np.sqrt(self.total[a] * self.total[b])
        rarest = np.zeros(len(a), np.int64)
        np.maximum.at(rarest, rows[both], place[both])
        here = self.flat[self.first[a] + rarest] == self.term[a]
        fine = here & (dot >= np.maximum(self.least[a], self.least[b]) - 1e-5) & (shared >= self.jaccard * (self.size[a] + self.size[b] - shared) - 1e-9)
        out[carried] = fine
        return out


def _meet(jaccard: float, cells: int = 500_000):
    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = _Lists(table, jaccard)
        for a, b in lists.meetings(cells):
            good = lists.similar(a, b)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(lists.key[a[good]]), pa.array(lists.key[b[good]])], ["key_a", "key_b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries sorted by (term, unit) → keys of similar sets; one unit and one batch are held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            term, unit = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(term):
                continue
            last = int(np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (unit[1:] != unit[:-1])])[-1])
            if held and (last or (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(term[0]), int(unit[0]))):
                yield from found(pa.Table.from_batches([*held, batch.slice(0, last)] if last else held))
                held = []
            elif last:
                yield from found(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from found(pa.Table.from_batches(held))

    return meet


def similar_sets(profiles: DataFrame, jaccard: float, broadcast_bytes: int = 64 << 20, list_rows: int = 8192, carry: int = 1024) -> DataFrame:
    """key_a, key_b (hashes of terms) of all train (split null) and heldout sets of profiles with Jaccard similarity >= jaccard.

    A cosine join on vectors of term weights: the squared weight of a term lies between 1 and SPREAD and rises with its
    inverse document frequency over all profiles. Whatever the other set is, Jaccard similarity implies a least weighted
    cosine for every set (least_cosines). Each vector's terms go from frequent to rare; while the dot product of the
    terms so far with any similar set is bounded below that cosine, by their norm or by the largest weights on the other
    side, they aren't indexed. The inverted lists of the two sides meet on the term; a meeting is kept only if the sizes and
    the residual norms up to that term allow it. The exact dot product and the exact Jaccard similarity follow, and a
    pair counts in its rarest common term only. No pair is lost; nothing is capped.

    Equal sets are one set. A term with more than list_rows sets on a side is a grid of list chunks. Entries carry their
    set up to carry terms; longer sets meet by key only, and the caller checks the sets themselves, as for all pairs (which
    also settles equal hashes). The terms' entries are broadcast up to broadcast_bytes and joined to the sets beyond.
    Empty inputs give no pair; ties at the threshold are kept.
    """
    spark = profiles.sparkSession
    left = F.col("split").isNull()
    each = profiles.select(left.alias("is_left"), "n", F.explode(F.concat(F.array(F.lit(None).cast("long")), "terms")).alias("term"))
    size = lambda f, side: F.coalesce(f(F.when(side, F.col("n"))), F.lit(0))
    mine, other = F.col("is_left"), ~F.col("is_left")
    counted = each.groupBy("term").agg(
        F.count_if(mine).alias("left"), F.count_if(other).alias("right"), size(F.min, mine).alias("least_left"), size(F.min, other).alias("least_right"), size(F.max, mine).alias("most_left"), size(F.max, other).alias("most_right")
    )  # the null term counts the profiles
    known = stage(counted.where("term is null or (`left` > 0 and `right` > 0)"), "terms")
    sets = profiles.groupBy("terms").agg(F.max(left).alias("l"), F.max(~left).alias("r")).select("terms", "l", "r", F.xxhash64("terms").alias("key"))
    if known.count() * 32 <= broadcast_bytes:
        table = known.toArrow()
        column = lambda name: np.asarray(table.column(name))
        whole = np.asarray(table.column("term").is_null())
        n_sets = int((column("left")[whole] + column("right")[whole]).sum())
        term = np.asarray(table.column("term").fill_null(0))[~whole]
        order = np.argsort(term)
        shared = spark.sparkContext.broadcast(Dictionary(term[order], Terms(*(np.r_[column(c)[~whole][order], 0].astype(np.int32) for c in _KNOWN))))
    else:
        n_sets, shared = known.where("term is null").agg(F.sum(F.col("left") + F.col("right"))).first()[0] or 0, None
        rows = sets.select("terms", "l", "r", "key", F.explode("terms").alias("term")).join(known, "term", "left")
        entry = F.struct("term", F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in _KNOWN)).alias("known"))
        rows = rows.groupBy("key", "terms", "l", "r").agg(F.array_sort(F.collect_list(entry)).alias("all"))
        sets = rows.select("terms", "l", "r", "key", F.transform("all", lambda e: e.known).alias("known"))
    entries = sets.mapInArrow(_post(n_sets, jaccard, shared, list_rows, carry), _POST)
    met = entries.repartition("term", "unit").sortWithinPartitions("term", "unit").mapInArrow(_meet(jaccard), "key_a long, key_b long")
    return met.distinct()


def split_overlaps(train: DataFrame, heldout: DataFrame, least_items: int = 6, least_jaccard: float = 0.7) -> DataFrame:
    """split, source, train_user_idx, user_idx, kind, shared of the heldout profiles that stand in train too.

    kind same: the user is in train with at least one common item. kind near: another train user (of a lesser
    number) whose profile has Jaccard similarity >= least_jaccard, both with at least least_items items. The profiles
    are staged when the DataFrame is built.
    """
    profiles, same = _profiles(train, heldout)
    big = profiles.where(F.col("n") >= least_items)
    links = similar_sets(big, least_jaccard)
    near = links.join(_members(big, "a"), "key_a").join(_members(big, "b"), "key_b").where("train_user_idx < user_idx")
    near = _similar(near, least_jaccard)
    return same.unionByName(near.select("split", "source", "train_user_idx", "user_idx", F.lit("near").alias("kind"), "shared"))


def _profiles(train: DataFrame, heldout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged profiles, and the cases of users who stand on both sides."""
    profiles = stage(term_sets(train, heldout), "profiles")
    same = profiles.where("shared > 0").select("split", "source", F.col("user_idx").alias("train_user_idx"), "user_idx", F.lit("same").alias("kind"), "shared")
    return profiles, same


def _members(big: DataFrame, side: str) -> DataFrame:
    """Key, terms and user of the profiles of one side; side b has split and source too."""
    own = big.where("split is null" if side == "a" else "split is not null")
    return own.select(F.xxhash64("terms").alias(f"key_{side}"), F.col("terms").alias(f"terms_{side}"), *([F.col("user_idx").alias("train_user_idx")] if side == "a" else ["split", "source", "user_idx"]))


def _similar(pairs: DataFrame, jaccard: float) -> DataFrame:
    """pairs (terms_a, terms_b) whose sets are similar, with shared: the exact check."""
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("terms_a", "terms_b")).cast("long"))
    return pairs.where(F.col("shared") >= F.lit(jaccard) * (F.size("terms_a") + F.size("terms_b") - F.col("shared")) - F.lit(1e-9))


def overlap_report(train: DataFrame, heldout: DataFrame, least_items: int = 6, least_jaccard: float = 0.7) -> DataFrame:
    """Cases, heldout users and train users per split, source and kind of split_overlaps, counted without making the cases.

    Two groups of copies that are similar are one link, whatever their sizes. A heldout user has a case if some train
    user of a linked set has a lesser number, and as many as there are such users; both follow from extremes and ranks within the link
    (ranked_within holds no group in one task). Links are in proportion to the distinct sets that are similar. The jobs
    of the profiles, links and ranks run when the DataFrame is built.
    """
    profiles, same = _profiles(train, heldout)
    big = profiles.where(F.col("n") >= least_items)
    sets = lambda side: _members(big, side).select(f"key_{side}", f"terms_{side}").distinct()
    links = _similar(similar_sets(big, least_jaccard).join(sets("a"), "key_a").join(sets("b"), "key_b"), least_jaccard)
    links = stage(links.withColumn("link", F.monotonically_increasing_id()).select("link", "key_a", "terms_a", "key_b", "terms_b"), "links")
    a = stage(links.select("link", "key_a", "terms_a").join(_members(big, "a"), ["key_a", "terms_a"]).select("link", F.col("train_user_idx").alias("user")), "link-train")
    b = stage(links.select("link", "key_b", "terms_b").join(_members(big, "b"), ["key_b", "terms_b"]).select("link", "split", "source", F.col("user_idx").alias("user")), "link-heldout")
    group = ["split", "source"]
    least, most = a.groupBy("link").agg(F.min("user").alias("least")), b.groupBy("link", *group).agg(F.max("user").alias("most"))
    users = b.join(least, "link").where("user > least").groupBy(*group).agg(F.countDistinct("user").alias("n_users"))
    train_users = a.join(most, "link").where("user < most").groupBy(*group).agg(F.countDistinct("user").alias("n_train_users"))
    # place among both sides less place among the heldout side: train users with a lesser number; heldout rows go first among equals
    both = b.withColumn("side", F.lit(0)).unionByName(a.withColumn("side", F.lit(1)), allowMissingColumns=True)
    order = ["user", "side", "split", "source"]
    places = ranked_within(both, "link", order, "places").where("side = 0").groupBy(*group).agg(F.sum("rank").alias("among_both"))
    own = ranked_within(b.withColumn("side", F.lit(0)), "link", order, "own-places").groupBy(*group).agg(F.sum("rank").alias("among_own"))
    match = lambda x, y: x.join(y.select(*(F.col(g).alias(f"_{g}") for g in group), *(c for c in y.columns if c not in group)), F.col("split").eqNullSafe(F.col("_split")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_split", "_source")
    near = match(match(match(places, own), users), train_users)
    near = near.select(*group, F.lit("near").alias("kind"), (F.col("among_both") - F.col("among_own")).alias("n_cases"), "n_users", "n_train_users")
    counted = same.groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("user_idx").alias("n_users"), F.countDistinct("train_user_idx").alias("n_train_users"))
    return counted.unionByName(near)
