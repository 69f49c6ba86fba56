"""Problem 2: per-key results and heavy keys."""

import datetime
from collections import Counter

from orrery.operators import skew

T0 = datetime.datetime(2024, 1, 1)


def _df(spark, rows):
    return spark.createDataFrame([(u, i, t, "x") for u, i, t in rows], "user_id string, item_id string, ts timestamp, n_rows string")


def test_profile_against_brute_force(spark):
    rows = [(f"u{j % 7}" if j % 11 else None, "hot" if j % 3 else (f"i{j % 5}" if j % 13 else None), T0 + datetime.timedelta(minutes=j) if j % 4 else None) for j in range(900)]
    rows += rows[:100]
    got = {(r["field"], r["key_value"]): r for r in skew.per_key_profile(_df(spark, rows), "item_id", "user_id", "ts").collect()}
    for field, key, other in (("item_id", 1, 0), ("user_id", 0, 1)):
        for k in {r[key] for r in rows} - {None}:
            own = [r for r in rows if r[key] == k]
            times = [r[2] for r in own if r[2]]
            r = got.pop((field, k))
            assert (r["n_rows"], r["n_distinct"]) == (len(own), len({x[other] for x in own} - {None}))
            assert (r["first_ts"], r["last_ts"]) == (min(times), max(times))
    assert not got


def test_a_heavy_key_covers_several_partitions(spark):
    from pyspark.sql import functions as F

    rows = [(f"u{j}", "hot" if j % 2 else f"i{j}", T0) for j in range(4000)]
    parts = skew.ranged_pairs(_df(spark, rows).repartition(6), "item_id", "user_id", "ts").repartitionByRange(8, "field", "key_value", "other")
    sizes = [r["n"] for r in parts.where("key_value = 'hot'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 2 and sum(sizes) == 2000 and max(sizes) < 1500


def _heavy(rows):
    out = set()
    for field, key in (("item_id", 1), ("user_id", 0)):
        counted = sorted(Counter(r[key] for r in rows if r[key] is not None).items(), key=lambda x: (-x[1], x[0]))
        total, held = sum(n for _, n in counted), 0
        for k, n in counted:
            if held * 2 >= total:
                break
            out.add((field, k))
            held += n
    return out


def test_heavy_keys(spark):
    for rows in ([(f"u{j % 9}", f"i{(j * j) % 17}", T0) for j in range(300)], [(f"u{j}", "one", T0) for j in range(10)], [(f"u{j % 4}", None, None) for j in range(8)]):
        got = skew.heavy_keys(skew.per_key_profile(_df(spark, rows), "item_id", "user_id", "ts"))
        assert {tuple(r) for r in got.collect()} == _heavy(rows)


def test_empty(spark):
    profile = skew.per_key_profile(_df(spark, []), "item_id", "user_id", "ts")
    assert profile.count() == 0
    assert skew.heavy_keys(profile).count() == 0


def test_ranked_within(spark):
    rows = [("a", j % 5, j) for j in range(50)] + [("b", 0, j) for j in range(7)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, o long, t long")
    got = sorted((r["g"] or "", r["o"], r["t"], r["rank"]) for r in skew.ranked_within(df.where("g is not null"), "g", ["o", "t"], "test").collect())
    want = sorted((g, o, t, i) for g in "ab" for i, (o, t) in enumerate(sorted((o, t) for x, o, t in rows if x == g), 1))
    assert got == want
    every = skew.ranked_within(df, None, ["o", "t", "g"], "test-all").collect()
    assert sorted(r["rank"] for r in every) == list(range(1, len(rows) + 1))
