"""Statistics against hand-worked or brute-force values."""

import itertools
import math

import numpy as np
import pytest

from orrery.operators import reports
from orrery.operators import statistics as st


def _diffs(spark, a, b):
    return spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "g string, user_id long, a double, b double")


def test_wilcoxon_hand_case(spark):
    # d = (0, 0, 1, -1, 2, 3): mean 9, variance 21.375, rank sums 14.5 and 3.5
    r = st.wilcoxon(_diffs(spark, [0, 0, 1, 0, 2, 3], [0, 0, 0, 1, 0, 0]), ["g"]).first()
    assert (r["n_pairs"], r["n_nonzero"], r["statistic"]) == (6, 4, 3.5)
    assert r["z"] == pytest.approx(abs(3.5 - 9) / math.sqrt(21.375))


def test_wilcoxon_variance_is_the_exact_null_variance(spark):
    d = [0, 1, 1, -2, 3, 3, -3]
    r = st.wilcoxon(_diffs(spark, d, [0] * 7), ["g"]).first()
    size = np.abs(d)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])[size > 0]
    sums = [sum(x for x, s in zip(rank, signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    t = min(sum(rank[np.array(d)[size > 0] > 0]), sum(rank[np.array(d)[size > 0] < 0]))
    assert r["z"] == pytest.approx(abs(t - np.mean(sums)) / np.std(sums))


def test_all_zero(spark):
    r = st.wilcoxon(_diffs(spark, [1, 2], [1, 2]), ["g"]).withColumn("p", st.normal_two_sided("z")).first()
    assert (r["statistic"], r["z"], r["p"]) == (0, None, 1.0)


def test_chi2():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert st.chi2_survival(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert st.chi2_survival(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert st.chi2_survival(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)


def test_friedman(spark):
    values = {0: (1, 2, 3), 1: (2, 1, 3), 2: (1, 1, 2), 3: (3, 2, 1)}
    rows = [("d", u, f"c{j}", float(v)) for u, vs in values.items() for j, v in enumerate(vs)] + [("d", 9, "c0", 1.0), ("two", 1, "c0", 1.0), ("two", 1, "c1", 2.0)]
    got = {r["dataset"]: r for r in st.friedman(spark.createDataFrame(rows, "dataset string, user_id long, config string, value double"), ["dataset"]).collect()}
    ranks = np.array([[1, 2, 3], [2, 1, 3], [1.5, 1.5, 3], [3, 2, 1]])
    q = (12 / (4 * 3 * 4) * (ranks.sum(0) ** 2).sum() - 3 * 4 * 4) / (1 - 6 / (4 * 3 * 8))
    assert got["d"]["statistic"] == pytest.approx(q) and got["d"]["n_users"] == 4
    assert got["d"]["p_value"] == pytest.approx(math.exp(-q / 2))
    assert got["two"]["statistic"] is None and got["two"]["p_value"] is None


def test_corrections(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005}
    df = spark.createDataFrame([("f", k, v) for k, v in p.items()], "fam string, config_a string, p_value double")
    holm = {r["config_a"]: r["p_corrected"] for r in st.corrected(df, ["fam"], ["config_a"]).collect()}
    assert holm == pytest.approx({"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06})
    bonf = {r["config_a"]: (r["p_corrected"], r["significant"]) for r in st.corrected(df, ["fam"], ["config_a"], "bonferroni").collect()}
    assert bonf["d"] == (0.02, True) and bonf["b"] == (0.16, False)
    with pytest.raises(ValueError):
        st.corrected(df, ["fam"], ["config_a"], "other")


def test_cliffs_delta_and_cohens_d(spark):
    a, b = [1, 2, 2, 5], [2, 2, 0, 1]
    d = _diffs(spark, a, b)
    want = sum((x > y) - (x < y) for x in a for y in b) / 16
    r = st.cliffs_delta(d, ["g"]).first()
    assert r["cliffs_delta"] == pytest.approx(want) and r["magnitude"] == "medium"
    e = np.subtract(a, b)
    assert st.cohens_d(d, ["g"]).first()["cohens_d"] == pytest.approx(e.mean() / e.std(ddof=1))
    assert st.cohens_d(_diffs(spark, [1, 2], [0, 1]), ["g"]).first()["cohens_d"] == 0


def test_bootstrap(spark):
    v = np.random.default_rng(0).normal(3, 2, 400).round(1)
    r = st.bootstrap_mean(_diffs(spark, v, v), ["g"], st.F.col("a"), 2000).first()
    half = 1.96 * v.std() / 20
    assert r["mean"] == pytest.approx(v.mean()) and r["ci_lower"] == pytest.approx(v.mean() - half, abs=0.05) and r["ci_upper"] == pytest.approx(v.mean() + half, abs=0.05)


def test_families(spark):
    cells = spark.createDataFrame([(m, e) for m in ("vbpr", "acf") for e in ("resnet50_D64", "resnet50_finetuned_D64", "clip_D64", "hybrid_mean_D64", "hybrid_sum_D64")] + [("bpr", "none")], "model string, embedding_name string")
    rows = [tuple(r) for r in st.families(cells, st.FAMILIES).collect()]
    count = lambda f: sum(r[0] == f for r in rows)
    assert (count("backbone_within_model"), count("model_within_backbone"), count("fusion_within_model"), count("frozen_vs_finetuned"), count("all_pairs")) == (2, 3, 2, 2, 55)
    assert ("frozen_vs_finetuned", "vbpr", "resnet50_D64", None, "vbpr_resnet50_D64", "vbpr_resnet50_finetuned_D64") in rows
    assert {r[1:4] for r in rows if r[0] == "model_within_backbone"} == {(None, "resnet50_D64", "frozen"), (None, "resnet50_D64", "finetuned"), (None, "clip_D64", "frozen")}
    with pytest.raises(ValueError):
        st.families(cells, ("nonsense",))


def test_class_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "y int, p int")
    m = reports.confusion(df, "y", "p")
    assert m.count() == 9
    r = {x["label"]: x for x in reports.class_report(m).collect()}
    assert r[1]["precision"] == pytest.approx(1 / 3) and r[1]["recall"] == 1 and r[2]["recall"] == pytest.approx(2 / 3)


def test_across_and_cost(spark):
    a = reports.across(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert a[0]["std"] == pytest.approx(math.sqrt(2)) and a[1]["std"] is None
    cells = spark.createDataFrame([("search", "done", 10.0), ("search", "done", 20.0), ("search", "failed", 1.0), ("replay", "pending", None)], "role string, state string, duration_seconds double")
    c = {r["role"]: r["estimate_seconds"] for r in reports.remaining_cost(cells).collect()}
    assert c == {"search": 15.0, "replay": None}
