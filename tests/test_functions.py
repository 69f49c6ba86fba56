"""Vectors, names, ids, features and components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import names, vectors
from orrery.operators import features, ids


def _fuse(spark, name, rows, normalize=False, **options):
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    return [r[0] for r in df.select(vectors.fuse(name, [F.col("a"), F.col("b")], normalize, **options)).collect()]


A, B = [1.0, 2.0, -3.0], [4.0, -2.0, 0.5]


@pytest.mark.parametrize(
    ("name", "options", "want"),
    [
        ("mean", {}, [2.5, 0, -1.25]),
        ("sum", {}, [5, 0, -2.5]),
        ("prod", {}, [4, -4, -1.5]),
        ("max_pool", {}, [4, 2, 0.5]),
        ("weighted_mean", {"weights": [1, 3]}, [3.25, -1, -0.375]),
        ("weighted_mean", {}, [2.5, 0, -1.25]),
        ("attention_weighted", {"logits": [math.log(1), math.log(3)]}, [3.25, -1, -0.375]),
        ("gated", {"logits": [0, 0]}, [2.5, 0, -1.25]),
        ("concat", {}, A + B),
    ],
)
def test_fusions(spark, name, options, want):
    assert _fuse(spark, name, [(A, B)], **options)[0] == pytest.approx(want)


def test_fusion_rules(spark):
    unit = _fuse(spark, "sum", [([3.0, 4.0], [0.0, 0.0])], normalize=True)[0]
    assert unit == pytest.approx([0.6, 0.8])
    assert _fuse(spark, "concat", [([1.0], [1.0, 2.0])])[0] == [1, 1, 2]
    with pytest.raises(Exception, match="differ in length"):
        _fuse(spark, "mean", [([1.0], [1.0, 2.0])])
    with pytest.raises(ValueError):
        _fuse(spark, "weighted_mean", [(A, B)], weights=[1, -1])
    with pytest.raises(ValueError):
        _fuse(spark, "other", [(A, B)])
    assert set(vectors.expand_grid("pca_per_model")) == {"_nc32", "_nc64", "_nc128"} and len(vectors.expand_grid("weighted_mean")) == 3


def test_names(spark):
    rows = ["none", "clip_vitb32_D128", "vit_b16_finetuned_D128", "hybrid_adaptive_gated_D128", "hybrid_mean_finetuned_D64", "resnet50", "resnet50_finetuned_comp", None]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    got = [r["p"] and tuple(r["p"]) for r in df.select(names.parse_embedding_name(F.col("n")).alias("p")).collect()]
    assert got == [
        ("none", "none", "both", None), ("clip_vitb32", "none", "frozen", 128), ("vit_b16", "none", "finetuned", 128), ("hybrid", "adaptive_gated", "frozen", 128),
        ("hybrid", "mean", "finetuned", 64), ("resnet50", "none", "frozen", None), ("resnet50_finetuned_comp", "none", "frozen", None), None,
    ]
    assert df.select(names.backbone_base(F.col("n"))).collect()[6][0] == "resnet50"


def test_configs(spark):
    df = spark.createDataFrame([("vbpr_clip_D64",), ("bpr",), ("uniform_noise_x",), ("odd_x",), ("bprx",)], "c string")
    got = [tuple(r[0]) for r in df.select(names.split_config(F.col("c"), ("bpr", "vbpr", "uniform", "uniform_noise"))).collect()]
    assert got == [("vbpr", "clip_D64"), ("bpr", "none"), ("uniform_noise", "x"), ("unknown", "odd_x"), ("unknown", "bprx")]


def test_seeds_keys_and_provenance(spark):
    import hashlib

    got = spark.range(1).select(names.seed_of(F.lit("d__e__m"), 42), names.seed_of(F.lit("d__e__x"), 42), names.run_key(F.lit("d"), F.lit("e"))).first()
    assert got[0] == int(hashlib.md5(b"42:d__e__m").hexdigest()[:15], 16) % 2**31 != got[1] and got[2] == hashlib.md5(b"d__e").hexdigest()
    assert names.plain_key("d", "e", 1) == "d__e__1" and names.plain_name("a/b c") == "a_b_c"
    df = names.tagged_union({1: spark.createDataFrame([(1,)], "a int"), 2: spark.createDataFrame([(2, "x")], "a int, b string")})
    assert sorted(tuple(r) for r in df.select("a", "seed", "b").collect()) == [(1, 1, None), (2, 2, "x")]
    with pytest.raises(ValueError):
        names.provenance(df, seed=3)


def test_dense_ids_and_categories(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 2)], "item_id string, position long")
    assert {r[0]: r[1] for r in ids.dense_ids(df, "item_id", "position").collect()} == {"b": 0, "a": 1, "c": 2}
    cats = spark.createDataFrame([("a", "7", 1), ("a", "3", 2), ("b", "12", 1), ("c", "x", 1), ("z", "5", 1), ("b", None, 9)], "item_id string, category_label string, row_id long")
    items = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "item_id string, item_idx long")
    labels = ids.sidecar_categories(cats, items)
    assert {r[0]: r[1] for r in labels.collect()} == {"a": 0, "b": 1}
    assert {r["item_idx"]: r["category"] for r in ids.item_categories(items, labels).collect()} == {0: 0, 1: 1, 2: 2}
    ids.category_contract(labels, 2)
    with pytest.raises(ValueError):
        ids.category_contract(labels, 3)
    with pytest.raises(ValueError):
        ids.require_columns(items, ["item_idx"])
    assert ids.out_of_range(items, "item_idx", 2).count() == 1


def test_taxonomy_and_decoding(spark):
    df = spark.createDataFrame([([[], ["a", "b", "c"]],), ([["x"]],), ([],), (None,)], "p array<array<string>>")
    assert [r[0] for r in df.select(ids.path_label(F.col("p"), 1)).collect()] == ["b", "x", None, None]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in raw.select(ids.decoded(F.col("b"))).collect()] == ["é", "é"]


def test_gate(spark):
    rows = [("m", [3.0, 4.0]), ("m", [0.0, 0.0]), ("m", None), ("m", [1.0]), ("m", [float("nan"), 1.0]), ("m", [6.0, 8.0])]
    r = features.feature_gate(spark.createDataFrame(rows, "n string, f array<float>"), "n", "f", F.lit(2)).first()
    assert (r["n_rows"], r["n_null"], r["n_bad_dim"], r["n_not_finite"], r["n_zero"]) == (6, 1, 1, 1, 1)
    assert (r["norm_mean"], r["norm_std"], r["norm_min"], r["norm_max"]) == (7.5, 2.5, 5, 10)
    c = features.component_gate(spark.createDataFrame([([[1.0], [2.0]],), ([[1.0]],), ([[1.0], [float("inf")]],), (None,)], "f array<array<float>>"), "f", 2, 1).first()
    assert tuple(c) == (4, 2, 1)


def test_pca_is_fitted_on_train_rows_and_centred(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    x[40:] += 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_idx long, f array<double>")
    train = spark.range(40).withColumnRenamed("id", "item_idx")
    pca = features.TrainPca(df, "f", train, "item_idx", 2)
    got = np.array([r["z"] for r in pca.transform(df, "f", "z").orderBy("item_idx").collect()])
    _, s, vt = np.linalg.svd(x[:40] - x[:40].mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs((x - x[:40].mean(0)) @ vt[:2].T), abs=1e-6)
    assert pca.explained == pytest.approx(s[:2] ** 2 / (s**2).sum())
    with pytest.raises(ValueError):
        features.TrainPca(df, "f", None, "item_idx", 2)
    assert features.TrainPca(df, "f", train, "item_idx", 99).components == 5
    none = features.TrainPca(df, "f", train.limit(0), "item_idx", 2)
    assert none.components == 0 and none.transform(df, "f", "z").first()["z"] == []
