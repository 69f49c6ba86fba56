"""Sources, written artifacts, plans and the entry module."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.__main__ import main
from orrery.operators import recommenders as rc
from orrery.operators import reports
from orrery.plans import experiment as ex
from orrery.plans import pipeline as pl
from orrery.sources import artifacts, providers


def test_csv_source(spark, tmp_path):
    (tmp_path / "interactions.csv").write_text('user_id,item_id,image_path\nu1,i1,a.jpg\nu1,"i,2",\nu2,i1,bad\nu2,i3,b.png\nbroken"x,i1,a.jpg\nu1,i3,a.jpg\n')
    src = providers.source("csv", path=str(tmp_path))
    assert sorted((r["user_id"], r["item_id"]) for r in src.interactions(spark).collect()) == [("u1", "i,2"), ("u1", "i1"), ("u1", "i3"), ("u2", "i3")]
    assert sorted(r["reason"] for r in src.rejected(spark).collect()) == ["quoting", "value"]
    assert src.categories(spark) is None
    users, items, split = providers.prepared(spark, src)
    assert users.count() == 2 and items.count() == 3 and {r["split"] for r in split.collect()} == {"train", "val", "test"}
    (tmp_path / "interactions.csv").write_text("user,item\n")
    with pytest.raises(ValueError):
        src.interactions(spark)
    with pytest.raises(KeyError, match="csv"):
        providers.source("nothing")


def test_synthetic_splits_are_saved(spark, tmp_path):
    src = providers.SyntheticSource(20, 50)
    split = src.split(spark)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 120, "val": 20, "test": 20}
    users, items = (spark.range(n).select(F.col("id").cast("string").alias(c), F.col("id").alias("idx")) for c, n in (("user_id", 20), ("item_id", 50)))
    artifacts.save_splits(str(tmp_path), users, items, split)
    assert artifacts.read_splits(spark, str(tmp_path), "val").count() == 20
    with pytest.raises(ValueError, match="outside"):
        artifacts.save_splits(str(tmp_path), users.limit(3), items, split)
    with pytest.raises(ValueError, match="contiguous"):
        artifacts.save_splits(str(tmp_path), users.where("idx <> 1"), items, split)
    assert artifacts.split_problems(split.unionByName(split), 20, 50) == ["160 pairs stand in more than one row"]


def test_nested_form(spark):
    split, cats = providers.from_nested(spark, {0: [1, {b"productid": 2}]}, {0: [3]}, {0: [{"productid": 0}]}, {0: {"c": [0, 1]}, 1: {b"c": [1, 1]}, 2: {"c": [0, 0, 3]}})
    assert {tuple(r) for r in split.collect()} == {(0, 1, "train"), (0, 2, "train"), (0, 3, "val"), (0, 0, "test")}
    assert {r[0]: r[1] for r in cats.collect()} == {0: 1, 1: 0, 2: 2}
    assert providers.from_nested(spark, {0: [1]}, {}, {}, {0: {}})[1] is None


def test_features_and_records(spark, tmp_path):
    f = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "item_idx long, features array<double>")
    artifacts.save_features(str(tmp_path), "a", f, {"native_dim": 2})
    artifacts.save_features(str(tmp_path), "b", f, {"native_dim": 2})
    assert artifacts.read_features(spark, str(tmp_path), ["a", "b"], 2).select("sources.b").count() == 2
    with pytest.raises(ValueError):
        artifacts.read_features(spark, str(tmp_path), ["a"], 3)
    with pytest.raises(ValueError):
        artifacts.save_features(str(tmp_path), "c", f, {"native_dim": 3})
    rec = spark.createDataFrame([("d", "bpr", "none", s, 1, 2, 10, 1, [5, 6]) for s in (1, 2)], "dataset string, recommender string, visual_config string, seed long, user_idx long, rank long, n_candidates long, tie_block_size long, top_items array<long>")
    artifacts.save_records(str(tmp_path), rec)
    assert artifacts.read_records(spark, str(tmp_path), seed=2).count() == 1
    assert artifacts.append_results(str(tmp_path), "evaluation", rec.select("dataset", "seed", "rank"), ["dataset", "seed"]) == 2
    assert artifacts.append_results(str(tmp_path), "evaluation", rec.select("dataset", "seed", "rank"), ["dataset", "seed"]) == 0
    assert artifacts.table_kind("x_pairwise_y.csv") == "pairwise" and artifacts.table_kind("x") is None


def test_ragged_component_and_broken_layouts(spark, tmp_path):
    at = str(tmp_path)
    f = lambda d: spark.createDataFrame([(i, [float(i + j) for j in range(d)]) for i in range(3)], "item_idx long, features array<double>")
    for name, d in (("a_D2", 2), ("b_D3", 3)):
        artifacts.save_features(at, name, f(d), {"native_dim": d})
    artifacts.save_ragged(at, "hybrid_mean_learned_D4", ["a_D2", "b_D3"], "mean", aligned_dim=4)
    rows, meta = artifacts.read_ragged(spark, at, "hybrid_mean_learned_D4", 3)
    assert meta["source_dims"] == [2, 3] and len(rows.where("item_idx = 1").first()["sources"]["b_D3"]) == 3
    artifacts.save_features(at, "b_D3", f(2), {"native_dim": 2})
    with pytest.raises(ValueError, match="declared"):
        artifacts.read_ragged(spark, at, "hybrid_mean_learned_D4")
    assert artifacts.feature_names(spark, at) == ["a_D2", "b_D3"] and artifacts.feature_names(spark, at, 3) == []
    comp = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], "item_idx long, features array<array<double>>")
    artifacts.save_components(at, "x_comp", comp, 3, 2)
    assert artifacts.read_components(spark, at, "x_comp").first()["features"] == [[1, 2], [3, 4], [5, 6]]
    with pytest.raises(ValueError, match="aren't 2 x 2"):
        artifacts.save_components(at, "y_comp", comp, 2, 2)
    assert artifacts.layout_problems(spark, at) == [f"{n}.parquet is missing" for n in ("users", "items", "splits")]
    maps = spark.range(3).select(F.col("id").alias("idx"))
    for n in ("users", "items"):
        maps.write.parquet(f"{at}/{n}.parquet")
    spark.createDataFrame([(0, 0, "train"), (1, 9, "test"), (2, 1, "odd")], "user_idx long, item_idx long, split string").write.parquet(f"{at}/splits.parquet")
    problems = " ".join(artifacts.layout_problems(spark, at))
    assert "outside the map" in problems and "[9]" in problems and "unknown split" in problems and "1 items stand in no split" in problems


def test_declared_sources_and_archives(spark, tmp_path):
    import zipfile

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "interactions.csv").write_text("user_id,item_id,image_path\nu1,i1,a.jpg\n")
    with zipfile.ZipFile(tmp_path / "shop.zip", "w") as z:
        z.write(tmp_path / "data" / "interactions.csv", "interactions.csv")
    for name, path in (("plain", "data"), ("packed", "shop.zip")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "kind": "csv", "path": path}))
        assert providers.declared(str(tmp_path / f"{name}.json"), str(tmp_path / "scratch")) == name
        assert providers.source(name).interactions(spark).count() == 1
        del providers.REGISTRY[name]
    (tmp_path / "far.json").write_text(json.dumps({"name": "far", "kind": "csv", "url": "http://example.org/x.zip"}))
    with pytest.raises(ValueError, match="url"):
        providers.declared(str(tmp_path / "far.json"), str(tmp_path))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.csv", "x")
    (tmp_path / "bad.json").write_text(json.dumps({"name": "bad", "kind": "csv", "path": "bad.zip"}))
    with pytest.raises(ValueError, match="lead out"):
        providers.declared(str(tmp_path / "bad.json"), str(tmp_path / "scratch"))


def test_extraction_from_files(spark, tmp_path):
    from orrery.sources import extractors as xt

    (tmp_path / "i1.jpg").write_bytes(b"aab")
    (tmp_path / "i2.png").write_bytes(b"")
    (tmp_path / "other.png").write_bytes(b"zz")
    items = spark.createDataFrame([("i1", 0), ("i2", 1), ("none", 2)], "file_id string, item_idx long")
    got = {r["item_idx"]: r["features"] for r in xt.extracted(xt.files_of(spark, str(tmp_path)), items, "byte_histogram").collect()}
    assert got.keys() == {0} and got[0][97] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="byte_histogram"):
        xt.extracted(xt.files_of(spark, str(tmp_path)), items, "nothing")


def test_derived_labels_paths_and_trials(spark):
    from orrery.functions import metrics, vectors
    from orrery.operators import ids

    df = spark.createDataFrame([(i, [["a", "x" if i % 2 else "y"]] if i else None) for i in range(7)], "item_idx long, paths array<array<string>>")
    assert {r["item_idx"]: r["category_label"] for r in ids.taxonomy_sidecar(df, "item_idx", F.col("paths"), 1, 3).collect()} == {1: 0, 3: 0, 5: 0, 2: 1, 4: 1, 6: 1}
    assert ids.taxonomy_sidecar(df, "item_idx", F.col("paths"), 1, 50) is None
    rows = spark.createDataFrame([("a", None, 1), ("a", "p", 3), ("a", "q", 2), ("b", None, 1), (None, "x", 1)], "item_id string, path string, row_id long")
    assert {r[0]: r[1] for r in ids.first_paths(rows, "item_id", "path", "row_id").collect()} == {"a": "q", "b": None}
    trials = spark.createDataFrame([("COMPLETE",), ("PRUNED",), ("FAIL",), ("RUNNING",)], "state string")
    assert tuple(rc.trial_counts(trials).first()) == (4, 2, 1)
    long = spark.createDataFrame([("ndcg", 10), ("map", 10), ("ndcg", 7)], "metric string, k int")
    assert metrics.selected(long).count() == 1 and metrics.selected(long, derived=True).count() == 2

    @vectors.register_fusion("first")
    def first(vs):
        return vs[0]

    assert spark.range(1).select(vectors.fuse("first", [F.array(F.lit(3.0)), F.array(F.lit(4.0))], normalize=False)).first()[0] == [3.0]
    del vectors.FUSIONS["first"]


def test_documents(spark, tmp_path):
    r = spark.createDataFrame([("d", "m", "e10", '{"a": 1}', 0.5), ("d", "m", "e10", '{"a": 2}', 0.7), ("d", "m", "e9", '{"a": 3}', 0.1)], "dataset string, model string, embedding string, hyperparams string, metric double")
    out = artifacts.export_best(r, str(tmp_path / "best.json"))
    assert list(out["d"]["m"]) == ["e9", "e10"] and json.loads((tmp_path / "best.json").read_text())["d"]["m"]["e10"]["hyperparams"] == {"a": 2}
    assert "| d | m | e9 |" in artifacts.markdown("t", {"s": r.select("dataset", "model", "embedding")})


def test_plugins(tmp_path):
    (tmp_path / "good.py").write_text("from orrery.sources.providers import register\n@register('mine')\nclass S: pass\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "_private.py").write_text("raise RuntimeError('no')\n")
    assert providers.discover(str(tmp_path)) == ["good"] and providers.source("mine")
    del providers.REGISTRY["mine"]


def test_config_and_plan(spark, tmp_path):
    (tmp_path / "default.json").write_text('{"common": {"epochs": 5}, "datasets": ["d", "other"]}')
    (tmp_path / "a.json").write_text('{"common": {"epochs": 7}, "hp_budget": {"d": {"epochs": 9}}}')
    c = ex.load_config(str(tmp_path), seeds=[1, 2])
    assert {r["dataset"]: (r["epochs"], r["n_trials"]) for r in ex.budgets(spark, c).collect()} == {"d": (9, 30), "other": (7, 30)}
    for wrong in ({"common": {"nonsense": 1}}, {"recommenders_enabled": ["x"]}, {"condition": "x"}, {"vbpr": {"epochs": 3}}):
        with pytest.raises(ValueError):
            ex.load_config(str(tmp_path), **wrong)
    assert ex.step_plan(c, start="train", stop="evaluate") == [("train", "frozen"), ("train", "finetuned"), ("evaluate", "frozen"), ("evaluate", "finetuned")]
    with pytest.raises(ValueError):
        ex.step_plan(c, only=["x"])
    c["recommenders_enabled"].remove("avbpr")
    catalogue = spark.createDataFrame([("d", e) for e in ("clip_D64", "clip_finetuned_D64", "clip_comp", "clip_D64")] + [("elsewhere", "x_D8")], "dataset string, embedding_name string")
    cells = ex.cell_table(spark, c, catalogue).where("dataset = 'd'").collect()
    keys = [r["cell_key"] for r in cells]
    assert "d__none__bpr__1" in keys and "d__clip_comp__acf__2" in keys and "d__clip_D64__acf__1" not in keys and not any("avbpr" in k for k in keys)
    assert len(keys) == len(set(keys)) == 2 * (1 + 3 + 1 + 3) and {r["role"] for r in cells if r["seed"] == 2} == {"replay"}
    assert {r["condition"] for r in cells if "finetuned" in r["embedding_name"]} == {"finetuned"}


def test_run_resumes_and_survives_failures(spark, tmp_path):
    cells = spark.createDataFrame([(k, "search", i) for i, k in enumerate("abc")], "cell_key string, role string, priority int")
    ran, path = [], str(tmp_path / "log")

    def run(cell):
        ran.append(cell["cell_key"])
        if cell["cell_key"] == "b":
            raise RuntimeError("broken")

    state = lambda df: {r["cell_key"]: r["state"] for r in df.collect()}
    assert state(ex.cell_states(cells, path)) == dict.fromkeys("abc", "pending")
    assert state(ex.run_cells(cells, path, run)) == {"a": "done", "b": "failed", "c": "done"}
    assert "broken" in ex.cell_states(cells, path).where("state = 'failed'").first()["error"]
    ex.run_cells(cells, path, run, lost=cells.where("cell_key = 'c'"))
    assert ran == ["a", "b", "c", "c"]
    ex.record(spark, path, "a", "running")  # a run that died
    assert state(ex.cell_states(cells, path))["a"] == "pending"
    ex.run_cells(cells, path, lambda cell: ran.append("again " + cell["cell_key"]), retry_failed=True)
    assert ran[4:] == ["again a", "again b"]
    cost = reports.remaining_cost(ex.cell_states(cells.unionByName(spark.createDataFrame([("z", "replay", 9)], cells.schema)), path)).collect()
    assert [(r["role"], r["n_open"], r["mean_seconds"]) for r in cost] == [("replay", 1, None)]


def test_pipeline_end_to_end(spark, tmp_path):
    import duckdb

    src = providers.SyntheticSource(24, 30, per_user=6)
    rows = lambda seed, d: spark.createDataFrame([(i, [float(x) for x in np.random.default_rng((seed, i)).standard_normal(d)]) for i in range(30)], "item_idx long, features array<double>")
    # items that nobody took have no index, so that the tables hold more rows than the catalogue may need
    config = ex.load_config(None, datasets=["synth"], recommenders_enabled=["bpr", "vbpr", "vnpr"], condition="frozen", seeds=[1, 2], common={"epochs": 2, "eval_every": 1, "batch": 64}, statistics={"draws": 50})
    features = {"synth": {"a_D4": rows(1, 4)}}
    config["recommenders_enabled"].remove("vbpr")
    make = lambda: pl.Pipeline(spark, str(tmp_path), config, {"synth": src}, features, {"latent": [4], "lr": [0.01, 0.05], "visual": [3]})
    p = make()
    run = p.run()
    assert run.document["state"] == "done" and [s["name"] for s in run.document["steps"]] == ["preprocess", "fuse", "train", "evaluate", "statistical", "export_best"]
    assert p.catalogue().count() == 1
    status = p.status().groupBy("step", "state").count().collect()
    assert {(r["step"], r["state"]): r["count"] for r in status} == {("train", "done"): 4, ("evaluate", "done"): 4}
    log = spark.read.parquet(f"{tmp_path}/log/train").count()
    records = p.records()
    assert records.count() == 4 * 24 and records.where(F.size("top_items") == 20).count() == 4 * 24
    assert make().run().document["state"] == "done"  # the second run trains and ranks nothing
    assert spark.read.parquet(f"{tmp_path}/log/train").count() == log and p.records().count() == 4 * 24
    for kind in ("evaluation", "tests", "bootstrap", "seeds"):
        assert spark.read.parquet(f"{tmp_path}/tests/{kind}.parquet").count() > 0
    assert "Best 10 by ndcg@10" in (tmp_path / "report.md").read_text() and json.loads((tmp_path / "best.json").read_text())["synth"]["vnpr"]["a_D4"]["hyperparams"]["epochs"] == 2
    config["fusions"], features["synth"]["b_D4"], features["synth"]["b_finetuned_D4"] = ["mean", "weighted_mean", "pca_per_model"], rows(2, 4), rows(3, 4)
    p = make()
    p.preprocess()
    assert [t[1] for t in p.fusion_tasks("frozen")][:2] == ["hybrid_mean_D4", "hybrid_weighted_mean_w0.3_D4"] and p.fusion_tasks("finetuned") == []
    p.config["fusions"] = ["mean"]
    p.fuse("frozen")
    assert p.fusion_tasks("frozen") == [] and "hybrid_mean_D4" in [r["embedding_name"] for r in p.catalogue().collect()]
    # the ranks of the trained model against SQL over the written factors
    best = rc.best_jobs(rc.results_of(spark.read.parquet(f"{tmp_path}/models/cell=synth__none__bpr__1"))).first()
    sql = f"""
    with m as (select * from '{tmp_path}/models/cell=synth__none__bpr__1/*.parquet' where hyperparams = '{best["hyperparams"]}'),
    s as (select * from read_parquet('{tmp_path}/splits/synth/splits.parquet/*/*.parquet', hive_partitioning = true)),
    x as (select u.idx as user_idx, i.idx as item_idx, round(list_dot_product(u.vector, i.vector) + b.vector[1], 9) as s, md5('1:' || i.idx) as k
      from m u join m i on u.kind = 'user' and i.kind = 'item' join m b on b.kind = 'bias' and b.idx = i.idx),
    c as (select x.* from x anti join (select * from s where split <> 'test') t on t.user_idx = x.user_idx and t.item_idx = x.item_idx)
    select t.user_idx, t.item_idx, 1 + count(*) filter (c.s > h.s or (c.s = h.s and c.k < h.k)), count(*), count(*) filter (c.s = h.s)
    from s t join c h on t.split = 'test' and h.user_idx = t.user_idx and h.item_idx = t.item_idx join c on c.user_idx = t.user_idx group by 1, 2"""
    own = records.where("recommender = 'bpr' and seed = 1").select("user_idx", "item_idx", "rank", "n_candidates", "tie_block_size").collect()
    assert sorted(map(tuple, own)) == sorted(duckdb.sql(sql).fetchall())


def test_run_manifest(tmp_path):
    path = tmp_path / "run.json"
    with pytest.raises(RuntimeError):
        ex.run_plan([("fuse", None), ("train", "frozen")], {"fuse": lambda c: None, "train": lambda c: 1 / 0 if False else (_ for _ in ()).throw(RuntimeError("x"))}, str(path), {})
    doc = json.loads(path.read_text())
    assert doc["state"] == "failed" and [s["name"] for s in doc["steps"]] == ["fuse"]


def test_command_line(capsys):
    assert main(["list", "recommenders"]) == 0 and "vbpr" in capsys.readouterr().out
    assert main(["plan", "--condition", "frozen", "--only", "train"]) == 0 and capsys.readouterr().out.strip() == "train frozen"


def test_entry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "full_ranking_popularity" in queries and len(queries) > 80
