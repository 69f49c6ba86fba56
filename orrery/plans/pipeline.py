"""The end-to-end run: splits, fused features, trained models, rankings, metrics, tests and the best settings, all as tables.

Every step reads and writes one folder, leaves alone what is there, and is safe to repeat:

    splits/<dataset>/…      maps and splits                     features/<dataset>/…   feature tables
    models/cell=<key>/      results and parameters per cell     log/                   states of the cells
    records.parquet         ranks per user                      metrics.parquet        long metrics
    tests/<kind>.parquet    friedman, pairwise, bootstrap       best.json, report.md, run.json
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics, names, vectors
from orrery.operators import features as ft
from orrery.operators import ranking, recommenders, reports, splits
from orrery.operators import statistics as st
from orrery.plans import experiment
from orrery.sources import artifacts, providers
from orrery.sources.tables import exists


def training_arrays(train: DataFrame, val: DataFrame, most: int = 50_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Train and val pairs (user_idx, item_idx), sorted, for a trainer of one task; more than most rows raise before they are collected."""
    out = []
    for df in (train, val):
        if df.count() > most:
            raise ValueError(f"more than {most} pairs are too many for one training task")
        table = df.select("user_idx", "item_idx").toArrow()
        rows = np.column_stack([np.asarray(table.column(c)) for c in ("user_idx", "item_idx")]).reshape(-1, 2)
        out.append(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
    return out[0], out[1]


def feature_matrix(df: DataFrame, column: str, n_items: int, dim: int, most_bytes: int = 1 << 30) -> np.ndarray:
    """The vectors of a table (item_idx, column) at their item's row, zeros where an item has none; floats stay of 4 bytes until they are used."""
    if n_items * dim * 8 > most_bytes:
        raise ValueError(f"{n_items} vectors of {dim} are too many for one training task")
    own = df.where((F.col("item_idx") >= 0) & (F.col("item_idx") < n_items))
    kind = "float" if dict(df.dtypes)[column] == "array<float>" else "double"
    table = own.select("item_idx", F.transform(column, lambda v: v.cast(kind)).alias("v")).toArrow()
    x = np.zeros((n_items, dim), np.float32 if kind == "float" else np.float64)
    if table.num_rows:
        x[np.asarray(table.column("item_idx"))] = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
    return x


def history_arrays(train: DataFrame, n_users: int, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(users × most item numbers, mask) of the most smallest items of every user."""
    table = splits.truncated_history(train, "user_idx", "item_idx", most).toArrow()
    users, lists = np.asarray(table.column("user_idx")), table.column("history").combine_chunks()
    hist, mask = np.zeros((n_users, most), np.int64), np.zeros((n_users, most), bool)
    sizes = np.asarray(lists.value_lengths()).astype(np.int64) if table.num_rows else np.empty(0, np.int64)
    if sizes.sum():
        rows = np.repeat(users, sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hist[rows, place], mask[rows, place] = np.asarray(lists.flatten()), True
    return hist, mask


def factor_tables(spark: SparkSession, model: str, p: dict[str, np.ndarray], c: recommenders.Context) -> tuple[DataFrame, DataFrame]:
    """(user_idx, vector) and (item_idx, vector, bias) of a linear model, ready for the ranking."""
    import pyarrow as pa

    u, x, b = recommenders.factors(model, p, c)
    lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
    users = spark.createDataFrame(pa.table({"user_idx": pa.array(np.arange(len(u))), "vector": lists(u)}))
    return users, spark.createDataFrame(pa.table({"item_idx": pa.array(np.arange(len(x))), "vector": lists(x), "bias": pa.array(b)}))


def model_scores(state: tuple[str, dict[str, np.ndarray], recommenders.Context], users: np.ndarray) -> np.ndarray:
    """Scores of users for all items by a trained model."""
    model, p, c = state
    return recommenders.all_scores(model, p, c, users)


@dataclass
class Pipeline:
    """One run over data sets; sources by name, and per data set its feature tables (item_idx, features) by name."""

    spark: SparkSession
    folder: str
    config: dict
    sources: dict[str, providers.Source]
    features: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    space: dict[str, list] = field(default_factory=lambda: {"latent": [64, 128], "lr": [0.001, 0.01], "l2": [1e-4, 1e-3], "visual": [64, 128]})

    def steps(self) -> dict:
        """Name → body of every step."""
        return {"preprocess": lambda _: self.preprocess(), "fuse": self.fuse, "train": self.train, "evaluate": self.evaluate, "statistical": lambda _: self.statistical(), "export_best": lambda _: self.export_best()}

    def run(self, **slices) -> artifacts.RunManifest:
        """The whole plan, or a slice of it (only, start, stop)."""
        return experiment.run_plan(experiment.step_plan(self.config, **slices), self.steps(), f"{self.folder}/run.json", self.config)

    def _splits(self, dataset: str) -> str:
        return f"{self.folder}/splits/{dataset}"

    def _size(self, dataset: str, kind: str) -> int:
        return self.spark.read.parquet(f"{self._splits(dataset)}/{kind}.parquet").count()

    def preprocess(self) -> None:
        """Maps, leave-one-out splits and feature tables of data sets that are not there yet."""
        for dataset in self.config["datasets"]:
            if not exists(self.spark, f"{self._splits(dataset)}/splits.parquet/_SUCCESS"):
                artifacts.save_splits(self._splits(dataset), *providers.prepared(self.spark, self.sources[dataset], seed=self.config["seeds"][0]))
            for name, df in self.features.get(dataset, {}).items():
                if not exists(self.spark, f"{self.folder}/features/{dataset}/features/{name}.json"):
                    first = df.select(F.size("features")).first()
                    artifacts.save_features(f"{self.folder}/features/{dataset}", name, df, {"native_dim": first[0] if first else 0})

    def catalogue(self) -> DataFrame:
        """dataset, embedding_name of every feature table."""
        rows = [(d, n) for d in self.config["datasets"] for n in artifacts.feature_names(self.spark, f"{self.folder}/features/{d}")]
        return self.spark.createDataFrame(rows, "dataset string, embedding_name string")

    def fusion_tasks(self, condition: str) -> list[tuple[str, str, str, dict, list[str]]]:
        """(dataset, output name, strategy, options, sources) of the fusions still to be made of a condition's plain tables."""
        out = []
        for dataset in self.config["datasets"]:
            there = artifacts.feature_names(self.spark, f"{self.folder}/features/{dataset}")
            plain = [n for n in there if not n.startswith(names.HYBRID) and not n.endswith(names.COMPONENT) and (names.FINETUNED in n) == (condition == "finetuned")]
            dims = {n: artifacts.feature_meta(f"{self.folder}/features/{dataset}", n)["native_dim"] for n in plain}
            mark = names.FINETUNED if condition == "finetuned" else ""
            for strategy in self.config.get("fusions", []) if len(plain) >= 2 else []:
                for suffix, options in vectors.expand_grid(strategy).items():
                    own = plain if strategy in ("concat", "pca", "pca_per_model") else [n for n in plain if dims[n] == dims[plain[0]]]
                    k = options.get("components", 0)
                    dim = {"concat": sum(dims[n] for n in own), "pca": k, "pca_per_model": k * len(own)}.get(strategy, dims[own[0]])
                    name = f"{names.HYBRID}{strategy}{suffix}{mark}_D{dim}"
                    if len(own) >= 2 and name not in there:
                        out.append((dataset, name, strategy, options, own))
        return out

    def fuse(self, condition: str) -> None:
        """Fused feature tables of a condition; those that are there are skipped."""
        for dataset, name, strategy, options, own in self.fusion_tasks(condition):
            at = f"{self.folder}/features/{dataset}"
            rows = artifacts.read_features(self.spark, at, own).select("item_idx", *(F.col("sources")[n].alias(f"s{i}") for i, n in enumerate(own)))
            columns = [f"s{i}" for i in range(len(own))]
            if strategy in ("pca", "pca_per_model"):
                train = artifacts.read_splits(self.spark, self._splits(dataset), "train")
                fused = ft.pca_fused(rows, "item_idx", columns, train, options["components"], per_source=strategy == "pca_per_model")
            else:
                fused = rows.select("item_idx", vectors.fuse(strategy, [F.col(c) for c in columns], **options).alias("features"))
            first = fused.select(F.size("features")).first()
            artifacts.save_features(at, name, fused, {"native_dim": first[0] if first else 0, "strategy": strategy, "sources": own})

    def cells(self) -> DataFrame:
        """The units of work of this run."""
        return experiment.cell_table(self.spark, self.config, self.catalogue())

    def _context(self, cell: Row) -> recommenders.Context:
        n_users, n_items = self._size(cell["dataset"], "users"), self._size(cell["dataset"], "items")
        c = recommenders.Context(n_users, n_items)
        if cell["embedding_name"] != "none":
            at = f"{self.folder}/features/{cell['dataset']}"
            dim = artifacts.feature_meta(at, cell["embedding_name"])["native_dim"]
            own = artifacts.read_features(self.spark, at, [cell["embedding_name"]]).select("item_idx", F.col("sources")[cell["embedding_name"]].alias("v"))
            parts = artifacts.feature_meta(at, cell["embedding_name"]).get("components")
            x = feature_matrix(own, "v", n_items, dim)
            c.features = [x.reshape(n_items, parts, -1) if parts else x]
        if recommenders.known(cell["model"]).takes == "component":
            c.history, c.mask = history_arrays(artifacts.read_splits(self.spark, self._splits(cell["dataset"]), "train"), n_users)
        return c

    def _models(self, key: str) -> str:
        return f"{self.folder}/models/cell={names.plain_name(key)}"

    def train_cell(self, cell: Row) -> None:
        """Search over the grid on the first seed; the other seeds replay its best settings."""
        rows = artifacts.read_splits(self.spark, self._splits(cell["dataset"]))
        train, val = training_arrays(rows.where("split = 'train'"), rows.where("split = 'val'"))
        budget = experiment.budgets(self.spark, self.config).where(F.col("dataset") == cell["dataset"]).first()
        fixed = {"epochs": budget["epochs"], "patience": budget["early_stopping_patience"], "eval_every": self.config["common"]["eval_every"], "batch": self.config["common"]["batch"]}
        if cell["role"] == "search":
            takes = recommenders.known(cell["model"]).takes
            points = recommenders.grid({k: v for k, v in self.space.items() if takes != "none" or k != "visual"})
        else:
            first = names.plain_key(cell["dataset"], cell["embedding_name"], cell["model"], self.config["seeds"][0])
            best = recommenders.best_jobs(recommenders.results_of(self.spark.read.parquet(self._models(first)))).first()
            points = [json.loads(best["hyperparams"])]
        jobs = self.spark.createDataFrame([(cell["model"], json.dumps({**fixed, **p}, sort_keys=True), int(cell["seed"])) for p in points], recommenders.JOB)
        recommenders.trained(jobs, self._context(cell), train, val).write.mode("overwrite").parquet(self._models(cell["cell_key"]))

    def train(self, condition: str) -> None:
        """Train the open cells of a condition, at most one table per cell; a cell whose table is gone is trained again."""
        cells = self.cells().where(F.col("condition") == condition)
        keys = [r["cell_key"] for r in cells.select("cell_key").collect()]
        lost = self.spark.createDataFrame([(k,) for k in keys if not exists(self.spark, f"{self._models(k)}/_SUCCESS")], "cell_key string")
        experiment.run_cells(cells, f"{self.folder}/log/train", self.train_cell, lost)

    def evaluate_cell(self, cell: Row) -> None:
        """Final protocol of one cell: its best model ranks the test item of every user, train and val masked."""
        stored = self.spark.read.parquet(self._models(cell["cell_key"]))
        best = recommenders.best_jobs(recommenders.results_of(stored)).first()
        c, rows = self._context(cell), artifacts.read_splits(self.spark, self._splits(cell["dataset"]))
        p = recommenders.parameters_of(stored.where(F.col("hyperparams") == best["hyperparams"]))
        seen, held = rows.where("split <> 'test'"), rows.where("split = 'test'")
        keys = ranking.tie_keys(self.spark.range(c.n_items).select(F.col("id").alias("item_idx")), int(self.config["seeds"][0]))
        if recommenders.known(cell["model"]).linear:
            records = ranking.dot_ranking(*factor_tables(self.spark, cell["model"], p, c), keys, seen, held, top=20)
        else:
            records = ranking.model_ranking(keys, seen, held, (cell["model"], p, c), model_scores, top=20)
        where = {"dataset": cell["dataset"], "recommender": cell["model"], "visual_config": cell["embedding_name"], "seed": int(cell["seed"])}
        artifacts.save_records(self.folder, names.provenance(records, **where))

    def records(self) -> DataFrame:
        """All ranks, one row per cell and held item; a cell that was written twice by a run that broke off counts once."""
        rows = self.spark.read.parquet(f"{self.folder}/records.parquet")
        return rows.dropDuplicates([*artifacts.RECORD_KEYS, "user_idx", "item_idx"])

    def metric_rows(self) -> DataFrame:
        """The long metrics of all records."""
        keys = ["dataset", "recommender", "visual_config", "seed", "user_idx"]
        long = metrics.long_metrics(self.records(), keys, lambda k: metrics.rank_metrics(F.col("rank"), k), tuple(self.config["evaluation"]["ks"]))
        return long.withColumnRenamed("visual_config", "embedding_name").withColumnRenamed("value", "metric_value").withColumnRenamed("user_idx", "user_id")

    def evaluate(self, condition: str) -> None:
        """Rank with every trained cell of a condition that has no records yet."""
        trained = experiment.cell_states(self.cells().where(F.col("condition") == condition), f"{self.folder}/log/train").where("state = 'done'")
        cells = trained.drop("state", "duration_seconds", "error")
        lost = cells.select("cell_key")
        if exists(self.spark, f"{self.folder}/records.parquet"):
            done = self.spark.read.parquet(f"{self.folder}/records.parquet").select(names.cell_key(F.col("dataset"), F.col("visual_config"), F.col("recommender"), F.col("seed").cast("string")).alias("cell_key"))
            lost = lost.join(done.distinct(), "cell_key", "left_anti")
        experiment.run_cells(cells, f"{self.folder}/log/evaluate", self.evaluate_cell, lost)

    def statistical(self) -> None:
        """Tests, intervals and the report, from the metrics of the first seed; the spread over seeds beside them."""
        s, long = self.config["statistics"], self.metric_rows()
        long.write.mode("overwrite").parquet(f"{self.folder}/metrics.parquet")
        long = self.spark.read.parquet(f"{self.folder}/metrics.parquet")
        by, config = ["dataset", "metric", "k"], names.config_key(F.col("recommender"), F.col("embedding_name"))
        first = long.where(F.col("seed") == int(self.config["seeds"][0])).withColumn("config", config)
        values = st.clean_values(metrics.selected(first, ks=tuple(self.config["evaluation"]["ks"])), [*by, "config", "user_id"])
        pairs = st.families(first.select(F.col("recommender").alias("model"), "embedding_name"), tuple(s["families"]))
        means = reports.cell_means(long, ["dataset", "recommender", "embedding_name", "seed", "metric", "k"])
        tables = reports.consolidated({"friedman": st.friedman(values, by), "pairwise": st.pairwise(values, pairs, by, s["correction"], s["alpha"], s["draws"]), "bootstrap": reports.summary_long(st.bootstrap_mean(values, [*by, "config"], F.col("value"), s["draws"], s["alpha"]), "ndcg", 10)}, by)
        tables["evaluation"], tables["seeds"] = means, reports.across(means, ["dataset", "recommender", "embedding_name", "metric", "k"], "mean")
        for kind, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/tests/{kind}.parquet")
        over_seeds = self.spark.read.parquet(f"{self.folder}/tests/seeds.parquet").select("dataset", "recommender", "embedding_name", "metric", "k", "mean", "std", F.col("n").alias("n_seeds"))
        artifacts.write_text(f"{self.folder}/report.md", artifacts.markdown("Results", reports.report_sections(over_seeds)))

    def export_best(self) -> dict:
        """The best settings of every cell as one document."""
        parts = [r for r in self.cells().where("role = 'search'").collect() if exists(self.spark, f"{self._models(r['cell_key'])}/_SUCCESS")]
        out = None
        for r in parts:
            own = names.provenance(recommenders.results_of(self.spark.read.parquet(self._models(r["cell_key"]))), dataset=r["dataset"], embedding=r["embedding_name"])
            out = own if out is None else out.unionByName(own)
        return artifacts.export_best(out, f"{self.folder}/best.json") if out is not None else {}

    def status(self) -> DataFrame:
        """Cells per step, dataset, model and state."""
        parts = [experiment.cell_states(self.cells(), f"{self.folder}/log/{step}").select(F.lit(step).alias("step"), "dataset", "model", "role", "state", "duration_seconds") for step in ("train", "evaluate")]
        return parts[0].unionByName(parts[1])
