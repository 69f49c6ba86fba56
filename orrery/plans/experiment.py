"""Configuration, step plan, the table of cells, and the append-only log of their states."""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orrery.functions import names
from orrery.operators import reports
from orrery.operators.recommenders import MODELS
from orrery.sources.artifacts import RunManifest
from orrery.sources.tables import exists

# The steps in their order, those that run per condition, the defaults of the protocol.
STEPS = ("preprocess", "fuse", "train", "evaluate", "statistical", "export_best")
PER_CONDITION = ("fuse", "train", "evaluate")
DEFAULTS = {
    "seeds": [42],
    "condition": "both",
    "datasets": [],
    "recommenders_enabled": list(names.RECOMMENDERS),
    "common": {"early_stopping_metric": "ndcg@10", "early_stopping_patience": 20, "epochs": 100, "eval_every": 10, "eval_sample_size": 2000, "batch": 4096},
    "hp_search": {"n_trials": 30, "sampler": "random", "pruner": "median"},
    "hp_budget": {},
    "evaluation": {"ks": [5, 10, 20], "protocol": "full", "n_negatives": 100},
    "statistics": {"alpha": 0.05, "correction": "holm", "families": ["backbone_within_model", "model_within_backbone", "fusion_within_model", "frozen_vs_finetuned"], "draws": 1000},
}
BUDGET = {"n_trials": "long", "early_stopping_metric": "string", "early_stopping_patience": "long", "epochs": "long", "eval_sample_size": "long"}
CLOSED = ("common", "hp_search", "evaluation", "statistics")


def merged(base: dict, *overrides: dict) -> dict:
    """base with the overrides laid over it, deeply, in order."""
    out = copy.deepcopy(base)
    for o in overrides:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(folder: str | None = None, **overrides) -> dict:
    """Defaults, then default.json of the folder, then its other files by name, then overrides; validated."""
    files = sorted(Path(folder).glob("*.json"), key=lambda p: (p.stem != "default", p.name)) if folder else []
    config = merged(DEFAULTS, *(json.loads(p.read_text()) for p in files), overrides)
    for block in CLOSED:
        unknown = set(config[block]) - set(DEFAULTS[block])
        if unknown:
            raise ValueError(f"{block} has unknown settings {sorted(unknown)}")
    unknown = [m for m in config["recommenders_enabled"] if m not in MODELS]
    if unknown or config["condition"] not in ("frozen", "finetuned", "both"):
        raise ValueError(f"unknown recommenders {unknown}" if unknown else f"unknown condition {config['condition']}")
    own = {m: sorted(BUDGET.keys() & config.get(m, {}).keys()) for m in config["recommenders_enabled"]}
    if any(own.values()):
        raise ValueError(f"a budget belongs to a data set, not to a recommender: {own}")
    return config


def overrides(settings: list[str]) -> dict:
    """Nested settings of texts KEY=JSON, where dots in the key lead into blocks; a value that is no JSON is a text."""
    out: dict = {}
    for entry in settings:
        key, _, raw = entry.partition("=")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        for part in reversed(key.split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


def budgets(spark: SparkSession, config: dict) -> DataFrame:
    """dataset and its search budget, one row per data set: the common values under those of hp_budget."""
    base = {**config["hp_search"], **config["common"]}
    rows = [(d, *({**base, **config["hp_budget"].get(d, {})}[k] for k in BUDGET)) for d in config["datasets"]]
    return spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{k} {t}" for k, t in BUDGET.items()))


def conditions(config: dict) -> list[str]:
    """The conditions a run covers."""
    return ["frozen", "finetuned"] if config["condition"] == "both" else [config["condition"]]


def step_plan(config: dict, only: list[str] | None = None, start: str | None = None, stop: str | None = None) -> list[tuple[str, str | None]]:
    """(step, condition) in order; only, start and stop slice the plan; unknown steps raise."""
    for s in [*(only or []), *([start] if start else []), *([stop] if stop else [])]:
        if s not in STEPS:
            raise ValueError(f"unknown step {s}; known: {', '.join(STEPS)}")
    lo, hi = STEPS.index(start) if start else 0, STEPS.index(stop) + 1 if stop else len(STEPS)
    chosen = [s for s in STEPS[lo:hi] if only is None or s in only]
    return [(s, c) for s in chosen for c in (conditions(config) if s in PER_CONDITION else [None])]


def cell_table(spark: SparkSession, config: dict, catalogue: DataFrame) -> DataFrame:
    """Every eligible unit of work: dataset, embedding_name, model, seed, condition, role, priority, cell_key.

    catalogue (dataset, embedding_name) lists the feature tables. What a recommender takes decides which of them it meets:
    those that take none are one frozen cell per data set. The first seed searches, the others replay its result.
    """
    seeds = spark.createDataFrame([(int(s), "replay" if i else "search") for i, s in enumerate(config["seeds"])], "seed long, role string")
    models = spark.createDataFrame([(m, MODELS[m].takes, MODELS[m].priority) for m in config["recommenders_enabled"]], "model string, takes string, priority int")
    wanted = spark.createDataFrame([(d,) for d in config["datasets"]], "dataset string")
    e = F.col("embedding_name")
    found = catalogue.select("dataset", "embedding_name").distinct().withColumns({"takes": F.when(names.is_component(e), "component").otherwise("pooled"), "condition": names.condition_of(e)})
    found = found.unionByName(wanted.select("dataset", F.lit("none").alias("embedding_name"), F.lit("none").alias("takes"), F.lit("frozen").alias("condition")))
    cells = found.where(F.col("condition").isin(conditions(config))).join(wanted, "dataset", "left_semi").join(models, "takes").join(seeds)  # a small grid of names
    key = names.cell_key(F.col("dataset"), e, F.col("model"), F.col("seed").cast("string"))
    return cells.select("dataset", "embedding_name", "model", "seed", "condition", "role", "priority", key.alias("cell_key"))


EVENT = "cell_key string, state string, at long, seconds double, error string"


def record(spark: SparkSession, path: str, cell_key: str, state: str, seconds: float | None = None, error: str | None = None) -> None:
    """Append one change of state to the log at path."""
    spark.createDataFrame([(cell_key, state, time.time_ns(), seconds, error and error[:500])], EVENT).coalesce(1).write.mode("append").parquet(path)


def cell_states(cells: DataFrame, path: str) -> DataFrame:
    """cells with the last state of the log and its seconds and error; pending where there is none, and where a run died while it ran."""
    spark = cells.sparkSession
    log = spark.read.schema(EVENT).parquet(path) if exists(spark, path) else spark.createDataFrame([], EVENT)
    last = reports.latest_state(log, "cell_key", "at", ["seconds", "error"])
    state = F.when(F.coalesce("state", F.lit("running")) == "running", "pending").otherwise(F.col("state"))
    return cells.join(last, "cell_key", "left").withColumn("state", state).withColumnRenamed("seconds", "duration_seconds")


def run_cells(cells: DataFrame, path: str, execute: Callable[[Row], None], lost: DataFrame | None = None, retry_failed: bool = False) -> DataFrame:
    """Run the open cells in order of priority and return all states; the log at path is all that is kept.

    Open are pending cells, failed ones with retry_failed, and done ones of lost (cell_key: their results are gone). A
    failure is recorded and does not stop the rest. Cells are rows of names, so the open ones are collected.
    """
    spark, open_states = cells.sparkSession, ["pending", "failed"] if retry_failed else ["pending"]
    states = cell_states(cells, path)
    todo = states.where(F.col("state").isin(open_states))
    if lost is not None:
        todo = todo.unionByName(states.where("state = 'done'").join(lost.select("cell_key").distinct(), "cell_key", "left_semi"))
    for cell in todo.orderBy(F.col("role") == "replay", "priority", "cell_key").collect():
        record(spark, path, cell["cell_key"], "running")
        began = time.monotonic()
        try:
            execute(cell)
        except Exception as e:
            record(spark, path, cell["cell_key"], "failed", time.monotonic() - began, str(e))
        else:
            record(spark, path, cell["cell_key"], "done", time.monotonic() - began)
    return cell_states(cells, path)


def run_plan(plan: list[tuple[str, str | None]], steps: dict[str, Callable[[str | None], None]], path: str, config: dict) -> RunManifest:
    """Run the steps of a plan in order, timed, under a run manifest that is closed in any case."""
    run = RunManifest(path, config)
    try:
        for name, condition in plan:
            began = time.time()
            steps[name](condition)
            run.step(name, time.time() - began, condition=condition)
        run.finish()
    except Exception as e:
        run.finish("failed", str(e)[:500])
        raise
    return run
