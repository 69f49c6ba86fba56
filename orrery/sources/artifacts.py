"""Written results: splits, features, records, metrics and documents, with their validation and resume rules."""

from __future__ import annotations

import datetime
import json
import os
import platform
import re
import subprocess
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import ids
from orrery.operators.features import component_gate
from orrery.sources.tables import exists
from orrery.staging import stage

RECORD_KEYS = ["dataset", "recommender", "visual_config", "seed"]


def save_splits(folder: str, users: DataFrame, items: DataFrame, split: DataFrame) -> None:
    """Write maps and splits after the contract holds: contiguous maps, indexes in range, exact columns; the split is staged first."""
    split = stage(split, "split")
    for name, m in (("users", users), ("items", items)):
        row = ids.contiguity(m.withColumn("kind", F.lit(name)), "kind", "idx").first()
        if row is not None and not row["contiguous"]:
            raise ValueError(f"the {name} map isn't contiguous from 0")
    problems = split_problems(split, users.count(), items.count())
    if problems:
        raise ValueError("; ".join(problems))
    users.write.mode("overwrite").parquet(f"{folder}/users.parquet")
    items.write.mode("overwrite").parquet(f"{folder}/items.parquet")
    ids.require_columns(split, ["user_idx", "item_idx", "split"]).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/splits.parquet")


def split_problems(split: DataFrame, n_users: int, n_items: int) -> list[str]:
    """What is wrong with a split table: indexes out of range, repeated pairs, unknown split names."""
    found = split.agg(
        F.count_if((F.col("user_idx") < 0) | (F.col("user_idx") >= n_users) | F.col("user_idx").isNull()).alias("users"),
        F.count_if((F.col("item_idx") < 0) | (F.col("item_idx") >= n_items) | F.col("item_idx").isNull()).alias("items"),
        F.count_if(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))).alias("names"),
    ).first()
    out = [f"{found[k]} rows have {what}" for k, what in (("users", "a user outside the map"), ("items", "an item outside the map"), ("names", "an unknown split")) if found[k]]
    repeated = split.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    return out + [f"{repeated} pairs stand in more than one row"] * bool(repeated)


def read_splits(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The named splits (all without names); other splits aren't read."""
    df = spark.read.parquet(f"{folder}/splits.parquet")
    return df.where(F.col("split").isin(*names)) if names else df


def save_features(folder: str, name: str, df: DataFrame, meta: dict) -> None:
    """Write a feature table (item_idx, features) with its metadata; the declared dimension must be that of the rows."""
    dims = [r[0] for r in df.select(F.size("features").alias("d")).distinct().limit(2).collect()]
    if dims and dims != [meta["native_dim"]]:
        raise ValueError(f"{name}: rows of dimension {dims}, {meta['native_dim']} is declared")
    df.select("item_idx", F.transform("features", lambda x: x.cast("float")).alias("features")).write.mode("overwrite").parquet(f"{folder}/features/name={name}")
    write_json(f"{folder}/features/{name}.json", {"name": name, **meta})


def feature_names(spark: SparkSession, folder: str, dim: int | None = None) -> list[str]:
    """Names of the feature tables of a folder, sorted; with dim those of that declared dimension."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/features")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    names = sorted(n.removeprefix("name=") for n in found if n.startswith("name="))
    return names if dim is None else [n for n in names if feature_meta(folder, n).get("native_dim") == dim]


def feature_meta(folder: str, name: str) -> dict:
    """The metadata of a feature table; {} where there is none."""
    path = Path(f"{folder}/features/{name}.json")
    return json.loads(path.read_text()) if path.exists() else {}


def read_features(spark: SparkSession, folder: str, names: list[str], n_items: int | None = None) -> DataFrame:
    """item_idx and one struct of all named sources, joined on the item; a source that lacks items is an error."""
    out = None
    for name in names:
        own = spark.read.parquet(f"{folder}/features/name={name}").select("item_idx", F.col("features").alias(name))
        meta = feature_meta(folder, name)
        if meta.get("name", name) != name:
            raise ValueError(f"the metadata of {name} belongs to {meta['name']}")
        n, dims = own.agg(F.count(F.lit(1)), F.collect_set(F.size(name))).first()  # a table has few lengths
        if "native_dim" in meta and set(dims) - {meta["native_dim"]}:
            raise ValueError(f"{name}: rows of dimension {sorted(dims)}, {meta['native_dim']} is declared")
        if not n or (n_items is not None and n != n_items):
            raise ValueError(f"{name} has {n} rows" + (f", {n_items} are needed" if n_items else ""))
        out = own if out is None else out.join(own, "item_idx")
    return out.select("item_idx", F.struct(*names).alias("sources"))


def save_ragged(folder: str, name: str, sources: list[str], strategy: str, **more) -> None:
    """Declare sources of unequal length as one table that is aligned while a model is trained: a document, no rows."""
    dims = [feature_meta(folder, s)["native_dim"] for s in sources]
    write_json(f"{folder}/features/{name}.json", {"name": name, "sources": sources, "source_dims": dims, "strategy": strategy, "online": True, **more})


def read_ragged(spark: SparkSession, folder: str, name: str, n_items: int | None = None) -> tuple[DataFrame, dict]:
    """item_idx, sources (struct) of a declared table, and its document; a source whose dimension has changed since is an error."""
    meta = feature_meta(folder, name)
    if not meta.get("online"):
        raise ValueError(f"{name} declares no sources")
    now = [feature_meta(folder, s).get("native_dim") for s in meta["sources"]]
    if now != meta["source_dims"]:
        raise ValueError(f"{name}: the sources have dimensions {now}, {meta['source_dims']} are declared")
    return read_features(spark, folder, meta["sources"], n_items), meta


def save_components(folder: str, name: str, df: DataFrame, components: int, dim: int) -> None:
    """Write spatial features (item_idx, features as array of arrays) flat, with their shape; rows of another shape are an error."""
    gate = component_gate(df, "features", components, dim).first()
    if gate["n_bad_shape"] or gate["n_not_finite"]:
        raise ValueError(f"{name}: {gate['n_bad_shape']} rows aren't {components} x {dim}, {gate['n_not_finite']} have numbers that aren't finite")
    save_features(folder, name, df.select("item_idx", F.flatten("features").alias("features")), {"native_dim": components * dim, "components": components})


def read_components(spark: SparkSession, folder: str, name: str, n_items: int | None = None) -> DataFrame:
    """item_idx, features as array of arrays."""
    meta = feature_meta(folder, name)
    width = meta["native_dim"] // meta["components"]
    flat = read_features(spark, folder, [name], n_items).select("item_idx", F.col("sources")[name].alias("v"))
    return flat.select("item_idx", F.transform(F.sequence(F.lit(0), F.lit(meta["components"] - 1)), lambda i: F.slice("v", i * width + 1, width)).alias("features"))


def layout_problems(spark: SparkSession, folder: str, sample: int = 5) -> list[str]:
    """What is wrong with the written splits of a data set, each with up to sample of the bad items."""
    missing = [n for n in ("users", "items", "splits") if not exists(spark, f"{folder}/{n}.parquet")]
    if missing:
        return [f"{n}.parquet is missing" for n in missing]
    users, items, split = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("users", "items", "splits"))
    out = [f"{name} has columns {df.columns}" for name, df, wanted in (("users", users, {"idx"}), ("items", items, {"idx"}), ("splits", split, {"user_idx", "item_idx", "split"})) if not wanted <= set(df.columns)]
    if out:
        return out
    for name, m in (("users", users), ("items", items)):
        row = ids.contiguity(m.withColumn("kind", F.lit(name)), "kind", "idx").first()
        out += [f"the {name} map isn't contiguous from 0"] * (row is not None and not row["contiguous"])
    out += split_problems(split, users.count(), items.count())
    for column, m in (("user_idx", users), ("item_idx", items)):
        stray = split.join(m.select(F.col("idx").alias(column)), column, "left_anti").select(column).distinct()
        found = [r[0] for r in stray.orderBy(column).limit(sample).collect()]
        out += [f"{column} without an entry in the map, such as {found}"] * bool(found)
    unused = items.join(split.select(F.col("item_idx").alias("idx")), "idx", "left_anti").count()
    return out + [f"{unused} items stand in no split"] * bool(unused)


def save_records(folder: str, df: DataFrame) -> None:
    """Append per-user records (user_idx, rank, n_candidates, tie_block_size, top_items) of cells."""
    df.write.mode("append").partitionBy(*RECORD_KEYS).parquet(f"{folder}/records.parquet")


def read_records(spark: SparkSession, folder: str, **where) -> DataFrame:
    """Records of the cells that match; partitions of other cells aren't read."""
    df = spark.read.parquet(f"{folder}/records.parquet")
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df


def without_done(cells: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that no finished row covers."""
    return cells.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(folder: str, name: str, df: DataFrame, keys: list[str]) -> int:
    """Append the rows of cells not yet there; returns the number of new cells."""
    path = f"{folder}/{name}.parquet"
    spark = df.sparkSession
    new = without_done(df.select(*keys).distinct(), spark.read.parquet(path), keys) if Path(path).exists() else df.select(*keys).distinct()
    n = new.count()
    if n:
        df.join(new, keys, "left_semi").write.mode("append").parquet(path)
    return n


def table_kind(name: str) -> str | None:
    """evaluation, bootstrap, friedman or pairwise by the file name."""
    m = re.search(r"(evaluation|bootstrap|friedman|pairwise)", name)
    return m and m[1]


def write_json(path: str, document: dict) -> None:
    """Write a document as JSON with sorted keys."""
    write_text(path, json.dumps(document, indent=2, sort_keys=True))


def write_text(path: str, text: str, attempts: int = 5) -> None:
    """Write a small file so that a reader sees the old or the new one, never a part; a replacement that is refused is tried again."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=Path(path).parent, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    for attempt in range(attempts):
        try:
            os.replace(tmp, path)
            return
        except PermissionError:  # another process holds the file open, on some systems
            if attempt == attempts - 1:
                raise
            time.sleep(0.05 * 2**attempt)


def natural(key: str) -> list:
    """Sort key that orders numbers inside text by value."""
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.split(r"(\d+)", key) if p]


def export_best(results: DataFrame, path: str) -> dict:
    """Nested document dataset → model → embedding → hyperparameters and metric of the best run; one row per cell is collected."""
    best = results.groupBy("dataset", "model", "embedding").agg(F.max_by(F.struct("hyperparams", "metric"), F.struct("metric", "hyperparams")).alias("b"))
    out: dict = {}
    for r in sorted(best.collect(), key=lambda r: [natural(r[k]) for k in ("dataset", "model", "embedding")]):
        out.setdefault(r["dataset"], {}).setdefault(r["model"], {})[r["embedding"]] = {"hyperparams": json.loads(r["b"]["hyperparams"]), "metric": r["b"]["metric"]}
    write_json(path, out)
    return out


def markdown(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """A report of small tables; a table of more than most rows is an error."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(lines)


def environment() -> dict:
    """Versions, machine and commit of a run; the commit is None outside a repository."""
    import pyspark

    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, cwd=Path(__file__).parent).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"python": platform.python_version(), "spark": pyspark.__version__, "system": platform.platform(), "cpus": os.cpu_count(), "commit": commit}


class RunManifest:
    """Document of one run: configuration, steps with their times, state."""

    def __init__(self, path: str, config: dict) -> None:
        self.path, self.document = path, {"config": config, "started": self._now(), "state": "running", "steps": [], "environment": environment()}
        write_json(path, self.document)

    @staticmethod
    def _now() -> str:
        return datetime.datetime.now(datetime.timezone.utc).isoformat()

    def step(self, name: str, seconds: float, **more) -> None:
        """Record a finished step."""
        self.document["steps"].append({"name": name, "seconds": round(seconds, 3), **more})
        write_json(self.path, self.document)

    def finish(self, state: str = "done", error: str | None = None) -> None:
        """Close the run."""
        self.document |= {"state": state, "finished": self._now(), "error": error, "slowest": sorted(self.document["steps"], key=lambda s: -s["seconds"])[:3]}
        write_json(self.path, self.document)
