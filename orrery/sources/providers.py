"""Data sources: what a data set offers, where it comes from, and the registry of known ones."""

from __future__ import annotations

import importlib.util
import json
import shutil
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import ids, records, splits


class Source(Protocol):
    """A data set: interactions (user_id, item_id, image_path, position) and, if it has them, category labels."""

    def interactions(self, spark: SparkSession) -> DataFrame: ...

    def categories(self, spark: SparkSession) -> DataFrame | None: ...


REGISTRY: dict[str, Callable[..., Source]] = {}


def register(name: str):
    """Decorator that makes a source known by name."""

    def add(factory: Callable[..., Source]) -> Callable[..., Source]:
        REGISTRY[name] = factory
        return factory

    return add


def source(name: str, **options) -> Source:
    """A known source, or an error that lists them."""
    if name not in REGISTRY:
        raise KeyError(f"unknown source {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


@register("csv")
class CsvSource:
    """A folder with interactions.csv (user_id,item_id,image_path) and perhaps categories.csv (item_id,category_label).

    Ids are strings. Rows without a user or item are left out; a missing column is an error. Files are read as text
    records, so that bad rows can be listed with rejected() instead of failing the load.
    """

    FILES = {"interactions": "interactions.csv", "categories": "categories.csv"}

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _lines(self, spark: SparkSession, name: str) -> DataFrame:
        file = self.FILES[name]
        head = spark.read.option("wholetext", "false").text(f"{self.path}/{file}").limit(1).collect()  # the header
        wanted = [f.name for f in records.LAYOUTS[file]]
        if not head or head[0][0].lstrip("﻿").strip().split(",") != wanted:
            raise ValueError(f"{file} must have the columns {', '.join(wanted)}")
        rows = spark.read.text(f"{self.path}/{file}").withColumn("position", F.monotonically_increasing_id())
        return rows.where((F.col("value") != ",".join(wanted)) & (F.trim("value") != "")).select("position", F.lit(file).alias("kind"), F.col("value").alias("line"))

    def _parsed(self, spark: SparkSession, name: str) -> DataFrame:
        return records.parse_records(self._lines(spark, name), "position", "kind", "line")

    def interactions(self, spark: SparkSession) -> DataFrame:
        """Valid rows in file order."""
        names = [f.name for f in records.LAYOUTS["interactions.csv"]]
        good = self._parsed(spark, "interactions").where("reason is null")
        return ids.clean_interactions(good.select(*(F.col("fields")[i].alias(c) for i, c in enumerate(names)), F.col("rec_id").alias("position")))

    def categories(self, spark: SparkSession) -> DataFrame | None:
        """Valid labels, or None without the file."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/categories.csv")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        good = self._parsed(spark, "categories").where("reason is null")
        return good.select(F.col("fields")[0].alias("item_id"), F.col("fields")[1].alias("category_label"), F.col("rec_id").alias("row_id"))

    def rejected(self, spark: SparkSession, name: str = "interactions") -> DataFrame:
        """position and reason of the rows that were not loaded."""
        return self._parsed(spark, name).where("reason is not null").select(F.col("rec_id").alias("position"), "reason")


@register("parquet")
class ParquetSource:
    """A folder with interactions.parquet and perhaps categories.parquet, with a row_id."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def interactions(self, spark: SparkSession) -> DataFrame:
        """Rows with both ids."""
        return ids.clean_interactions(spark.read.parquet(f"{self.path}/interactions.parquet")).withColumnRenamed("row_id", "position")

    def categories(self, spark: SparkSession) -> DataFrame | None:
        """The label table."""
        return spark.read.parquet(f"{self.path}/categories.parquet")


@register("synthetic")
class SyntheticSource:
    """Users who pick items without replacement; the first pick is test, the second val, the rest train."""

    def __init__(self, n_users: int = 100, n_items: int = 200, n_categories: int = 5, per_user: int = 8, seed: int = 42) -> None:
        self.n_users, self.n_items, self.n_categories, self.per_user, self.seed = n_users, n_items, n_categories, per_user, seed

    def split(self, spark: SparkSession) -> DataFrame:
        """user_idx, item_idx, split."""
        n_items, per_user, seed = self.n_items, self.per_user, self.seed

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                picks = [np.random.default_rng((seed, int(u))).choice(n_items, size=min(per_user, n_items), replace=False) for u in f["id"]]
                yield pd.DataFrame([(int(u), int(i), "test" if j == 0 else "val" if j == 1 else "train") for u, p in zip(f["id"], picks) for j, i in enumerate(p)], columns=["user_idx", "item_idx", "split"])

        return spark.range(self.n_users).mapInPandas(draw, "user_idx long, item_idx long, split string")

    def interactions(self, spark: SparkSession) -> DataFrame:
        """The picks as raw interactions."""
        return self.split(spark).select(F.concat(F.lit("u"), "user_idx").alias("user_id"), F.concat(F.lit("i"), "item_idx").alias("item_id"), F.lit(None).cast("string").alias("image_path"), (F.col("user_idx") * self.per_user + F.when(F.col("split") == "train", 2).when(F.col("split") == "val", 1).otherwise(0)).alias("position"))

    def categories(self, spark: SparkSession) -> DataFrame:
        """Item number modulo the number of categories."""
        return spark.range(self.n_items).select(F.concat(F.lit("i"), "id").alias("item_id"), (F.col("id") % self.n_categories).cast("string").alias("category_label"), F.col("id").alias("row_id"))


def declared(document: str, scratch: str) -> str:
    """Register the source that a JSON document declares, and return its name.

    Keys: name, kind (a registered source), path (absolute, or beside the document; a folder, or a zip or tar archive, which is
    unpacked once under scratch, a folder that all executors share), options. Names that lead out of the archive are an error,
    and a url is one too: nothing is downloaded.
    """
    doc, base = json.loads(Path(document).read_text()), Path(document).parent
    if "url" in doc:
        raise ValueError(f"{doc.get('name')}: a url can't be read here; give a path")
    if doc["kind"] not in REGISTRY:
        raise KeyError(f"unknown source {doc['kind']}; known: {', '.join(sorted(REGISTRY))}")
    path = base / doc["path"]
    if path.is_file():
        target = Path(scratch) / doc["name"]
        if not target.exists():
            part = target.with_name(target.name + ".part")
            shutil.rmtree(part, ignore_errors=True)
            if zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as z:
                    if any(n.startswith("/") or ".." in Path(n).parts for n in z.namelist()):
                        raise ValueError(f"{path} holds names that lead out of it")
                    z.extractall(part)
            else:
                with tarfile.open(path) as t:
                    t.extractall(part, filter="data")
            part.rename(target)
        path = target
    elif not path.exists():
        raise FileNotFoundError(path)
    kind, options = REGISTRY[doc["kind"]], doc.get("options", {})
    REGISTRY[doc["name"]] = lambda **more: kind(path=str(path), **options, **more)
    return doc["name"]


def from_nested(spark: SparkSession, train: dict, val: dict, test: dict, items: dict) -> tuple[DataFrame, DataFrame | None]:
    """(user_idx, item_idx, split) and item categories of the six-part nested form of a data set.

    train, val and test map users to lists of entries; an entry is an item number or a mapping with key productid (text or
    bytes). items maps numbers to mappings that may hold c, a one-hot category vector; its first largest place is the
    category, and if any item lacks it there are no categories.
    """
    plain = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else x
    number = lambda e: int(plain({plain(k): v for k, v in e.items()}["productid"])) if isinstance(e, dict) else int(e)
    rows = [(int(u), number(e), name) for name, part in (("train", train), ("val", val), ("test", test)) for u, es in part.items() for e in es]
    split = spark.createDataFrame(pd.DataFrame(rows, columns=["user_idx", "item_idx", "split"])).distinct()
    flat = {int(i): {plain(k): v for k, v in m.items()} for i, m in items.items()}
    if not flat or any("c" not in m for m in flat.values()):
        return split, None
    raw = spark.createDataFrame([(i, [float(x) for x in m["c"]]) for i, m in flat.items()], "item_idx long, c array<double>")
    return split, raw.select("item_idx", (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("category"))


def prepared(spark: SparkSession, src: Source, least: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user map, item map, splits) of a source: dense ids by first appearance and a leave-one-out split."""
    rows = src.interactions(spark)
    users, items = (ids.dense_ids(rows, c, "position") for c in ("user_id", "item_id"))
    loo = splits.leave_one_out(rows, "user_id", "item_id", "position", least, seed)
    mapped = loo.join(users.withColumnRenamed("idx", "user_idx"), "user_id").join(items.withColumnRenamed("idx", "item_idx"), "item_id")
    return users, items, mapped.select("user_idx", "item_idx", "split")


def discover(folder: str) -> list[str]:
    """Register every module of a folder that isn't private; a module that fails doesn't stop the rest. Returns what was loaded."""
    loaded = []
    for path in sorted(Path(folder).glob("*.py")):
        if path.stem.startswith(("_", ".")) or path.stem in REGISTRY:
            continue
        try:
            spec = importlib.util.spec_from_file_location(f"orrery_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            loaded.append(path.stem)
        except Exception as e:
            print(f"plugin {path.stem} was left out: {e}")
    return loaded
