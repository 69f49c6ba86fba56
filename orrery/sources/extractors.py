"""Feature extraction from files: a model is loaded once per worker and applied to batches of their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name → (factory of a function from a list of bytes to a matrix, dimension). The factory runs in the worker, so that
#: libraries and weights are only needed there.
EXTRACTORS: dict[str, tuple[Callable[[], Callable[[list[bytes]], np.ndarray]], int]] = {}


def register_extractor(name: str, dim: int):
    """Decorator that makes a factory known by name."""

    def add(factory):
        EXTRACTORS[name] = (factory, dim)
        return factory

    return add


@register_extractor("byte_histogram", 256)
def byte_histogram():
    """Shares of the 256 byte values: needs no weights and serves as a stand-in and a test."""

    def apply(files: list[bytes]) -> np.ndarray:
        return np.stack([np.bincount(np.frombuffer(f, np.uint8), minlength=256) / max(1, len(f)) for f in files])

    return apply


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """file_id (name without folder and ending) and content of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file_id"), "content")


def extracted(files: DataFrame, items: DataFrame, name: str, batch: int = 64) -> DataFrame:
    """item_idx, features of the items (file_id, item_idx) that have a file; items without one are left out.

    Empty files count as none, as the file source skips them; an unknown name, or a matrix of another dimension, is an error.
    """
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name}; known: {', '.join(sorted(EXTRACTORS))}")
    factory, dim = EXTRACTORS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                x = np.asarray(model(part.column(1).to_pylist()), np.float32)
                if x.shape != (part.num_rows, dim):
                    raise ValueError(f"{name} gave {x.shape}, {(part.num_rows, dim)} is declared")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["item_idx", "features"])

    return files.join(items, "file_id").select("item_idx", "content").mapInArrow(run, "item_idx long, features array<float>")
