"""Tables written to the shared folder of the cluster, to cut lineage or to read a result twice.

A staged table survives the loss of executors, unlike a cached or locally checkpointed one. The folder
is the session's ``spark.checkpoint.dir``; only where that is unset (tests, notebooks) a temporary
folder of the local machine is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[str] = []
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="orrery-"))
    return _fallback[0]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete every table staged by this process, once no result reads them any more."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop().rpartition("/")[0])
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def numbered(df: DataFrame, label: str, name: str = "code", limit: int = 2**31) -> DataFrame:
    """df with a distinct whole number below limit per row, close to dense, without any global sort.

    The rows are staged once with Spark's own (partition, position) number, which is then folded to
    position * partitions + partition. Raises if a number would reach the limit.
    """
    staged = stage(df.withColumn("_mid", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    most = staged.agg(F.max(part).alias("p"), F.max(place).alias("r")).first()
    parts = (most["p"] or 0) + 1
    if (most["r"] or 0) * parts + parts > limit:
        raise ValueError(f"{label}: more than {limit} numbers would be needed")
    return staged.withColumn(name, place * F.lit(parts) + part).drop("_mid")
