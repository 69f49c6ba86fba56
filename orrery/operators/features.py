"""Feature tables: gates, alignment of sources and train-only principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors


def feature_gate(df: DataFrame, by: str, features: str, dim: Column, least_norm: float = 1e-8) -> DataFrame:
    """Per feature table: rows, and rows that are null, of a wrong length, not finite or near zero; norm statistics of the rest.

    std is that of the whole population. A table passes if the four counts are 0.
    """
    v = F.col(features)
    bad_dim = v.isNotNull() & (~F.coalesce(F.size(v) == dim, F.lit(False)))
    odd = v.isNotNull() & ~bad_dim & ~vectors.finite(v)
    good = v.isNotNull() & ~bad_dim & ~odd
    n = F.when(good, vectors.norm(F.transform(v, lambda x: x.cast("double"))))
    rows = df.select(by, v.isNull().alias("null_row"), bad_dim.alias("bad_dim"), odd.alias("odd"), n.alias("norm"))
    fine = F.when(F.col("norm") >= least_norm, F.col("norm"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("null_row").alias("n_null"), F.count_if("bad_dim").alias("n_bad_dim"), F.count_if("odd").alias("n_not_finite"),
        F.count_if(F.col("norm") < least_norm).alias("n_zero"), F.avg(fine).alias("norm_mean"), F.stddev_pop(fine).alias("norm_std"), F.min(fine).alias("norm_min"), F.max(fine).alias("norm_max"),
    )


def component_gate(df: DataFrame, features: str, components: int, dim: int) -> DataFrame:
    """Gate of component features (array of arrays): rows of a wrong shape or with a number that is not finite."""
    v = F.col(features)
    shaped = v.isNotNull() & (F.size(v) == components) & F.forall(v, lambda c: c.isNotNull() & (F.size(c) == dim))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(shaped, F.lit(False))).alias("n_bad_shape"), F.count_if(F.coalesce(shaped, F.lit(False)) & ~F.forall(v, vectors.finite)).alias("n_not_finite"))


def aligned_sources(df: DataFrame, name: str, item: str, features: str, sources: dict[str, int]) -> DataFrame:
    """item and one column s0, s1, … per source: valid vectors of items that every source has, joined on the item.

    Repeated rows of an item count once (the least vector); rows that are null, of another length or not finite are left out.
    """
    out = None
    for i, (source, dim) in enumerate(sources.items()):
        own = df.where(F.col(name) == source).where((F.size(features) == dim) & vectors.finite(F.col(features)) & F.col(item).isNotNull())
        own = own.groupBy(item).agg(F.min(features).alias(f"s{i}"))
        out = own if out is None else out.join(own, item)
    return out


class TrainPca:
    """Principal components fitted on train rows only and applied, centred, to all rows; none from fewer than two rows."""

    def __init__(self, df: DataFrame, features: str, train: DataFrame | None, key: str, components: int, all_rows: bool = False) -> None:
        """train holds the keys of train rows; without it all_rows must be set on purpose."""
        if train is None and not all_rows:
            raise ValueError("principal components need the train rows; set all_rows to fit on every row")
        rows = df if train is None else df.join(train.select(key).distinct(), key, "left_semi")
        own = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("v"))
        n = own.count()
        self.components, self.explained, self.model = 0, [], None
        if n < 2:
            return
        self.mean = own.agg(Summarizer.mean(F.col("v")).alias("mean")).first()["mean"].toArray()
        self.components = min(components, n, len(self.mean))
        self.model = PCA(k=self.components, inputCol="v", outputCol="pc").fit(own)  # the covariance is summed in the JVM, tree-wise
        self.explained = self.model.explainedVariance.toArray()

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """df with the projected column; an empty array where nothing could be fitted."""
        if self.model is None:
            return df.withColumn(out, F.array().cast("array<double>"))
        held = df.withColumn("v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
        shift = F.array(*(F.lit(float(x)) for x in self.mean @ self.model.pc.toArray()))
        return self.model.transform(held).withColumn(out, F.zip_with(vector_to_array("pc"), shift, lambda a, b: a - b)).drop("v", "pc")


def pca_fused(df: DataFrame, item: str, sources: list[str], train: DataFrame, components: int, per_source: bool = False) -> DataFrame:
    """item, features: joint components of the concatenation, or the concatenation of each source's components."""
    unit = df.select(item, *(vectors.l2_normalize(F.col(s)).alias(s) for s in sources))
    if per_source:
        for s in sources:
            unit = TrainPca(unit, s, train, item, components).transform(unit, s, f"{s}_pc")
        return unit.select(item, F.concat(*(f"{s}_pc" for s in sources)).alias("features"))
    joint = unit.select(item, F.concat(*sources).alias("all"))
    return TrainPca(joint, "all", train, item, components).transform(joint, "all", "features").select(item, "features")


def pca_aligned(df: DataFrame, item: str, sources: list[str], train: DataFrame, components: int, strategy: str, **options) -> DataFrame:
    """item, features: each source brought to components by its own train-only fit, then fused by an element-wise strategy."""
    rows = df.select(item, *sources)
    for s in sources:
        rows = TrainPca(rows, s, train, item, components).transform(rows, s, f"{s}_pc")
    return rows.select(item, vectors.fuse(strategy, [F.col(f"{s}_pc") for s in sources], **options).alias("features"))
