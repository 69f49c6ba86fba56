"""Dense ids, interaction and category scans, and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.skew import ranked_within


def clean_interactions(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Rows with both ids; ids are strings from end to end."""
    return df.dropna(subset=[user, item]).withColumns({user: F.col(user).cast("string"), item: F.col(item).cast("string")})


def dense_ids(df: DataFrame, column: str, position: str, name: str = "idx") -> DataFrame:
    """Distinct non-null values numbered from 0 by their first position; no global sort in one task."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(position).alias("_first"))
    return ranked_within(first, None, ["_first", column], f"dense-{column}").select(column, (F.col("rank") - 1).alias(name))


def derived_labels(df: DataFrame, item: str, label: Column, least: int = 50) -> DataFrame:
    """item, category_label: labels of at least least items, numbered from 0 in label order."""
    labelled = df.select(F.col(item).alias("item"), label.alias("label")).where("label is not null and label <> ''")
    kept = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("label")
    codes = ranked_within(kept, None, ["label"], "labels").withColumn("category_label", (F.col("rank") - 1).cast("int")).drop("rank")
    return labelled.join(codes, "label").select(F.col("item").alias(item), "category_label")


def sidecar_categories(categories: DataFrame, items: DataFrame, order: str = "row_id") -> DataFrame:
    """item_id, category_label: valid labels of known items, the last row of an item wins, labels made contiguous."""
    valid = categories.where(F.col("item_id").isNotNull() & F.col("category_label").rlike(r"\A[0-9]{1,4}\z"))
    last = valid.groupBy("item_id").agg(F.max_by("category_label", order).cast("int").alias("label")).join(items, "item_id", "left_semi")
    labels = last.select("label").distinct()  # at most 10,000 labels of four digits
    codes = labels.withColumn("category_label", F.row_number().over(Window.orderBy("label")) - 1)
    return last.join(F.broadcast(codes), "label").select("item_id", "category_label")


def item_categories(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Every item with its label; items without one share an extra last label."""
    extra = labels.agg((F.coalesce(F.max("category_label"), F.lit(-1)) + 1).alias("extra"))
    return items.join(labels, "item_id", "left").crossJoin(F.broadcast(extra)).select(*items.columns, F.coalesce("category_label", "extra").alias("category"))


def path_label(paths: Column, level: int) -> Column:
    """Label at a depth of the first non-empty taxonomy path, or its deepest one; null without a path."""
    path = F.try_element_at(F.filter(paths, lambda p: F.size(p) > 0), F.lit(1))
    return F.try_element_at(path, F.least(F.lit(level + 1), F.size(path)))


def taxonomy_sidecar(items: DataFrame, item: str, paths: Column, level: int = 1, least: int = 50) -> DataFrame | None:
    """item, category_label derived from taxonomy paths where a data set has no labels of its own; None if no label has least items."""
    labels = derived_labels(items.select(item, path_label(paths, level).alias("_label")), item, F.col("_label"), least)
    return None if labels.isEmpty() else labels


def first_paths(df: DataFrame, item: str, path: str, order: str) -> DataFrame:
    """item and its first path by order; items without any keep null."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.min_by(path, F.when(F.col(path).isNotNull(), F.col(order))).alias(path))


def decoded(raw: Column) -> Column:
    """bytes as UTF-8 text, or as Latin-1 where that fails."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(raw, "ISO-8859-1"))


def contiguity(df: DataFrame, by: str, idx: str) -> DataFrame:
    """Per group: size, distinct and extreme ids, and whether they run from 0 without gaps."""
    agg = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(idx).alias("n_distinct"), F.min(idx).alias("least"), F.max(idx).alias("most"))
    return agg.withColumn("contiguous", (F.col("least") == 0) & (F.col("most") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")))


def out_of_range(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose index isn't in [0, n); an empty frame passes."""
    return df.where((F.col(column) < 0) | (F.col(column) >= n))


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df, or an error naming what differs."""
    if df.columns != wanted:
        raise ValueError(f"columns {df.columns} are not {wanted}")
    return df


def category_contract(labels: DataFrame, declared: int) -> None:
    """Raise unless the labels in use are exactly as many as declared."""
    used = labels.agg(F.countDistinct("category_label")).first()[0]
    if used != declared:
        raise ValueError(f"{declared} categories are declared, {used} are in use")
