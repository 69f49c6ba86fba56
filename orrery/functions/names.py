"""Names of feature artifacts, configurations and cells, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The recommenders in the order of their priority, and the tokens of artifact names.
RECOMMENDERS = ("bpr", "vbpr", "vnpr", "deepstyle", "avbpr", "acf")
FINETUNED, COMPONENT, HYBRID = "_finetuned", "_comp", "hybrid_"


def is_finetuned(name: Column) -> Column:
    """Whether the marker stands anywhere in the name."""
    return name.contains(FINETUNED)


def is_component(name: Column) -> Column:
    """Whether the artifact holds spatial components."""
    return name.endswith(COMPONENT)


def parse_embedding_name(name: Column) -> Column:
    """struct(extractor, fusion, condition, embedding_dim); null for null."""
    bare = F.regexp_replace(name, r"_D[0-9]+$", "")
    dim = F.regexp_extract(name, r"_D([0-9]+)$", 1)
    fine = bare.endswith(FINETUNED)
    stem = F.when(fine, F.regexp_replace(bare, FINETUNED + "$", "")).otherwise(bare)
    hybrid, none = stem.startswith(HYBRID), name == "none"
    parsed = F.struct(
        F.when(none, "none").when(hybrid, "hybrid").otherwise(stem).alias("extractor"),
        F.when(none | ~hybrid, "none").otherwise(F.regexp_replace(stem, "^" + HYBRID, "")).alias("fusion"),
        F.when(none, "both").when(fine, "finetuned").otherwise("frozen").alias("condition"),
        F.when(~none & (dim != ""), dim.cast("int")).alias("embedding_dim"),
    )
    return F.when(name.isNotNull(), parsed)


def _prefixes(known: tuple[str, ...]) -> str:
    return "|".join(re.escape(k) for k in sorted(set(known), key=lambda k: (-len(k), k)))


def split_config(config: Column, known: tuple[str, ...] = RECOMMENDERS) -> Column:
    """struct(recommender, embedding_name): the longest known recommender that is a prefix wins; else unknown."""
    pattern = rf"^({_prefixes(known)})(?:_([\s\S]*))?$"
    model = F.regexp_extract(config, pattern, 1)
    rest = F.regexp_extract(config, pattern, 2)
    return F.when(
        config.isNotNull(),
        F.struct(F.when(model == "", "unknown").otherwise(model).alias("recommender"), F.when(model == "", config).when(config == model, "none").otherwise(rest).alias("embedding_name")),
    )


def embedding_kind(name: Column) -> Column:
    """none, fusion or backbone."""
    return F.when(name == "none", "none").when(name.startswith(HYBRID), "fusion").otherwise("backbone")


def backbone_base(name: Column) -> Column:
    """The name without component suffix and fine-tuning marker."""
    return F.replace(F.regexp_replace(name, COMPONENT + "$", ""), F.lit(FINETUNED), F.lit(""))


def condition_of(name: Column) -> Column:
    """finetuned or frozen."""
    return F.when(is_finetuned(name), "finetuned").otherwise("frozen")


def config_key(model: Column, embedding: Column) -> Column:
    """Identity of a configuration."""
    return F.concat_ws("_", model, embedding)


def safe_name(name: Column) -> Column:
    """A name that is safe in file systems: any run of other characters becomes one underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def cell_key(*parts: Column) -> Column:
    """Parts joined by two underscores."""
    return F.concat_ws("__", *parts)


def conditions_of(name: Column) -> Column:
    """The conditions a cell runs in, as an array: both for none, else its own."""
    return F.when(name == "none", F.array(F.lit("frozen"), F.lit("finetuned"))).otherwise(F.array(condition_of(name)))


def seed_of(document: Column, base: int) -> Column:
    """31-bit seed of a text: the first 15 hex digits of the MD5 of base and text, modulo 2^31."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{base}:"), document)), 1, 15), 16, 10).cast("long") % F.lit(2**31)).cast("long")


def provenance(df: DataFrame, **columns) -> DataFrame:
    """df with constant columns that say where its rows come from; a column that is there already is an error."""
    taken = sorted(set(columns) & set(df.columns))
    if taken:
        raise ValueError(f"the table has columns {taken} already")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def tagged_union(parts: dict[int, DataFrame], tag: str = "seed") -> DataFrame:
    """Tables of repeats as one, with their tag in a column; columns that some lack are null there."""
    out = None
    for value, df in parts.items():
        own = provenance(df, **{tag: value})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def run_key(*parts: Column) -> Column:
    """Name of a run: the MD5 text of its parts."""
    return F.md5(cell_key(*parts))


def plain_key(*parts) -> str:
    """cell_key of values."""
    return "__".join(map(str, parts))


def plain_name(name: str) -> str:
    """safe_name of a value."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name)
