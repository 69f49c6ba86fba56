"""Queries of problems 1 and 2, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import records, skew
from orrery.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every record that cannot be used, with its table and the reason."""
    raw = records.parse_records(table(spark, sf, "raw_lines"), "rec_id", "file_name", "line").where("reason is not null")
    paths = records.invalid_values(table(spark, sf, "interactions"), "row_id", "image_path", records.IMAGE_PATH)
    labels = records.invalid_values(table(spark, sf, "categories"), "row_id", "category_label", records.CATEGORY_LABEL)
    found = [df.select(F.lit(origin).alias("origin"), "rec_id", "reason") for origin, df in (("raw_lines", raw), ("interactions", paths), ("categories", labels))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _loaded(spark: SparkSession, sf: str, name: str) -> DataFrame:
    parsed = records.parse_records(table(spark, sf, "raw_lines"), "rec_id", "file_name", "line").where((F.col("reason").isNull()) & (F.col("kind") == name))
    return parsed.select("rec_id", *(F.col("fields")[i].alias(f.name) for i, f in enumerate(records.LAYOUTS[name])))


def p1_loaded_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """The valid rows of the later deliveries of interactions.csv."""
    return _loaded(spark, sf, "interactions.csv")


def p1_loaded_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The valid rows of the later deliveries of categories.csv."""
    return _loaded(spark, sf, "categories.csv")


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return skew.per_key_profile(table(spark, sf, "interactions"), "item_id", "user_id", "ts")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The few item_id and user_id values that hold half of the rows."""
    return skew.heavy_keys(_profile(spark, sf))


def p2_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct partners, first and last ts of every item_id and user_id."""
    return _profile(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded_interactions, p1_loaded_categories, p2_found, p2_per_key)}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_PATH_OK = rf"(regexp_full_match(v, '(?:{records.SEGMENT}/)*{records.SEGMENT}') and regexp_matches(lower(v), '\.(jpg|jpeg|png|webp)$'))"
_PARSED = rf"""
with judged as (
  select rec_id, file_name, line,
         regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') as quoted_well,
         length(regexp_replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 as n_fields,
         case file_name when 'interactions.csv' then 3 when 'categories.csv' then 2 end as n_wanted
  from raw_lines),
cut as (
  select *, case when quoted_well and n_fields = n_wanted then list_transform(
           regexp_extract_all(',' || line, '(?:,)({_FIELD})', 1),
           lambda x: case when x[1:1] = '"' then replace(x[2:-2], '""', '"') else x end) end as f
  from judged),
parsed as (
  select rec_id, file_name, f,
    case when line is null or n_wanted is null then 'columns'
         when not quoted_well then 'quoting'
         when n_fields <> n_wanted then 'columns'
         when f[1] = '' or (n_wanted = 3 and (f[2] = '' or (f[3] <> '' and not {_PATH_OK.replace('(v', '(f[3]')}))) then 'value'
         when n_wanted = 2 and f[2] <> '' and not regexp_full_match(f[2], '[0-9]{{1,4}}') then 'value' end as reason
  from cut)
"""

SQL = {
    "p1_found": _PARSED
    + rf"""
select 'raw_lines' as origin, rec_id, reason from parsed where reason is not null
union all select 'interactions', row_id, 'value' from (select row_id, image_path as v from interactions) where v is not null and not {_PATH_OK}
union all select 'categories', row_id, 'value' from categories where category_label is not null and not regexp_full_match(category_label, '[0-9]{{1,4}}')
""",
    "p1_loaded_interactions": _PARSED + "select rec_id, f[1] as user_id, f[2] as item_id, nullif(f[3], '') as image_path from parsed where reason is null and file_name = 'interactions.csv'",
    "p1_loaded_categories": _PARSED + "select rec_id, f[1] as item_id, nullif(f[2], '') as category_label from parsed where reason is null and file_name = 'categories.csv'",
    "p2_found": """
with counts as (
  select 'item_id' as field, item_id as key_value, count(*) as n from interactions where item_id is not null group by 2
  union all select 'user_id', user_id, count(*) from interactions where user_id is not null group by 2),
run as (
  select field, key_value, sum(n) over (partition by field) as total,
         coalesce(sum(n) over (partition by field order by n desc, key_value rows between unbounded preceding and 1 preceding), 0) as above
  from counts)
select field, key_value from run where above * 2 < total
""",
    "p2_per_key": """
select 'item_id' as field, item_id as key_value, count(*) as n_rows, count(distinct user_id) as n_distinct, min(ts) as first_ts, max(ts) as last_ts
from interactions where item_id is not null group by 2
union all
select 'user_id', user_id, count(*), count(distinct item_id), min(ts), max(ts) from interactions where user_id is not null group by 2
""",
}
