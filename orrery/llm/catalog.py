"""Queries of the training-data problems 3 to 9, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import cooccurrence, frequency, leakage, neighbours, overlap, quality, tokenizer
from orrery.sources.tables import table


def _neighbours(spark: SparkSession, sf: str, least: float | None) -> DataFrame:
    vectors = neighbours.evaluated(table(spark, sf, "visual_embeddings"), table(spark, sf, "evaluation_long"))
    return neighbours.nearest(vectors, "embedding_name", "item_idx", "features", 10, least)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items of cosine at least 0.90, one among the other's 10 most similar."""
    pairs = neighbours.similar_pairs(_neighbours(spark, sf, 0.90))
    return pairs.select(F.col("name").alias("embedding_name"), F.col("item_a").alias("item_idx_a"), F.col("item_b").alias("item_idx_b"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar other items of every vector."""
    return _neighbours(spark, sf, None).select(F.col("name").alias("embedding_name"), F.col("item").alias("item_idx"), F.col("other").alias("neighbour_idx"), "cosine", "rank")


def p3_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar other items, by brute force over all rows, of the items divisible by 100."""
    vectors = neighbours.evaluated(table(spark, sf, "visual_embeddings"), table(spark, sf, "evaluation_long"))
    found = neighbours.exact_nearest(vectors, "embedding_name", "item_idx", "features")
    return found.select(F.col("name").alias("embedding_name"), F.col("item").alias("item_idx"), F.col("other").alias("neighbour_idx"), F.round("cosine", 6).alias("cosine"))


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of p3_neighbours per embedding name, against brute force, over the items divisible by 100."""
    want = p3_exact(spark, sf).select("embedding_name", "item_idx", "neighbour_idx")
    got = p3_neighbours(spark, sf).where(F.col("item_idx") % 100 == 0).select("embedding_name", "item_idx", "neighbour_idx", F.lit(1).alias("found"))
    both = want.join(got, ["embedding_name", "item_idx", "neighbour_idx"], "left")
    return both.groupBy("embedding_name").agg(F.count(F.lit(1)).alias("n_neighbours"), (F.count("found") / F.count(F.lit(1))).alias("recall"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Heldout profiles that stand in train too, wholly or nearly."""
    return overlap.split_overlaps(table(spark, sf, "train"), table(spark, sf, "heldout")).select("split", "source", "train_user_idx", "user_idx")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps per split, source and kind."""
    return overlap.overlap_report(table(spark, sf, "train"), table(spark, sf, "heldout"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Item pairs shared by at least 8 users and at least 5 times as often as by chance."""
    return cooccurrence.item_pairs(table(spark, sf, "interactions"), "user_id", "item_id", 8, 5).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every item pair shared by at least 8 users, with lift and continuity-corrected odds ratio."""
    return cooccurrence.item_pairs(table(spark, sf, "interactions"), "user_id", "item_id", 8)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of user_id and item_id that are too rare or too common."""
    return frequency.marked_terms(table(spark, sf, "interactions"), "user_id", "item_id")


def p6_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and distinct partners of every user_id and item_id."""
    return frequency.term_frequencies(table(spark, sf, "interactions"), "user_id", "item_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k."""
    return tokenizer.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaking_documents(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "eval_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share eight consecutive words with an evaluation item."""
    return _leaks(spark, sf).where("kind = 'passage'").select("eval_id", "doc_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Passages and paraphrases of evaluation items in documents, with their measures."""
    return _leaks(spark, sf)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are not prose."""
    return quality.junk_texts(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "common_words")).select("doc_id")


def p9_prose(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with its signs and the calibrated probability that it is not prose."""
    return quality.judged_texts(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "common_words")).select("doc_id", "n_signs", "p_junk")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality statistics of every text."""
    return quality.text_statistics(table(spark, sf, "documents"), "doc_id", "text", quality.common_set(table(spark, sf, "common_words")))


QUERIES = {f.__name__: f for f in (p3_found, p3_neighbours, p3_exact, p3_recall, p4_found, p4_report, p5_found, p5_pairs, p6_found, p6_frequencies, p7_ids, p8_found, p8_leaks, p9_found, p9_prose, p9_statistics)}

_PAIRS = """
with b as (select distinct user_id, item_id from interactions where user_id is not null and item_id is not null),
c as (select item_id, count(*) as n from b group by 1),
t as (select count(distinct user_id) as total from b),
p as (select x.item_id as item_a, y.item_id as item_b, count(*) as n_ab from b x join b y on x.user_id = y.user_id and x.item_id < y.item_id group by 1, 2 having count(*) >= 8),
r as (select item_a, item_b, ca.n as n_a, cb.n as n_b, n_ab, total from p join c ca on ca.item_id = item_a join c cb on cb.item_id = item_b cross join t)
"""
_TERMS = """
with f as (
  select 'user_id' as field, user_id as term, count(*) as occurrences, count(distinct item_id) as records from interactions where user_id is not null group by 2
  union all
  select 'item_id', item_id, count(*), count(distinct user_id) from interactions where item_id is not null group by 2)
"""

_NEIGHBOURS = """
with v as (
  select distinct embedding_name, item_idx, list_transform(features, lambda x: x::double) as f from visual_embeddings
  where embedding_name in (select embedding_name from evaluation_long) and item_idx is not null and features is not null
    and len(features) = try_cast(regexp_extract(embedding_name, '_(?:D|pcaD)([0-9]+)$', 1) as int)
    and len(list_filter(features, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(features, lambda x: x <> 0)) > 0),
c as (select a.embedding_name, a.item_idx as item, b.item_idx as other, list_cosine_similarity(a.f, b.f) as cosine
      from v a join v b on a.embedding_name = b.embedding_name and a.item_idx <> b.item_idx),
r as (select *, row_number() over (partition by embedding_name, item order by cosine desc, other) as rank from c)
"""
_OVERLAPS = """
with t as (select distinct user_idx, item_idx from train where user_idx is not null and item_idx is not null),
h as (select split, user_idx, item_idx, min(source) as source from heldout where split is not null and user_idx is not null and item_idx is not null group by 1, 2, 3),
tn as (select user_idx, count(*) as n from t group by 1),
hn as (select split, user_idx, count(*) as n, min(source) as source from h group by 1, 2),
s as (select split, t.user_idx as tu, h.user_idx as hu, count(*) as shared from t join h using (item_idx) group by 1, 2, 3),
cases as (
  select s.split, hn.source, tu as train_user_idx, hu as user_idx, case when tu = hu then 'same' else 'near' end as kind
  from s join tn on tn.user_idx = tu join hn on hn.split = s.split and hn.user_idx = hu
  where tu = hu or (tu < hu and tn.n >= 6 and hn.n >= 6 and shared * 10 >= 7 * (tn.n + hn.n - shared)))
"""
_WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_QUALITY = rf"""
with w as (
  select doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') as words,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')), lambda x: x <> '') as lines,
         regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') as solid
  from documents),
s as (
  select doc_id, len(words) as n_words, len(lines) as n_lines,
    length(solid)::double / nullif(len(words), 0) as mean_word_length,
    length(regexp_replace(solid, '[\pL\pM\pN]', '', 'g'))::double / nullif(length(solid), 0) as symbol_share,
    len(list_filter(lines, lambda x: x[-1:] in ('.', '!', '?', '…', '。', ';', ':', '"', '»', '”', ')')))::double / nullif(len(lines), 0) as line_end_share,
    len(list_filter(words, lambda x: list_contains(c.common, lower(regexp_replace(regexp_replace(x, '^[^\pL\pN]+', ''), '[^\pL\pN]+$', '')))))::double / nullif(len(words), 0) as common_share
  from w cross join (select list(distinct lower(word)) as common from common_words) c),
q as (
  select *, case when n_words > 0 then (symbol_share > 0.20::double)::bigint + (line_end_share < 0.40::double)::bigint + (common_share < 0.10::double)::bigint + (mean_word_length > 12 or mean_word_length < 2.5::double)::bigint end as n_signs from s)
"""

SQL = {
    "p3_found": _NEIGHBOURS + "select distinct embedding_name, least(item, other) as item_idx_a, greatest(item, other) as item_idx_b from r where rank <= 10 and cosine >= 0.90::double",
    "p3_exact": _NEIGHBOURS.replace("a.item_idx <> b.item_idx)", "a.item_idx <> b.item_idx where a.item_idx % 100 = 0)") + "select embedding_name, item as item_idx, other as neighbour_idx, round(max(cosine), 6) as cosine from r where rank <= 10 group by 1, 2, 3",
    "p4_found": _OVERLAPS + "select split, source, train_user_idx, user_idx from cases",
    "p4_report": _OVERLAPS + "select split, source, kind, count(*) as n_cases, count(distinct user_idx) as n_users, count(distinct train_user_idx) as n_train_users from cases group by 1, 2, 3",
    "p9_found": _QUALITY + "select doc_id from q where n_signs >= 2",
    "p9_statistics": _QUALITY + "select doc_id, n_words, mean_word_length, symbol_share, line_end_share, common_share, n_lines, n_signs from q",
    "p5_found": _PAIRS + "select item_a, item_b from r where n_ab * total >= 5 * n_a * n_b",
    "p5_pairs": _PAIRS
    + """select item_a, item_b, n_a, n_b, n_ab, n_ab * total::double / (n_a * n_b) as lift,
    (n_ab + 0.5::double) * (total - n_a - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)) as odds_ratio from r""",
    "p6_found": _TERMS
    + """, t as (select field, sum(occurrences) as total from f group by 1)
select field, term, 'rare' as mark from f where records < 3
union all select field, term, 'common' from f join t using (field) where occurrences * 50 >= total""",
    "p6_frequencies": _TERMS + "select * from f",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name → callable of (spark, folder)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name → DuckDB SQL over the same tables."""
    return dict(SQL)
