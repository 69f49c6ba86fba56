"""Frequency of every value: last-seen counters over hash-partitioned tokens ordered by record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])


def _combined(batches: Iterator[pa.RecordBatch], hold: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Equal (first, second) rows of a task's batches become one with their number, in bounded memory."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["first", "second"], use_threads=False).aggregate([([], "count_all")])
        yield from table.rename_columns(["first", "second", "n"]).to_batches()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= hold:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _changes(column: pa.Array) -> np.ndarray:
    """Per row but the first, whether it differs from the row before; nulls equal each other."""
    codes = column.dictionary_encode()
    codes = np.asarray(codes.indices.fill_null(-1))
    return codes[1:] != codes[:-1]


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, term, record, n) sorted by all three → (field, term, occurrences, records).

    Each term keeps its occurrences, its records and the record last seen, nothing per record; the three
    are carried from one batch to the next.
    """
    last: tuple | None = None  # field, term, record of the row before
    total = seen = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fields, terms, records, counts = batch.columns
        begin = (fields[0].as_py(), terms[0].as_py(), records[0].as_py())
        new_term, new_record = np.empty(n, bool), np.empty(n, bool)
        new_term[1:] = _changes(fields) | _changes(terms)
        new_record[1:] = new_term[1:] | _changes(records)
        new_term[0] = last is None or begin[:2] != last[:2]
        new_record[0] = new_term[0] or begin[2] != last[2]
        counted = (new_record & records.is_valid().to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.flatnonzero(new_term)
        sums = [np.add.reduceat(x, np.r_[0, starts[starts > 0]]) for x in (np.asarray(counts), counted)]
        if not new_term[0]:  # the first run goes on from the batch before
            sums[0][0] += total
            sums[1][0] += seen
        elif last is not None:
            yield _batch([last[0]], [last[1]], [total], [seen])
        heads = np.r_[0, starts[starts > 0]]
        if len(heads) > 1:
            done = pa.array(heads[:-1])
            yield _batch(fields.take(done), terms.take(done), sums[0][:-1], sums[1][:-1])
        total, seen = int(sums[0][-1]), int(sums[1][-1])
        last = (fields[n - 1].as_py(), terms[n - 1].as_py(), records[n - 1].as_py())
    if last is not None:
        yield _batch([last[0]], [last[1]], [total], [seen])


def _batch(fields, terms, occurrences, records) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fields, pa.int32()), pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["field", "term", "occurrences", "records"])


def term_frequencies(df: DataFrame, first: str, second: str, salt_rows: int = 4_000_000, least_salts: int = 16) -> DataFrame:
    """Occurrences and distinct partners of every value of two columns; field, term, occurrences, records.

    Tokens are (field, term, record): the record of a value is its partner in the row. Equal rows are combined
    in the task that reads them; tokens are hash-partitioned on (field, term, salt of the record), so that a
    term with a third of all rows is spread over its salts while any one record stays whole; each partition
    is sorted and read once with last-seen counters; the counters of a term's salts add up. The rows are counted first
    (which the file's metadata answers): one salt per salt_rows of them, at least least_salts, so that no salt of any term has more
    than about salt_rows rows, whatever its share.

    A null value is no term; a null partner is an occurrence without a record. Repeated rows count each.
    Values are compared byte for byte; the empty string is a value. An empty table gives no row.
    """
    salts = max(least_salts, -(-df.count() // salt_rows))
    pair = df.select(F.col(first).cast("string").alias("first"), F.col(second).cast("string").alias("second")).where("first is not null or second is not null")
    pair = pair.mapInArrow(_combined, "first string, second string, n long")
    side = lambda code, term, record: F.struct(F.lit(code).alias("field"), F.col(term).alias("term"), F.col(record).alias("record"))
    tokens = pair.select(F.explode(F.array(side(0, "first", "second"), side(1, "second", "first"))).alias("t"), "n").select("t.*", "n").where("term is not null")
    spread = tokens.repartition("field", "term", F.pmod(F.xxhash64("record"), F.lit(salts))).sortWithinPartitions("field", "term", "record")
    counted = spread.mapInArrow(_last_seen, "field int, term string, occurrences long, records long")
    name = F.when(F.col("field") == 0, first).otherwise(second).alias("field")
    return counted.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).select(name, "term", "occurrences", "records")


def marked_terms(df: DataFrame, first: str, second: str, rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """field, term, mark of the values that are too rare (fewer partners than rare_below) or too common (at
    least common_share of the rows whose field is not null); a value can be both and then has two rows."""
    totals = df.agg(F.count(first).alias("a"), F.count(second).alias("b")).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(x).alias("total")) for c, x in ((first, "a"), (second, "b"))))).alias("s")).select("s.*")
    marks = F.array_compact(F.array(F.when(F.col("records") < rare_below, "rare"), F.when(F.col("occurrences") / F.col("total") >= common_share, "common")))
    return term_frequencies(df, first, second).join(F.broadcast(totals), "field").select("field", "term", F.explode(marks).alias("mark"))
