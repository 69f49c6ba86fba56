"""Rows that fail to parse: bulk-parse blocks, bisect failing blocks, diagnose single records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One path segment, a whole path, its endings, a label. RE2 and Python read them alike.
SEGMENT = r"(?:\.{0,2}[A-Za-z0-9_-]|\.{3})[A-Za-z0-9_.-]*"
IMAGE_PATH = (rf"^(?:{SEGMENT}/)*{SEGMENT}$", r"\.(?:[jJ][pP][gG]|[jJ][pP][eE][gG]|[pP][nN][gG]|[wW][eE][bB][pP])$")
CATEGORY_LABEL = (r"^[0-9]{1,4}$",)
NOT_EMPTY = (r"(?s)^.",)
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'


@dataclass(frozen=True)
class Field:
    """A column of a delivery: every pattern must match; an optional field may also be the empty string."""

    name: str
    patterns: tuple[str, ...]
    optional: bool = False


#: The layouts of the deliveries, by file name.
LAYOUTS = {
    "interactions.csv": (Field("user_id", NOT_EMPTY), Field("item_id", NOT_EMPTY), Field("image_path", IMAGE_PATH, True)),
    "categories.csv": (Field("item_id", NOT_EMPTY), Field("category_label", CATEGORY_LABEL, True)),
}


def _ok(text: str, field: Field) -> bool:
    # Python's $ also matches before a final line feed, RE2's does not
    return (field.optional and text == "") or all(re.search(p.replace("$", r"\Z"), text) for p in field.patterns)


def diagnose(line: str | None, layout: tuple[Field, ...] | None) -> tuple[str | None, list[str] | None]:
    """(reason, None) of one bad record or (None, fields) of a valid one, read strictly by RFC 4180."""
    if line is None or layout is None:
        return "columns", None
    fields, at, end = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            held, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return "quoting", None
                held.append(line[at:close])
                at = close + 1
                if not line.startswith('"', at):
                    break
                held.append('"')
                at += 1
            if at < end and line[at] != ",":
                return "quoting", None
            fields.append("".join(held))
        else:
            stop = line.find(",", at)
            stop = end if stop < 0 else stop
            if '"' in line[at:stop]:
                return "quoting", None
            fields.append(line[at:stop])
            at = stop
        if at >= end:
            break
        at += 1
    if len(fields) != len(layout):
        # the quoting of the whole line was read above, so it has been judged before the count
        return "columns", None
    if not all(_ok(v, f) for v, f in zip(fields, layout)):
        return "value", None
    return None, fields


def _all_match(values: pa.Array, field: Field) -> bool:
    if field.optional:
        values = values.filter(pc.not_equal(values, ""))
    return all(pc.all(pc.match_substring_regex(values, p), min_count=0).as_py() for p in field.patterns)


def bulk_parse(lines: pa.Array, layout: tuple[Field, ...]) -> list[pa.Array] | None:
    """The columns of a block if every record of it is valid, else None.

    The block is read as one CSV text by Arrow's columnar reader. That reader forgives stray quotes and takes
    any line feed outside quotes for an end, so records that hold one must also match the grammar of a record, again over the whole column.
    """
    n, text = len(layout), "\n".join(["," * (len(layout) - 1), *lines.to_pylist(), ""]).encode("utf-8", "surrogatepass")
    try:
        got = pcsv.read_csv(
            pa.BufferReader(text),
            pcsv.ReadOptions(column_names=[f.name for f in layout], block_size=len(text) + 1, use_threads=False),
            pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=True),
            pcsv.ConvertOptions(column_types={f.name: pa.string() for f in layout}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows != len(lines) + 1:  # the first, empty record keeps a byte order mark part of the data
        return None
    quoted = lines.filter(pc.match_substring_regex(lines, r'["\r\n]'))
    if len(quoted) and not pc.all(pc.match_substring_regex(quoted, rf"^{_FIELD}(?:,{_FIELD}){{{n - 1}}}$")).as_py():
        return None
    columns = [got[f.name].slice(1).combine_chunks() for f in layout]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return columns if all(_all_match(c, f) for c, f in zip(columns, layout)) else None


def bisect(n: int, whole: Callable[[int, int], bool], single: Callable[[int], None], least: int = 8) -> None:
    """Call whole(lo, hi) on blocks; a block that fails is halved, and records of a small one go to single."""
    todo = [(0, n)] if n else []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= least:
            for i in range(lo, hi):
                single(i)
        elif not whole(lo, hi):
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]


def parse_records(df: DataFrame, rec_id: str, kind: str, line: str, layouts: dict[str, tuple[Field, ...]] = LAYOUTS, block: int = 4096) -> DataFrame:
    """Parse one CSV record per row; columns rec_id, kind, fields, reason.

    A valid row has its fields (the empty string of an optional field is null) and a null reason; any other
    has null fields and the first reason that holds: quoting, columns, value. A null line, and a line of
    an unknown or null kind, has reason columns; an empty line has one empty field. Repeated records are
    judged one by one. No shuffle; a task holds one Arrow batch at a time.
    """
    schema = T.StructType([T.StructField("rec_id", df.schema[rec_id].dataType), T.StructField("kind", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, lines = batch.column(0), pc.fill_null(batch.column(1).cast(pa.string()), ""), batch.column(2).cast(pa.string())
            for name in pc.unique(kinds).to_pylist():
                here = pc.and_(pc.equal(kinds, name), pc.is_valid(lines)) if name in layouts else pc.equal(kinds, name)
                rest = pc.and_(pc.equal(kinds, name), pc.is_null(lines)) if name in layouts else None
                yield from _blocks(ids.filter(here), name, lines.filter(here), layouts.get(name), block)
                if rest is not None and pc.any(rest).as_py():
                    yield _rows(ids.filter(rest), name, None, ["columns"] * pc.sum(rest).as_py())

    def _rows(ids: pa.Array, name: str, fields: list | None, reasons: list[str | None]) -> pa.RecordBatch:
        n = len(ids)
        kind = pa.array([name or None] * n, pa.string())
        return pa.RecordBatch.from_arrays([ids, kind, pa.array(fields or [None] * n, pa.list_(pa.string())), pa.array(reasons, pa.string())], ["rec_id", "kind", "fields", "reason"])

    def _blocks(ids: pa.Array, name: str, lines: pa.Array, layout: tuple[Field, ...] | None, size: int) -> Iterator[pa.RecordBatch]:
        if layout is None:
            if len(ids):
                yield _rows(ids, name, None, ["columns"] * len(ids))
            return
        for start in range(0, len(lines), size):
            own = lines.slice(start, size)
            fields: list = [None] * len(own)
            reasons: list[str | None] = [None] * len(own)

            def whole(lo: int, hi: int) -> bool:
                columns = bulk_parse(own.slice(lo, hi - lo), layout)
                if columns is None:
                    return False
                texts = [[v or None for v in c.to_pylist()] if f.optional else c.to_pylist() for c, f in zip(columns, layout)]
                fields[lo:hi] = [list(row) for row in zip(*texts)]
                return True

            def single(i: int) -> None:
                reason, got = diagnose(own[i].as_py(), layout)
                reasons[i] = reason
                fields[i] = got and [v or None if f.optional else v for v, f in zip(got, layout)]

            bisect(len(own), whole, single)
            yield _rows(ids.slice(start, size), name, fields, reasons)

    return df.select(rec_id, kind, line).mapInArrow(parse, schema)


def invalid_values(df: DataFrame, rec_id: str, column: str, patterns: tuple[str, ...]) -> DataFrame:
    """The rows of a loaded table whose non-null value is invalid, the empty string included; column rec_id, reason.

    Blocks are tested as a whole on the column and halved where they fail, as parse_records does with lines.
    """
    schema = T.StructType([T.StructField("rec_id", df.schema[rec_id].dataType), T.StructField("reason", T.StringType())])
    field = Field(column, patterns)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bad = batch.column(1).cast(pa.string()), []

            def single(i: int) -> None:
                if not _ok(values[i].as_py(), field):
                    bad.append(i)

            bisect(len(values), lambda lo, hi: _all_match(values.slice(lo, hi - lo), field), single)
            if bad:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad)), pa.array(["value"] * len(bad))], ["rec_id", "reason"])

    return df.select(rec_id, column).where(df[column].isNotNull()).mapInArrow(test, schema)
