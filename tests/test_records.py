"""Problem 1: bad records are found with their reason, valid ones are loaded."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.operators import records as r

CASES = [
    ("interactions.csv", "u,i,images/a.jpg", None),
    ("interactions.csv", "u,i,", None),
    ("interactions.csv", '"u,1","i ""x""",a/b.PNG', None),
    ("interactions.csv", '"u\nv",i,a.webp', None),
    ("interactions.csv", 'u"x,i,a.jpg', "quoting"),
    ("interactions.csv", '"u,i,a.jpg', "quoting"),
    ("interactions.csv", '"u" ,i,a.jpg', "quoting"),
    ("interactions.csv", '"u"x,i', "quoting"),
    ("interactions.csv", "u,i", "columns"),
    ("interactions.csv", "u,i,a.jpg,", "columns"),
    ("interactions.csv", "", "columns"),
    ("interactions.csv", ",i,a.jpg", "value"),
    ("interactions.csv", "u,,a.jpg", "value"),
    ("interactions.csv", "u,i,../a.jpg", "value"),
    ("interactions.csv", "u,i,a//b.jpg", "value"),
    ("interactions.csv", "u,i,/a.jpg", "value"),
    ("interactions.csv", "u,i,a.gif", "value"),
    ("interactions.csv", "u,i,images/", "value"),
    ("interactions.csv", "u,i,.../.a.jpeg", None),
    ("interactions.csv", "﻿,i,a.jpg", None),
    ("categories.csv", "i,7", None),
    ("categories.csv", 'i,"0012"', None),
    ("categories.csv", "i,", None),
    ("categories.csv", "i,12345", "value"),
    ("categories.csv", "i,７", "value"),
    ("categories.csv", "i,7\n", "value"),
    ("categories.csv", "i,7,8", "columns"),
    ("other.csv", "i,7", "columns"),
    (None, "i,7", "columns"),
    ("categories.csv", None, "columns"),
]


@pytest.mark.parametrize(("kind", "line", "reason"), CASES)
def test_diagnose(kind, line, reason):
    assert r.diagnose(line, r.LAYOUTS.get(kind))[0] == reason


@pytest.mark.parametrize("repeat", [1, 40])
def test_blocks_agree_with_single_records(spark, repeat):
    rows = [(i * 100 + j, k, line, "extra") for j, (k, line, _) in enumerate(CASES) for i in range(repeat)]
    df = spark.createDataFrame(rows, "rec_id long, kind string, line string, reason string")
    got = {x["rec_id"]: x for x in r.parse_records(df, "rec_id", "kind", "line").collect()}
    assert len(got) == len(rows)
    for rec_id, kind, line, _ in rows:
        reason, fields = r.diagnose(line, r.LAYOUTS.get(kind))
        assert got[rec_id]["reason"] == reason
        if reason is None:
            assert [v or "" for v in got[rec_id]["fields"]] == fields


def test_empty(spark):
    df = spark.createDataFrame([], "rec_id long, kind string, line string")
    assert r.parse_records(df, "rec_id", "kind", "line").count() == 0
    assert r.invalid_values(df, "rec_id", "line", r.IMAGE_PATH).count() == 0


def test_values(spark):
    values = [None, "", "a.jpg", "a/../b.jpg", "a/./b.jpg", "a b.jpg", "x/y.JpEg", "a.jpg\n"] * 30
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, image_path string")
    got = {x["rec_id"] for x in r.invalid_values(df, "row_id", "image_path", r.IMAGE_PATH).collect()}
    assert got == {i for i, v in enumerate(values) if v is not None and v not in ("a.jpg", "x/y.JpEg")}


text = st.text(st.sampled_from('ab,"\n é'), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(text, min_size=2, max_size=2))
def test_written_by_the_csv_module(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    layout = (r.Field("a", (), True), r.Field("b", (), True))
    assert r.diagnose(out.getvalue(), layout) == (None, fields)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, min_size=1, max_size=12))
def test_bulk_is_never_more_lenient(lines):
    import pyarrow as pa

    layout = (r.Field("a", (), True), r.Field("b", (), True))
    got = r.bulk_parse(pa.array(lines, pa.string()), layout)
    if got is not None:
        for i, line in enumerate(lines):
            assert r.diagnose(line, layout) == (None, [c[i].as_py() for c in got])
