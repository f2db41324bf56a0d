"""Records that don't load: every way of failing, and the bulk path against the strict parser."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.operators.badrows import Field, _Loader, parse_records, split_strict

FIELDS = (Field("a"), Field("n", 10, 250, unknown=True), Field("m", 1, 5))
CASES = {
    'x,20,3': None, '"x",20,"3,5"': None, '"x ""y"", z",," 2 "': None, "x,0,2": None, "x,-0.0,+2": None, "x, ,2": None,
    'x,20,3\r': None, '"line\nbreak",20,3': None, "é,250,1": None, "x,10,5.0": None,
    'x y"z,20,3': "quoting", '"x"y,20,3': "quoting", '"x,20,3': "quoting", ' "x",20,3': "quoting", '"a,"b,20,3': "quoting",
    "x,20": "column_count", "": "column_count", " ": "column_count", "x,20,3,4": "column_count", "\r": "column_count",
    "x;20;3": "column_count", None: "column_count",
    "x,9,3": "bad_value", "x,251,3": "bad_value", "x,20,0": "bad_value", "x,20,": "bad_value", "x,2e1,3": "bad_value",
    "x,20,3\r\r": "bad_value", "x,1.0.0,3": "bad_value", "x,.5,3": "bad_value", "x,٢٠,3": "bad_value", "x,nan,3": "bad_value",
    "x,1'000,3": "bad_value", "x,20,5.01": "bad_value",
}


def test_reasons(spark):
    rows = [(i, raw, "kept") for i, raw in enumerate(CASES)] * 3
    df = spark.createDataFrame(rows, "id long, raw string, reason string")
    out = parse_records(df, "raw", FIELDS)
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.raw: r.reason for r in got} == CASES
    by = {r.raw: (r.a, r.n, r.m) for r in got}
    assert by['"x ""y"", z",," 2 "'] == ('x "y", z', None, 2.0)
    assert by['"x",20,"3,5"'] == ("x", 20.0, 3.5)
    assert by["x,9,3"] == (None, None, None)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "id long, raw string")
    assert parse_records(df, "raw", FIELDS).count() == 0
    long = '"' + "y" * 300_000 + '",20,3'
    df = spark.createDataFrame([(1, long)], "id long, raw string")
    row = parse_records(df, "raw", FIELDS).collect()[0]
    assert row.reason is None and len(row.a) == 300_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",x5 \n\r.é\ufeff', max_size=12), max_size=40))
def test_bulk_equals_strict(records):
    loader = _Loader(FIELDS, ",")
    _, reasons = loader.load(pa.array(records, pa.string()))
    for record, reason in zip(records, reasons.to_pylist(), strict=True):
        text = record[:-1] if record.endswith("\r") else record
        assert loader.strict(text)[1] == reason


def test_split():
    assert split_strict('a,"b,""c""",') == ["a", 'b,"c"', ""]
    assert split_strict('a"b') is None


def test_blocks_of_all_kinds_keep_their_order():
    records = [f"r{i},20,3" if i % 97 else f"r{i},20" for i in range(3000)] + [f'"r{i}",20,3' for i in range(3000, 9000)]
    columns, reasons = _Loader(FIELDS, ",").load(pa.array(records, pa.string()))
    assert [x or f"r{i}" for i, x in enumerate(columns[0].to_pylist())] == [f"r{i}" for i in range(9000)]
    assert [i for i, r in enumerate(reasons.to_pylist()) if r] == list(range(0, 3000, 97))
