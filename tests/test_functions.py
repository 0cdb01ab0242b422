"""Laws of the lattice, names, renderings and identities."""

import datetime as dt
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.functions import columns as C
from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.functions import values as V
from pyspark.sql import functions as F
from pyspark.sql import types as T

decimals = st.integers(1, 38).flatmap(lambda p: st.integers(0, p).map(lambda s: L.decimal(p, s)))
logical = st.one_of(st.sampled_from(L.SCALARS), decimals)
leaves = st.one_of(st.none(), st.booleans(), st.integers(-(1 << 63), (1 << 64) - 1), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8))
documents = st.recursive(leaves, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.text(max_size=4), c, max_size=3)), max_leaves=10)


@given(logical, logical)
def test_join_is_commutative_and_idempotent(a, b):
    assert L.widen(a, b) == L.widen(b, a) and L.widen(a, a) == a


@given(logical, logical)
def test_join_is_an_upper_bound(a, b):
    j = L.widen(a, b)
    assert L.widen(j, a) == j and L.widen(j, b) == j


@given(st.sampled_from(L.SCALARS), st.sampled_from(L.SCALARS), st.sampled_from(L.SCALARS))
def test_join_is_associative(a, b, c):
    assert L.widen(L.widen(a, b), c) == L.widen(a, L.widen(b, c))


@given(logical)
def test_json_is_the_top(a):
    assert L.widen(a, L.JSON) == L.JSON


def test_joins_of_numbers():
    assert L.widen(L.INT, L.FLOAT) == L.FLOAT
    assert L.widen(L.INT, L.decimal(10, 2)) == L.decimal(21, 2)
    assert L.widen(L.FLOAT, L.decimal(5, 2)) == L.TEXT
    assert L.widen(L.decimal(38, 0), L.decimal(38, 38)) == L.TEXT
    assert L.widen(L.BINARY, L.INT) == L.JSON
    assert L.widen(L.DATE, L.INSTANT) == L.TEXT


def test_shapes(spark):
    s = lambda text: L.shape_of_spark(T._parse_datatype_string(text))
    assert str(L.join_shapes(s("struct<a: int>"), s("struct<b: string, a: double>"))) == "struct<a: float64, b: utf8>"
    assert L.join_shapes(s("array<int>"), s("int")).scalar == L.JSON
    for bad in ("map<string,int>", "array<array<int>>", "array<struct<a:int>>", "interval day"):
        with pytest.raises(TypeError):
            s(bad)


@given(st.text(), st.integers(1, 80))
def test_names_are_safe_and_bounded(source, bound):
    name = N.normalize_ident(source, bound)
    assert 1 <= len(name) <= max(bound, 1)
    assert not name[0].isdigit() and all(c.isascii() and (c.islower() or c.isdigit() or c == "_") for c in name)


@given(st.lists(st.text(max_size=6), unique=True, max_size=12))
def test_names_of_different_fields_differ(sources):
    namer = N.UniqueNamer(20)
    names = [namer.name_for(s) for s in sources]
    assert len(set(names)) == len(names) and names == [namer.name_for(s) for s in sources]
    assert not set(names) & set(N.SYSTEM)


def test_first_owner_keeps_the_plain_name():
    namer = N.UniqueNamer()
    assert namer.name_for("user-name") == "user_name"
    assert namer.name_for("user name").startswith("user_name_")
    assert namer.name_for("_sys_id") != "_sys_id"
    assert N.child_table_name("a", "B c") == "a__b_c"


def test_name_column_equals_function(spark):
    names = ["", "Ab-c", "9x", "É", "a" * 70, "x y z", "_ok", "ÄÖ" * 40]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", N.normalize_ident_column(F.col("s"), 20).alias("n")).collect()
    assert {r.s: r.n for r in rows} == {n: N.normalize_ident(n, 20) for n in names}


@pytest.mark.parametrize(("v", "plain", "written"), [(1.0, "1", "1.0"), (1e16, "10000000000000000", "1e16"), (0.1, "0.1", "0.1"), (-0.0, "-0", "-0.0"), (1e300, "1" + "0" * 300, "1e300"), (1.5e-7, "0.00000015", "1.5e-7")])
def test_two_texts_of_floats(v, plain, written):
    assert V.render_scalar(v) == plain and V.canonical_json(v) == written


@given(documents)
@settings(max_examples=200)
def test_written_json_reads_back(v):
    assert list(V.documents(V.compact_json({"v": v}))) == [{"v": v}]


@given(st.dictionaries(st.text(max_size=4), leaves, min_size=2, max_size=5))
def test_content_id_ignores_the_order_of_keys(row):
    assert V.content_id(row) == V.content_id(dict(reversed(list(row.items()))))


def test_identities():
    assert V.keyed_id({"a": 1, "b": 2}, ["a"]) == V.keyed_id({"a": "1", "b": 3}, ["a"]) == V.keyed_id({"a": 1.0}, ["a"])
    assert V.keyed_id({"a": None}, ["a"]) == V.keyed_id({}, ["a"]) == V.keyed_id({"a": {"x": 1}}, ["a"]) == V.keyed_id({"a": []}, ["a"])
    assert V.keyed_id({"a": ""}, ["a"]) != V.keyed_id({}, ["a"])
    assert V.keyed_id({"a": "bc"}, ["a"]) != V.keyed_id({"a": "b", "c": ""}, ["a", "c"])
    p = V.content_id({"x": 1})
    assert V.child_id(p, 0, {"y": 1}) != V.child_id(p, 1, {"y": 1})
    assert V.content_id({"x": 1}) != V.content_id({"x": 1.0}) and V.content_id({"x": None}) != V.content_id({})


def test_documents():
    assert list(V.documents("")) == []
    assert list(V.documents('[{"a": 1}, 2]')) == [{"a": 1}, 2]
    assert list(V.documents('{"a": 1} {"a": 2}\n3')) == [{"a": 1}, {"a": 2}, 3]
    assert list(V.documents('{"a": 1, "b": 2, "a": 3}')) == [{"a": 3, "b": 2}]
    assert V.as_row(5) == {"value": 5}
    with pytest.raises(ValueError):
        list(V.documents('{"a": NaN}'))


@pytest.mark.parametrize("v", ["12.34", " 12.3 ", "-5", ".5", "5.", 7, -7, "0012.10"])
def test_exact_decimals(v):
    assert V.parse_decimal(v, 6, 2) == decimal.Decimal(str(v).strip())


@pytest.mark.parametrize("v", ["12.345", "1e3", 1.5, "", ".", "-", "123456.7", 1 << 63, True, None, "١"])
def test_refused_decimals(v):
    assert V.parse_decimal(v, 6, 2) is None


INSTANTS = {"2024-02-29T12:00:00Z": True, "2024-02-29t12:00:00.5+01:30": True, "2023-02-29T12:00:00Z": False, "2024-01-01": False, "2024-01-01T00:00:00": False, "2024-1-01T00:00:00Z": False, "2024-01-01T24:00:00Z": False, "2024-01-01T00:00:00+25:00": False}


def test_instants(spark):
    for text, good in INSTANTS.items():
        assert (V.parse_instant(text) is not None) == good, text
    rows = spark.createDataFrame([(t,) for t in INSTANTS], "s string").select("s", C.is_instant(F.col("s")).alias("ok")).collect()
    assert {r.s: bool(r.ok) for r in rows} == INSTANTS
    assert V.exact_instant("2024-01-01T00:00:00.1234567Z") is None
    assert V.fit("2024-01-01T01:00:00+01:00", L.INSTANT) == dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_columns_parse_like_functions(spark):
    texts = ["2024-01-02", "2024-1-2", "2024-02-30", "12:30:01", "12:30:01.25", "25:00:00", "12.34", "12.345", "1e2", "-3", "", None, "2024-01-02T03:04:05", "2024-01-02T03:04:05.1234567", ".5", "99999.99"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", C.to_date(F.col("s")).alias("d"), C.to_time(F.col("s")).alias("t"), C.to_datetime(F.col("s")).alias("n"), C.to_decimal(F.col("s"), 6, 2).alias("c")).collect()
    for r in rows:
        assert (r.d, r.t, r.n, r.c) == (V.fit(r.s, L.DATE), V.fit(r.s, L.TIME), V.fit(r.s, L.DATETIME), V.fit(r.s, L.decimal(6, 2))), r


def test_fit_and_admits(spark):
    assert V.fit(5, L.BINARY) is None and V.fit("x", L.INT) is None and V.fit(2**53 + 1, L.FLOAT) is None
    assert V.fit(True, L.TEXT) == "true" and V.fit({"b": 1, "a": [1.0]}, L.JSON) == '{"b":1,"a":[1.0]}'
    assert V.admits(2**53, L.FLOAT) and not V.admits(2**53 + 1, L.FLOAT) and not V.admits(1.5, L.INT)
    shape = L.shape_of_spark(T._parse_datatype_string("struct<a: bigint, b: array<string>>"))
    assert V.admits_shape({"a": 1, "b": ["x", None], "c": None}, shape)
    assert not V.admits_shape({"c": 1}, shape) and not V.admits_shape({"b": [["x"]]}, shape)
