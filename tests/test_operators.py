"""Shredding, inference, pass-through, policies, lowering and merges on awkward rows."""

import pytest
from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.functions import values as V
from millrace.operators import infer, lower, merge, passthrough, policy, shred
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark, *docs):
    return spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "line string, ordinal long")


def built(spark, *docs, **kw):
    df = lines(spark, *docs)
    resolved = infer.resolve(infer.observe(df), "root", **kw)
    return resolved, infer.build(df, resolved, "load-1")


def types_of(table):
    return {n: str(s) for _, n, s in table.columns}


def test_nested_json_becomes_tables(spark):
    resolved, t = built(spark, '{"id": 1, "tags": [{"a": 1}, null, {"a": 2, "deep": [{"x": "y"}]}], "p": {"z": 1.5}}', '{"id": 2, "tags": []}')
    assert set(t) == {"root", "root__tags", "root__tags__deep"}
    roots = {r.id: r for r in t["root"].collect()}
    tags = t["root__tags"].collect()
    assert sorted((r.a, r[N.POS]) for r in tags) == [(1, 0), (2, 2)]
    assert all(r[N.PARENT_ID] == r[N.ROOT_ID] == roots[1][N.ROW_ID] for r in tags)
    deep = t["root__tags__deep"].collect()
    assert [r.x for r in deep] == ["y"] and deep[0][N.ROOT_ID] == roots[1][N.ROW_ID] and deep[0][N.PARENT_ID] in {r[N.ROW_ID] for r in tags}
    assert roots[2].p is None and roots[1].p.z == 1.5


def test_kinds(spark):
    resolved, _ = built(spark, '{"a": 1, "b": 1, "c": {"x": 1}, "d": [1], "e": "2024-01-01T00:00:00Z", "f": [], "g": 9007199254740993, "h": [[1]], "i": [1, {"a": 1}], "j": null}', '{"a": 2.5, "b": "x", "c": 3, "d": ["s"], "e": "no", "g": 0.5}')
    assert types_of(resolved) == {"a": "float64", "b": "utf8", "c": "json", "d": "list<utf8>", "e": "utf8", "g": "utf8", "h": "json", "i": "json"}


def test_order_of_rows_does_not_change_types(spark):
    docs = ['{"a": 1}', '{"a": 0.5}', '{"a": 9007199254740993}', '{"b": [1]}', '{"b": {"x": 1}}']
    one, _ = built(spark, *docs)
    two, _ = built(spark, *reversed(docs))
    assert types_of(one) == types_of(two)


def test_list_of_scalars_as_child(spark):
    _, t = built(spark, '{"id": 1, "xs": [5, null, 7]}', native_lists=False)
    assert sorted((r.value, r[N.POS]) for r in t["root__xs"].collect()) == [(5, 0), (7, 2)]
    assert "xs" not in t["root"].columns


def test_hints_pin_and_misfits_are_counted(spark):
    _, t = built(spark, '{"d": "2024-01-01", "m": "1.25"}', '{"d": "x", "m": 1.5}', '{"d": {"no": 1}}', hints={"d": L.DATE, "m": L.decimal(5, 2)})
    rows = t["root"].collect()
    assert sorted(str(r.d) for r in rows) == ["2024-01-01", "None", "None"]
    assert sorted(r._misfits for r in rows) == [0, 1, 2]


def test_clashing_and_system_names(spark):
    resolved, t = built(spark, '{"user-name": 1, "user name": 2, "_sys_id": 3}')
    names = [n for _, n, _ in resolved.columns]
    assert names[0] == "user_name" and len(set(names)) == 3 and N.ROW_ID not in names
    assert t["root"].first()[N.ROW_ID] == V.content_id({"user-name": 1, "user name": 2, "_sys_id": 3})


def test_too_deep(spark):
    deep = '{"a":' * 70 + "1" + "}" * 70
    with pytest.raises(Exception, match="deep"):
        infer.observe(lines(spark, deep)).collect()


def test_nothing_to_shred(spark):
    resolved, t = built(spark)
    assert resolved.columns == [] and t["root"].count() == 0


def test_native_shred_ids_are_stable(spark):
    df = spark.createDataFrame([(1, [(1, "x"), None, (1, "x")])], "id int, items array<struct<b: int, a: string>>")
    t = shred.shred(df, "r", "l1", ["id"])
    again = shred.shred(df.repartition(3), "r", "l2", ["id"])
    ids = lambda d: sorted(r[N.ROW_ID] for r in d.collect())
    assert ids(t["r__items"]) == ids(again["r__items"]) and len(set(ids(t["r__items"]))) == 2
    assert sorted(r[N.POS] for r in t["r__items"].collect()) == [0, 2]
    assert shred.orphans(t["r__items"], t["r"]).count() == 0


def test_content_key_ignores_order_of_columns(spark):
    df = spark.createDataFrame([(1, "a", (1, 2))], "x int, y string, s struct<p: int, q: int>")
    other = df.select(F.struct(F.col("s.q"), F.col("s.p")).alias("s"), "y", "x")
    assert df.select(shred.content_key(df)).first()[0] == other.select(shred.content_key(other)).first()[0]


def test_exact_casts(spark):
    df = spark.createDataFrame([(1 << 53,), ((1 << 53) + 1,), (None,)], "v long")
    with pytest.raises(passthrough.InexactCast):
        passthrough.conform(df, T._parse_datatype_string("struct<v: double>"))
    assert passthrough.conform(df.where(F.col("v") != (1 << 53) + 1), T._parse_datatype_string("struct<v: double, w: string>")).count() == 1
    with pytest.raises(passthrough.InexactCast):
        passthrough.conform(spark.createDataFrame([((1,),)], "v struct<a: int>"), T._parse_datatype_string("struct<v: string>"))
    d = spark.createDataFrame([("1.25",)], "s string").select(F.col("s").cast("decimal(5,2)").alias("v"))
    with pytest.raises(passthrough.InexactCast):
        passthrough.conform(d, T._parse_datatype_string("struct<v: decimal(5,1)>"))


def test_policies(spark):
    known = T._parse_datatype_string("struct<id: bigint, v: bigint>")
    df = spark.createDataFrame([(1, "5", None), (2, "x", "n"), (3, None, "m")], "id long, v string, extra string")
    P, A = policy.Policy, policy.Action
    with pytest.raises(policy.ContractViolation):
        policy.govern(df, "t", known, P(A.FREEZE))
    g = policy.govern(df, "t", known, P(A.DISCARD_ROW))
    assert [r.id for r in g.rows.collect()] == [1] and g.discarded.first()["rows"] == 2 and g.rows.columns == ["id", "v"]
    g = policy.govern(df, "t", known, P(A.DISCARD_VALUE))
    assert sorted((r.id, r.v) for r in g.rows.collect() if r.v is not None) == [(1, 5)] and g.discarded.first()["values"] == 3
    mixed = P(A.EVOLVE, columns={("t", "v"): A.DISCARD_ROW, ("t", "extra"): A.DISCARD_VALUE})
    g = policy.govern(df, "t", known, mixed)
    assert sorted(r.id for r in g.rows.collect()) == [1, 3]
    assert (g.discarded.first()["rows"], g.discarded.first()["values"]) == (1, 1)
    assert P(A.EVOLVE, {"a": A.FREEZE}).action("a__b", None, ("a",)) is A.FREEZE
    assert policy.govern(df, "a__b", None, P(A.DISCARD_ROW), ("a",)).rows.count() == 0


def test_schema_versions(spark):
    one, two = (T._parse_datatype_string(s) for s in ("struct<a: int, b: string>", "struct<b: string, a: int>"))
    assert policy.schema_hash(one) == policy.schema_hash(one) != policy.schema_hash(two)
    assert [d.kind for d in policy.diff("t", None, one)] == ["create_table"] and policy.diff("t", one, one) == []


def test_lowering_keeps_names_apart(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "a__b int, a struct<b: int, c: struct<d: int>>")
    out = lower.lower(df, lower.Capabilities(structs=False))
    assert out.columns[0] == "a__b" and out.columns[2] == "a__c__d" and len(set(out.columns)) == 3
    assert tuple(out.first()) == (1, 2, 3)
    none = spark.createDataFrame([(None,)], "a struct<b: int>")
    assert tuple(lower.lower(none, lower.Capabilities(structs=False)).first()) == (None,)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", -1), (2, "b", -1)], "id int, v string, _arrival int")
    new = spark.createDataFrame([(2, "x", 0), (3, "c", 0), (2, "y", 1)], "id int, v string, _arrival int")
    assert sorted((r.id, r.v) for r in merge.merge_keyed(old, new, ["id"]).collect()) == [(1, "a"), (2, "y"), (3, "c")]
    with pytest.raises(merge.NullKey):
        merge.require_keys(spark.createDataFrame([(None, 1)], "id int, v int"), ["id"])
    with pytest.raises(merge.NullKey):
        merge.require_keys(new, ["missing"])
    assert merge.append(old, spark.createDataFrame([(9,)], "id int")).count() == 3


def test_a_record_without_items_loses_its_old_ones(spark):
    def load(rows, n):
        return shred.shred(spark.createDataFrame(rows, "id int, items array<struct<x: int>>"), "r", n, ["id"])

    out = merge.merge_subtree(load([(1, [(1,), (2,)]), (2, [(3,)])], "l1"), load([(1, [])], "l2"), "r")
    assert sorted(r.x for r in out["r__items"].collect()) == [3]
    assert out["r"].count() == 2
    out = merge.merge_subtree(load([(1, [(1,)])], "l1"), {"r": load([(1, [(5,)])], "l2")["r"]}, "r")
    assert out["r__items"].count() == 0


def test_of_two_versions_in_a_unit_the_last_counts(spark):
    def load(rows, at):
        t = shred.shred(spark.createDataFrame(rows, "id int, items array<struct<x: int>>"), "r", "l", ["id"])
        return {k: v.withColumn(merge.ARRIVAL, F.lit(at)) for k, v in t.items()}

    one, two = load([(1, [(1,)])], 0), load([(1, [(7,), (8,)])], 1)
    out = merge.merge_subtree({}, {k: one[k].unionByName(two[k]) for k in one}, "r")
    assert out["r"].count() == 1 and sorted(r.x for r in out["r__items"].collect()) == [7, 8]
