"""Queries over scans, sinks, shredding, inference, identities and typed pass-through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import columns as C
from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.operators import infer, lower, passthrough, policy, shred
from millrace.plans.catalog import nested_orders, query, table
from millrace.session import shared_folder
from millrace.sources.files import TypedFiles, json_lines
from millrace.sources.store import JsonParts, Unit

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_ITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_ITEMS = ", ".join(_ITEM)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line: F.Column, ordinal: str) -> DataFrame:
    return df.select(line.alias("line"), F.col(ordinal).cast("long").alias("ordinal"))


def _built(lines: DataFrame, name: str = "root", hints: dict | None = None, native_lists: bool = True) -> dict[str, DataFrame]:
    return infer.build(lines, infer.resolve(infer.observe(lines), name, hints, native_lists), "load-1")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ scans and sinks


@query("scan_parquet", _ORDERS)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TypedFiles({"orders": f"{sf_dir}/orders.parquet"})
    return next(source.read(spark, source.streams(spark)[0], None)).rows


@query("scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "nation").write.csv(path, header=True)
    source = TypedFiles({"nation": path}, "csv", schemas={"nation": "n_nationkey int, n_name string, n_regionkey int"}, header="true")
    return next(source.read(spark, source.streams(spark)[0], None)).rows


@query("scan_jsonl", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "nation").write.json(path)
    return _built(json_lines(spark, path), "nation")["nation"].select("n_nationkey", "n_name", "n_regionkey")


@query("sink_parquet_roundtrip", _ORDERS)
def sink_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "orders").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query("sink_jsonl_roundtrip", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def sink_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = JsonParts(_folder(spark).removeprefix("file:"))
    sink.check(spark)
    unit = Unit("load-1", 0, {"region": table(spark, sf_dir, "region")}, "region")
    sink.commit(spark, "p", unit)
    sink.commit(spark, "p", unit)
    return sink.read(spark, "region").select("r_regionkey", "r_name")


@query("parse_array_roots", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def parse_array_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("doc"))
    return _built(_lines(docs, F.col("doc"), "n_regionkey"), "nation")["nation"].select("n_nationkey", "n_name")


@query("parse_bare_roots", "SELECT n_nationkey::BIGINT AS value FROM nation")
def parse_bare_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), "n_nationkey")
    return _built(lines)["root"].select("value")


# ------------------------------------------------------------------------ shredding


@query("shred_root", _ORDERS)
def shred_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])["orders"].drop(N.LOAD_ID, N.ROW_ID)


@query("shred_child", f"SELECT {_ITEMS} FROM lineitem")
def shred_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])["orders__items"].select(*_ITEM)


@query("child_parent_join", "SELECT o_orderstatus, count(*)::BIGINT AS n_items, sum(l_linenumber)::BIGINT AS numbers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def child_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])
    both = shred.reassemble(t["orders"], t["orders__items"])
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n_items"), F.sum("child_l_linenumber").cast("long").alias("numbers"))


def _nested_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("suppliers"))
    nations = table(spark, sf_dir, "nation").join(suppliers, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey"))
    return table(spark, sf_dir, "region").join(nations.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "suppliers"))).alias("nations")), "r_regionkey", "left")


@query("shred_grandchild", "SELECT r_name, n_name, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def shred_grandchild(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shred.shred(_nested_regions(spark, sf_dir), "region", "load-1", ["r_regionkey"])
    low = shred.reassemble(t["region__nations"], t["region__nations__suppliers"])
    roots = t["region"].select(F.col(N.ROW_ID).alias("__root"), "r_name")
    return low.join(roots, F.col(f"child_{N.ROOT_ID}") == F.col("__root")).select("r_name", "n_name", F.col("child_s_suppkey").alias("s_suppkey"), F.col("child_s_name").alias("s_name"))


@query("shred_null_positions", f"SELECT l_orderkey, pos, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEMS}) - 1 AS pos FROM lineitem) WHERE l_returnflag <> 'R'")
def shred_null_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    docs = items.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items"))
    docs = docs.withColumn("items", F.transform("items", lambda x: F.when(x["l_returnflag"] != "R", x)))
    child = shred.shred(docs, "orders", "load-1", ["key"])["orders__items"]
    return child.select("l_orderkey", F.col(N.POS).alias("pos"), "l_partkey")


def _order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("order_keys"))


@query("scalar_list_column", "SELECT o_custkey AS c_custkey, count(*)::BIGINT AS n_orders, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def scalar_list_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shred.shred(_order_lists(spark, sf_dir), "customer", "load-1", ["c_custkey"])["customer"]
    return root.select("c_custkey", F.size("order_keys").cast("long").alias("n_orders"), F.array_max("order_keys").alias("last_key"))


@query("scalar_list_child", "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings")
def scalar_list_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shred.shred(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vectors", "load-1", ["vec_id"], scalar_lists_as_children=True)
    both = shred.reassemble(t["vectors"], t["vectors__embedding"])
    return both.select("vec_id", F.col(f"child_{N.POS}").alias("pos"), F.col("child_value").cast("double").alias("value"))


@query("struct_column", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def struct_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("profile"))
    return shred.shred(docs, "customer", "load-1", ["c_custkey"])["customer"].select("c_custkey", "profile.name", "profile.segment")


@query("lower_structs", "SELECT c_custkey, c_name AS profile__name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS profile__market__segment FROM customer")
def lower_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_mktsegment").alias("Segment")))
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), market.alias("market")).alias("profile"))
    return lower.lower(docs, lower.Capabilities(structs=False))


@query("lower_decimal_text", "SELECT o_orderkey, (o_totalprice::DECIMAL(15,2))::VARCHAR AS price FROM orders")
def lower_decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return lower.lower(docs, lower.Capabilities(decimal=False))


# ------------------------------------------------------------------------ inference


@query("json_escape_hatch", """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '"' || event_type || '"' ELSE 'true' END AS v FROM events""")
def json_escape_hatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 4
    v = F.when(n == 0, F.col("props")).when(n == 1, F.col("event_id").cast("string")).when(n == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("true")
    lines = _lines(e, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "v": '), v, F.lit("}")), "event_id")
    return _built(lines)["root"].select("id", "v")


@query("render_scalar", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN (-event_id)::VARCHAR ELSE 'false' END AS v FROM events")
def render_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 3
    v = F.when(n == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(n == 1, (-F.col("event_id")).cast("string")).otherwise("false")
    lines = _lines(e, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "v": '), v, F.lit("}")), "event_id")
    return _built(lines)["root"].select("id", "v")


def _types(spark: SparkSession, sf_dir: str, line: F.Column) -> DataFrame:
    return infer.infer_types(_lines(table(spark, sf_dir, "events"), line, "event_id")).select("column_name", "logical_type")


def _doc(*parts: F.Column | str) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _id() -> F.Column:
    return F.col("event_id").cast("string")


@query("all_null_omitted", "SELECT 'id' AS column_name, 'int64' AS logical_type")
def all_null_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir, _doc('{"id": ', _id(), ', "none": null, "empty": [], "nulls": [null, null], "hollow": {"a": null}}'))


@query("infer_types", "SELECT * FROM (VALUES ('id', 'int64'), ('kind', 'utf8'), ('num', 'float64'), ('flag', 'bool'), ('props', 'struct<k: int64>'), ('tags', 'list<utf8>'), ('odd', 'json')) t(column_name, logical_type)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.when(F.col("event_id") % 2 == 0, "1.5").otherwise("2")
    odd = F.when(F.col("event_id") % 2 == 0, "[1]").otherwise("2")
    return _types(spark, sf_dir, _doc('{"id": ', _id(), ', "kind": "', F.col("event_type"), '", "num": ', num, ', "flag": false, "props": ', F.col("props"), ', "tags": ["a", null], "odd": ', odd, "}"))


@query("infer_inexact_int", "SELECT * FROM (VALUES ('exact', 'float64'), ('inexact', 'utf8')) t(column_name, logical_type)")
def infer_inexact_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("event_id") % 2 == 1
    return _types(spark, sf_dir, _doc('{"exact": ', F.when(odd, "9007199254740992").otherwise("0.5"), ', "inexact": ', F.when(odd, "9007199254740993").otherwise("0.5"), "}"))


@query("infer_u64_text", "SELECT * FROM (VALUES ('big', 'utf8'), ('small', 'int64')) t(column_name, logical_type)")
def infer_u64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir, _doc('{"big": ', F.when(F.col("event_id") % 2 == 1, "9223372036854775808").otherwise("1"), ', "small": 9223372036854775807}'))


@query("infer_timestamp", "SELECT * FROM (VALUES ('a', 'timestamp_tz'), ('b', 'utf8'), ('c', 'utf8'), ('d', 'utf8')) t(column_name, logical_type)")
def infer_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    time = F.date_format("ts", "HH:mm:ss")
    return _types(spark, sf_dir, _doc('{"a": "', day, "T", time, 'Z", "b": "', day, "T", time, '", "c": "', day, '", "d": "', day, "T25:00:00+01:00", '"}'))


@query("infer_decimal_join", "SELECT * FROM (VALUES ('a', 'decimal(12,4)'), ('b', 'decimal(21,2)'), ('c', 'utf8'), ('d', 'utf8')) t(column_name, logical_type)")
def infer_decimal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = {"a": (L.decimal(10, 2), L.decimal(6, 4)), "b": (L.INT, L.decimal(10, 2)), "c": (L.decimal(38, 0), L.decimal(38, 10)), "d": (L.FLOAT, L.decimal(5, 2))}
    return _rows(spark, [(n, str(L.widen(*p))) for n, p in pairs.items()], "column_name string, logical_type string")


@query("schema_diff", "SELECT * FROM (VALUES ('add_column', 'o_note', NULL, 'utf8'), ('widen_column', 'o_custkey', 'int64', 'utf8'), ('widen_column', 'o_totalprice', 'float64', 'utf8')) t(kind, column_name, old_type, new_type)")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders")
    seen = known.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)")).withColumn("o_note", F.lit("x")).drop("o_orderstatus")
    return _rows(spark, [(d.kind, d.column, d.old, d.new) for d in policy.diff("orders", known.schema, seen.schema)], "kind string, column_name string, old_type string, new_type string")


@query("evolve_struct_fields", "SELECT * FROM (VALUES ('a', 'int64'), ('b', 'float64'), ('c', 'utf8')) t(column_name, logical_type)")
def evolve_struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (L.shape_of_spark(T._parse_datatype_string(s)) for s in ("struct<a: bigint, b: bigint>", "struct<b: double, c: string>"))
    return _rows(spark, [(f.name, str(f.shape)) for f in L.join_shapes(one, two).fields], "column_name string, logical_type string")


@query("passthrough_types", "SELECT * FROM (VALUES ('o_orderkey', 'int64'), ('o_custkey', 'int64'), ('o_orderstatus', 'utf8'), ('o_totalprice', 'float64'), ('o_orderdate', 'timestamp_naive'), ('o_orderpriority', 'utf8')) t(column_name, logical_type)")
def passthrough_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(n, str(s)) for n, s in passthrough.logical_schema(table(spark, sf_dir, "orders").schema)], "column_name string, logical_type string")


@query("type_hint_date", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_shipdate::DATE END AS shipped FROM lineitem")
def type_hint_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_partkey") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyy/MM/dd"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.to_date(text).alias("shipped"))


@query("type_hint_decimal", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_totalprice::DECIMAL(15,2) * 100)::BIGINT END AS cents FROM orders")
def type_hint_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.concat(text, F.lit("1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (C.to_decimal(text, 15, 2) * 100).cast("long").alias("cents"))


@query("timestamp_submicro_misfit", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(date_trunc('second', o_orderdate)) + 123456 END AS micros FROM orders")
def timestamp_submicro_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraction = F.when(F.col("o_orderkey") % 2 == 0, ".123456Z").otherwise(".1234567Z")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), fraction)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(C.to_instant(text)).alias("micros"))


@query("misfit_count", "SELECT 'root' AS table_name, count(*) FILTER (WHERE event_id % 5 = 0)::BIGINT AS misfits, count(*)::BIGINT AS n_rows FROM events")
def misfit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    lines = _lines(table(spark, sf_dir, "events"), _doc('{"id": ', _id(), ', "day": "', day, '"}'), "event_id")
    root = _built(lines, hints={"day": L.DATE})["root"]
    return root.agg(F.sum("_misfits").alias("misfits"), F.count("*").alias("n_rows")).select(F.lit("root").alias("table_name"), "misfits", "n_rows")


# ----------------------------------------------------------------------- identities


@query("row_id_keyless_dupes", "SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))::BIGINT AS n_ids FROM lineitem")
def row_id_keyless_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(shred.content_key(items).alias("id")).agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@query("row_id_keyed_stable", "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_same, count(DISTINCT o_orderkey)::BIGINT AS n_ids FROM orders")
def row_id_keyed_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.lit("X"))
    ids = [d.select("o_orderkey", shred.declared_key(["o_orderkey"]).alias(n)) for d, n in ((orders, "a"), (changed, "b"))]
    return ids[0].join(ids[1], "o_orderkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") == F.col("b")).alias("n_same"), F.countDistinct("a").alias("n_ids"))


@query("row_id_key_order", "SELECT count(DISTINCT (event_type, user_id))::BIGINT AS n_ids, (2 * count(*))::BIGINT AS n_rows FROM events")
def row_id_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    a = _lines(e, _doc('{"t": "', F.col("event_type"), '", "u": {"x": 1, "id": ', user, "}}"), "event_id")
    b = _lines(e, _doc('{"u": {"id": ', user, ', "x": 1}, "t": "', F.col("event_type"), '"}'), "event_id")
    root = _built(a.union(b))["root"]
    return root.agg(F.countDistinct(N.ROW_ID).alias("n_ids"), F.count("*").alias("n_rows"))


@query("child_id_unique", "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_ids FROM lineitem")
def child_id_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])["orders__items"]
    return child.agg(F.count("*").alias("n_rows"), F.countDistinct(N.ROW_ID).alias("n_ids"))


@query("lineage_integrity", "SELECT * FROM (VALUES ('parent', 0::BIGINT), ('root', 0::BIGINT)) t(link, orphans)")
def lineage_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shred.shred(_nested_regions(spark, sf_dir), "region", "load-1", ["r_regionkey"])
    low = t["region__nations__suppliers"]
    count = lambda df, link: df.agg(F.count("*").alias("orphans")).select(F.lit(link).alias("link"), "orphans")
    return count(shred.orphans(low, t["region__nations"]), "parent").union(count(shred.orphans(low, t["region"], N.ROOT_ID), "root"))


@query("load_id_stamp", "SELECT 'load-7' AS load_id, count(*)::BIGINT AS n_rows FROM orders")
def load_id_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shred.shred(table(spark, sf_dir, "orders"), "orders", "load-7")["orders"]
    return root.groupBy(F.col(N.LOAD_ID).alias("load_id")).agg(F.count("*").alias("n_rows"))


# --------------------------------------------------------------------- pass-through

_PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


@query("passthrough_basic", f"SELECT 'load-1' AS _sys_load_id, {_PART} FROM part")
def passthrough_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "part").withColumnRenamed("p_name", "P_Name")
    return passthrough.project(odd, "load-1")


@query("passthrough_missing_column", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS p_size FROM part")
def passthrough_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    odd = F.col("p_partkey") % 2 == 1
    return passthrough.union_batches([part.where(odd), part.where(~odd).drop("p_size")])


@query("passthrough_narrowing", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part")
def passthrough_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    odd = F.col("p_partkey") % 2 == 1
    return passthrough.union_batches([part.where(odd).withColumn("p_size", F.col("p_size").cast("string")), part.where(~odd)])


@query("passthrough_struct_fill", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS kind FROM part")
def passthrough_struct_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, odd = table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 1
    one = part.where(odd).select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).alias("s"))
    two = part.where(~odd).select("p_partkey", F.struct(F.col("p_brand").alias("brand")).alias("s"))
    return passthrough.union_batches([one, two]).select("p_partkey", "s.brand", "s.kind")


@query("exact_cast_guard", "SELECT count(*) FILTER (WHERE o_orderkey * 1000000000001 > 9007199254740992)::BIGINT AS inexact_big, 0::BIGINT AS nulls_big FROM orders")
def exact_cast_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.lit(1000000000001)).alias("big"))
    return passthrough.cast_losses(big, T.StructType([T.StructField("big", T.DoubleType())]))


@query("cast_null_growth", "SELECT 0::BIGINT AS inexact_day, 0::BIGINT AS nulls_day, count(*) FILTER (WHERE o_totalprice::DECIMAL(15,2) >= 100000)::BIGINT AS inexact_price, count(*) FILTER (WHERE o_totalprice::DECIMAL(15,2) >= 100000)::BIGINT AS nulls_price FROM orders")
def cast_null_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return passthrough.cast_losses(df, T.StructType([T.StructField("day", T.DateType()), T.StructField("price", T.DecimalType(7, 2))]))


# --------------------------------------------------------------------------- scalars


@query("normalize_ident", """SELECT p_partkey, CASE WHEN length(n) <= 12 THEN n ELSE substr(n, 1, 3) || '_' || substr(sha256(s), 1, 8) END AS ident
  FROM (SELECT p_partkey, s, CASE WHEN regexp_matches(b, '^[0-9]') THEN '_' || b ELSE b END AS n
  FROM (SELECT p_partkey, s, regexp_replace(lower(s), '[^a-z0-9_]', '_', 'g') AS b FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_size::VARCHAR || '-' || p_type END AS s FROM part)))""")
def normalize_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_ident_column(source, 12).alias("ident"))


@query("control_char_scan", r"SELECT doc_id, regexp_matches(text, '[\x{00}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]') AS has_control FROM documents")
def control_char_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.has_control(F.col("text")).alias("has_control"))


@query("json_keys_explode", "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_keys_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


