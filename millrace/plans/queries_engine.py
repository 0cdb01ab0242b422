"""Queries that go through the engine: nested batches under each policy, identities, replay, side-by-side streams."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import naming as N
from millrace.operators import infer, policy, shred
from millrace.plans.catalog import nested_orders, query, table
from millrace.session import shared_folder
from millrace.sources.base import StreamSpec
from millrace.sources.files import Scripted, TypedFiles
from millrace.sources.ranges import lines_between
from millrace.sources.store import SnapshotStore, Unit
from millrace.streaming.engine import Pipeline

#: The second batch holds the nations from here on; some of its keys come as text.
_SECOND = 13


def _store(spark: SparkSession, **options) -> SnapshotStore:
    return SnapshotStore(f"{shared_folder(spark)}/store-{uuid.uuid4().hex}".removeprefix("file:"), **options)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation with its customers as a line of JSON."""
    second = F.col("c_nationkey") >= _SECOND
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    key = F.when(second & (F.col("c_custkey") % 3 == 0), quoted(F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string"))
    kid = F.concat(F.lit('{"c":'), key, F.lit(',"name":'), quoted(F.col("c_name")), F.lit("}"))
    kids = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(kid)), ",").alias("kids"))
    own = F.when(second & (F.col("c_nationkey") % 2 == 1), quoted(F.col("c_nationkey"))).otherwise(F.col("c_nationkey").cast("string"))
    return kids.select(F.concat(F.lit('{"n":'), own, F.lit(',"kids":['), F.col("kids"), F.lit("]}")).alias("line"), F.col("c_nationkey").cast("long").alias("ordinal"))


def _loaded(spark: SparkSession, sf_dir: str, action: policy.Action) -> DataFrame:
    lines = _documents(spark, sf_dir)
    batches = [(lines.where(F.col("ordinal") < _SECOND), "first"), (lines.where(F.col("ordinal") >= _SECOND), "second")]
    store = _store(spark)
    discarded: dict[str, list[int]] = {}

    def count(e) -> None:
        if e.kind == "discarded":
            both = discarded.setdefault(e.data["table"], [0, 0])
            both[0] += e.data["rows"]
            both[1] += e.data["values"]

    p = Pipeline("nested", Scripted([(StreamSpec("docs", ("n",)), batches)]), store, schema_policy=policy.Policy(action), listeners=[count])
    try:
        p.run(spark)
    except policy.ContractViolation:
        if action is not policy.Action.FREEZE:
            raise
    out = []
    for t, key in (("docs", "n"), ("docs__kids", "c")):
        rows, values = discarded.get(t, (0, 0))
        sums = store.read(spark, t).agg(F.count("*").alias("n_rows"), F.count(key).alias("n_keys"), F.sum(F.col(key).cast("long")).alias("key_sum"))
        out.append(sums.select(F.lit(t).alias("table_name"), "*", F.lit(rows).cast("long").alias("discarded_rows"), F.lit(values).cast("long").alias("discarded_values")))
    return out[0].union(out[1])


def _sql(keep_doc: str, keep_kid: str, doc_key: str = "k", kid_key: str = "c", values: bool = False) -> str:
    zero, lost = "0::BIGINT", lambda kept, all_: f"(count(*) - count(*) FILTER (WHERE {kept}))::BIGINT" if all_ else "0::BIGINT"
    doc = f"SELECT 'docs' AS table_name, count(*) FILTER (WHERE {keep_doc})::BIGINT AS n_rows, count({doc_key}) FILTER (WHERE {keep_doc})::BIGINT AS n_keys, sum({doc_key}) FILTER (WHERE {keep_doc})::BIGINT AS key_sum"
    kid = f"SELECT 'docs__kids', count(*) FILTER (WHERE {keep_kid})::BIGINT, count({kid_key}) FILTER (WHERE {keep_kid})::BIGINT, sum({kid_key}) FILTER (WHERE {keep_kid})::BIGINT"
    counted = [f"{lost(keep, not values)} AS discarded_rows, {f'(count(*) - count({key}))::BIGINT' if values else zero} AS discarded_values" for keep, key in ((keep_doc, doc_key), (keep_kid, kid_key))]
    return f"WITH kids AS (SELECT c_nationkey AS k, c_custkey AS c FROM customer), docs AS (SELECT DISTINCT k FROM kids) {doc}, {counted[0]} FROM docs UNION ALL {kid}, {counted[1]} FROM kids"


_ODD, _THIRD = f"(k >= {_SECOND} AND k % 2 = 1)", f"(k >= {_SECOND} AND c % 3 = 0)"


@query("engine_nested_evolve", _sql("true", "true"))
def engine_nested_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of nested documents; keys that come as text widen their columns."""
    return _loaded(spark, sf_dir, policy.Action.EVOLVE)


@query("engine_nested_discard_row", _sql(f"NOT {_ODD}", f"NOT {_ODD} AND NOT {_THIRD}"))
def engine_nested_discard_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a key as text go, with all rows below them, and are counted."""
    return _loaded(spark, sf_dir, policy.Action.DISCARD_ROW)


@query("engine_nested_discard_value", _sql("true", "true", f"(CASE WHEN NOT {_ODD} THEN k END)", f"(CASE WHEN NOT {_THIRD} THEN c END)", values=True))
def engine_nested_discard_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come as text become null and are counted."""
    return _loaded(spark, sf_dir, policy.Action.DISCARD_VALUE)


@query("engine_nested_freeze", _sql(f"k < {_SECOND}", f"k < {_SECOND}").replace("(count(*) - count(*) FILTER (WHERE k < 13))", "0"))
def engine_nested_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch is committed, the second violates the schema and nothing of it is written."""
    return _loaded(spark, sf_dir, policy.Action.FREEZE)


@query(
    "identity_raw_typed",
    "SELECT 'orders' AS table_name, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_equal FROM orders "
    "UNION ALL SELECT 'orders__items', count(*)::BIGINT, count(*)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def identity_raw_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents shredded as typed rows and as lines of JSON, keyed by a double, have the same ids."""
    docs = nested_orders(spark, sf_dir)
    items = F.transform("items", lambda x: F.struct(x["l_partkey"].alias("part"), x["l_linenumber"].alias("line"), x["l_extendedprice"].alias("price"), x["l_discount"].alias("discount"), x["l_returnflag"].alias("flag")))
    docs = docs.select((F.col("o_orderkey") * F.lit(0.5)).alias("half"), F.col("o_totalprice").alias("total"), items.alias("items"))
    typed = shred.shred(docs, "orders", "load-1", ["half"])
    lines = docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("line"), F.monotonically_increasing_id().alias("ordinal"))
    raw, columns = infer.together(lines, infer.resolve(infer.observe(lines), "orders"), "load-1", ["half"])
    names = ("orders", "orders__items")
    # Ids as bytes; those of both raw tables come from one pass.
    one = [typed[t].select(F.lit(k).alias("t"), F.unhex(N.ROW_ID).alias("id"), F.lit(1).alias("n"), F.lit(0).alias("m")) for k, t in enumerate(names)]
    ids = lambda k: F.transform(columns[names[k]], lambda x: F.struct(F.lit(k).alias("t"), F.unhex(x[N.ROW_ID]).alias("id")))
    each = [ids(k) for k, t in enumerate(names) if t in columns]
    two = raw.select(F.inline(F.concat(*each))).select("t", "id", F.lit(0).alias("n"), F.lit(1).alias("m")) if each else one[0].limit(0)
    met = one[0].unionByName(one[1]).unionByName(two).groupBy("t", "id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    count = lambda k, c: F.coalesce(F.sum(F.when(c & (F.col("t") == k), F.col("n"))), F.lit(0))
    rows = [F.struct(F.lit(t).alias("table_name"), count(k, F.lit(True)).alias("n_rows"), count(k, F.col("n") == F.col("m")).alias("n_equal")) for k, t in enumerate(names)]
    return met.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


class _Crash(Exception):
    pass


@query("engine_replay", "SELECT o_orderkey, o_orderstatus FROM orders")
def engine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run dies between staging and publishing; the next session replays what was staged, once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")

    def die(point: str) -> None:
        if point == "before_publish":
            raise _Crash

    store = _store(spark)
    with store.session("p"):
        store.commit(spark, "p", Unit("load-1", 0, {"orders": orders.where("o_orderkey % 2 = 0")}, "orders", cursors={"orders": 0}))
    dying = SnapshotStore(store.root, crash=die)
    try:
        with dying.session("p"):
            dying.commit(spark, "p", Unit("load-1", 1, {"orders": orders.where("o_orderkey % 2 <> 0")}, "orders", cursors={"orders": 1}))
    except _Crash:
        pass
    for _ in range(2):
        with store.session("p"):
            pass
    return store.read(spark, "orders")


@query(
    "engine_streams_side_by_side",
    "SELECT 'nation' AS table_name, count(*)::BIGINT AS n_rows FROM nation UNION ALL SELECT 'region', count(*)::BIGINT FROM region "
    "UNION ALL SELECT 'supplier', count(*)::BIGINT FROM supplier UNION ALL SELECT 'part', count(*)::BIGINT FROM part",
)
def engine_streams_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four streams, read at the same time, each committed whole."""
    names = ("nation", "region", "supplier", "part")
    store = _store(spark)
    Pipeline("wide", TypedFiles({n: f"{sf_dir}/{n}.parquet" for n in names}), store, readers=4).run(spark)
    counts = [store.read(spark, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in names]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("raw_jsonl_tables", "SELECT 'orders' AS table_name, count(*)::BIGINT AS n_rows FROM orders UNION ALL SELECT 'orders__items', count(*)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def raw_jsonl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lines of JSON into their tables: observed, resolved, built."""
    docs = nested_orders(spark, sf_dir)
    lines = docs.select(F.to_json(F.struct(*docs.columns)).alias("line"), F.monotonically_increasing_id().alias("ordinal"))
    whole, columns = infer.together(lines, infer.resolve(infer.observe(lines), "orders"), "load-1", ["o_orderkey"])
    # Both tables are built and counted in one pass; without any items there is no table of them.
    sizes = {t: F.coalesce(F.sum(F.size(columns[t])), F.lit(0)) if t in columns else F.lit(0) for t in ("orders", "orders__items")}
    counts = whole.agg(F.array(*[F.struct(F.lit(t).alias("table_name"), n.cast("long").alias("n_rows")) for t, n in sizes.items()]).alias("counts"))
    return counts.select(F.inline("counts"))


@query("jsonl_by_ranges", "SELECT count(*)::BIGINT AS n_lines, sum(p_partkey)::BIGINT AS key_sum FROM part")
def jsonl_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of JSON lines read in spans of bytes that cut lines anywhere, up to its last whole line."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}".removeprefix("file:")
    os.makedirs(folder)
    path = os.path.join(folder, "part.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        for r in table(spark, sf_dir, "part").select("p_partkey", "p_name").toLocalIterator():
            f.write(json.dumps(r.asDict()) + "\n")
        end = f.tell()
        f.write('{"p_partkey": 1, "p_na')
    lines = lines_between(spark, path, 0, end, span=10_007)
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.get_json_object("line", "$.p_partkey").cast("long")).alias("key_sum"))
