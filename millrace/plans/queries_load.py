"""Queries over policies, write modes, commits, cursors and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.operators import merge, passthrough, policy, shred
from millrace.plans import report
from millrace.plans.catalog import nested_orders, query, table
from millrace.session import shared_folder
from millrace.sources.files import since_cursor
from millrace.sources.store import SnapshotStore, Unit
from millrace.streaming.policy import commit_units, covered

_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _changed(orders: DataFrame) -> DataFrame:
    """The second load: even orders with another price and priority."""
    return orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderpriority", F.lit("CHANGED"))


_CHANGED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, 'CHANGED' AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0"


# -------------------------------------------------------------------------- policies


def _governed(spark: SparkSession, sf_dir: str, action: policy.Action) -> policy.Governed:
    """A batch in which every seventh customer key is no number."""
    orders = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    return policy.govern(orders.withColumn("o_custkey", key), "orders", orders.schema, policy.Policy(action))


@query("policy_evolve", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'c' ELSE '' END || o_custkey::VARCHAR AS o_custkey FROM orders")
def policy_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, policy.Action.EVOLVE).rows.select("o_orderkey", "o_custkey")


@query("policy_discard_row", f"SELECT {_ORDER}, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)::BIGINT AS discarded FROM orders WHERE o_orderkey % 7 <> 0")
def policy_discard_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _governed(spark, sf_dir, policy.Action.DISCARD_ROW)
    return g.rows.withColumn("discarded", F.lit(g.discarded.first()["rows"]))


@query("policy_discard_value", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)::BIGINT AS discarded FROM orders")
def policy_discard_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _governed(spark, sf_dir, policy.Action.DISCARD_VALUE)
    return g.rows.select("o_orderkey", "o_custkey").withColumn("discarded", F.lit(g.discarded.first()["values"]))


@query("policy_cascade", "SELECT count(*) FILTER (WHERE l_orderkey % 7 <> 0)::BIGINT AS kept, count(*) FILTER (WHERE l_orderkey % 7 = 0)::BIGINT AS lost FROM lineitem")
def policy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])
    kept, lost = policy.cascade({"items": t["orders__items"]}, t["orders"].where("o_orderkey % 7 = 0"))
    both = kept["items"].select(F.lit(1).alias("stays")).union(lost["items"].select(F.lit(0)))
    return both.agg(F.sum("stays").cast("long").alias("kept"), F.sum(1 - F.col("stays")).cast("long").alias("lost"))


@query("policy_arrow_discard", "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0)::BIGINT AS discarded FROM part")
def policy_arrow_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    wider = part.withColumn("note", F.when(F.col("p_partkey") % 3 == 0, "x"))
    g = policy.govern(wider, "part", part.schema, policy.Policy(policy.Action.DISCARD_VALUE))
    return g.rows.withColumn("discarded", F.lit(g.discarded.first()["values"]))


# ----------------------------------------------------------------------- write modes


@query("write_append", f"SELECT {_ORDER} FROM orders UNION ALL {_CHANGED}")
def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return merge.append(orders, _changed(orders))


@query("write_replace", _CHANGED)
def write_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return merge.replace(orders, _changed(orders))


@query("merge_keyed", f"{_CHANGED} UNION ALL SELECT {_ORDER} FROM orders WHERE o_orderkey % 2 <> 0")
def merge_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderkey % 2 = 0").withColumn(merge.ARRIVAL, F.lit(0))
    staged = first.unionByName(_changed(orders).withColumn(merge.ARRIVAL, F.lit(1)))
    return merge.merge_keyed(orders.withColumn(merge.ARRIVAL, F.lit(-1)), staged, ["o_orderkey"]).drop(merge.ARRIVAL)


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Load 2 has the even orders again: every third without items, the others with their first item only."""
    docs = nested_orders(spark, sf_dir)
    items = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast(docs.schema["items"].dataType)).otherwise(F.slice("items", 1, 1))
    again = docs.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("2")).withColumn("items", items)
    old, new = (shred.shred(d, "orders", n, ["o_orderkey"]) for d, n in ((docs, "load-1"), (again, "load-2")))
    return merge.merge_subtree(old, new, "orders")


@query("merge_subtree_root", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def merge_subtree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus")


@query("merge_subtree_child", "SELECT l_orderkey, CASE WHEN l_orderkey % 2 <> 0 THEN count(*) ELSE 1 END::BIGINT AS n_items FROM lineitem WHERE l_orderkey % 2 <> 0 OR l_orderkey % 3 <> 0 GROUP BY 1")
def merge_subtree_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)["orders__items"].groupBy("l_orderkey").agg(F.count("*").alias("n_items"))


@query("merge_keyless_dedup", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def merge_keyless_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (shred.shred(table(spark, sf_dir, "lineitem"), "lineitem", n)["lineitem"] for n in ("load-1", "load-2"))
    return merge.merge_content(one, two.where("l_orderkey % 2 = 0")).drop(N.LOAD_ID, N.ROW_ID)


@query("widen_existing_rows", "SELECT p_partkey, p_size::DOUBLE AS p_size, NULL::VARCHAR AS p_note FROM part")
def widen_existing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    schema = passthrough.joined_schema(part.schema, T._parse_datatype_string("struct<p_size: double, p_note: string>"))
    return merge.widen_rows(part, schema)


@query("null_key_count", "SELECT count(*)::BIGINT AS null_keys FROM orders WHERE o_orderkey % 11 = 0")
def null_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "orders").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")))
    return merge.null_keys(odd, ["o_orderkey", "o_custkey"])


@query("commit_idempotent", "SELECT o_orderstatus, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1")
def commit_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two units, each published twice: the table has each once."""
    store = SnapshotStore(f"{shared_folder(spark)}/store-{uuid.uuid4().hex}".removeprefix("file:"))
    orders = table(spark, sf_dir, "orders")
    with store.session():
        for seq in (0, 0, 1, 1):
            store.commit(spark, "p", Unit("load-1", seq, {"orders": orders.where(F.col("o_orderkey") % 2 == seq)}, "orders", cursors={"orders": seq}))
    return store.read(spark, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


# --------------------------------------------------------------- cursors and commits


@query("incremental_since_cursor", "SELECT event_id, ts, user_id, event_type FROM events WHERE event_id > 500")
def incremental_since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since_cursor(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", 500)


@query("commit_policy_boundaries", "SELECT event_type, commit_seq, count(*)::BIGINT AS n_rows, max(event_id) AS last_id FROM (SELECT *, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100)::BIGINT AS commit_seq FROM events) GROUP BY 1, 2")
def commit_policy_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = commit_units(table(spark, sf_dir, "events"), "event_id", 100, ["event_type"])
    return units.groupBy("event_type", "commit_seq").agg(F.count("*").alias("n_rows"), F.max("event_id").alias("last_id"))


@query("coverage_filter", "SELECT event_type, count(*)::BIGINT AS n_covered FROM events e WHERE event_id <= (SELECT max(event_id) FROM events c WHERE c.event_type = e.event_type AND c.event_id % 50 = 0) GROUP BY 1")
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    inside = covered(e, e.where("event_id % 50 = 0").select("event_type", "event_id"), "event_type", "event_id")
    return inside.groupBy("event_type").agg(F.count("*").alias("n_covered"))


# --------------------------------------------------------------------------- reports


@query("report_totals", "SELECT event_type AS table_name, count(*)::BIGINT AS units, sum(user_id)::BIGINT AS rows FROM events GROUP BY 1")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(table(spark, sf_dir, "events").withColumnRenamed("event_type", "table_name"), "table_name", "user_id").select("table_name", "units", F.col("rows").cast("long").alias("rows"))


@query("commit_counters", "SELECT (event_id // 1000)::BIGINT AS commit_seq, count(*)::BIGINT AS units, sum(user_id)::BIGINT AS rows FROM events GROUP BY 1")
def commit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("commit_seq", F.floor(F.col("event_id") / 1000).cast("long"))
    return report.totals(e, "commit_seq", "user_id").select("commit_seq", "units", F.col("rows").cast("long").alias("rows"))


@query("metrics_fold", "SELECT count(*)::BIGINT AS n_events, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS commits, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS retries, coalesce(sum(user_id) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS rows FROM events")
def metrics_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n_events"), F.count_if(committed).alias("commits"), F.count_if(F.col("event_type") == "error").alias("retries"), F.coalesce(F.sum(F.when(committed, F.col("user_id"))), F.lit(0)).cast("long").alias("rows")
    )


@query("rate_window_5s", "SELECT event_id, (sum(user_id) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS recent FROM events")
def rate_window_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sliding_rows(table(spark, sf_dir, "events"), "ts", "user_id", ["event_type"]).select("event_id", F.col("recent").cast("long").alias("recent"))


@query("events_order_check", "SELECT user_id, count(*)::BIGINT AS n_events, count(*) FILTER (WHERE before > ts)::BIGINT AS out_of_order FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def events_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("before") > F.col("ts")).alias("out_of_order"))
