"""The registered queries of the engine's own operators, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import naming as N
from millrace.operators import shred

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, each with the array of its line items."""
    items = table(spark, sf_dir, "lineitem")
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*items.columns))).alias("items"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")


@query("flagship", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n_rows, count(DISTINCT l_orderkey)::BIGINT AS n_parents FROM lineitem GROUP BY 1, 2")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nest orders into documents, shred them back with lineage, and count child rows and parents by flags."""
    child = shred.shred(nested_orders(spark, sf_dir), "orders", "load-1", ["o_orderkey"])["orders__items"]
    # A parent's rows are together: one row for each parent and flags before the count.
    parents = child.groupBy("l_returnflag", "l_linestatus", N.PARENT_ID).agg(F.count("*").alias("n"))
    return parents.groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_parents"))


def load_all() -> None:
    """Register the queries of all modules."""
    from millrace.plans import queries_engine, queries_load, queries_shape  # noqa: F401
