"""What a load does to a table: append, replace, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N

ARRIVAL = "_arrival"


class NullKey(ValueError):
    """A merge key that is null or missing."""


def append(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of both; columns by name, missing ones null."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def replace(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The load's rows only. One replacement a load: later batches of it append."""
    return new


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many rows have a null in the key."""
    if missing := [k for k in key if k not in df.columns]:
        raise NullKey(f"no column {', '.join(missing)}")
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    return df.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("null_keys"))


def require_keys(df: DataFrame, key: Sequence[str]) -> None:
    """Fail before anything is written if a key is null."""
    null_keys(df, key)
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    if df.where(bad).limit(1).count():
        raise NullKey(f"a row has no {', '.join(key)}")


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last arrival of each key.

    An aggregation with a partial step, so a key that a large share of the rows has costs one row a task:
    a window would bring all of them to one.
    """
    rest = [c for c in df.columns if c not in key]
    last = F.max(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"__o{n}") for n, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row")))
    return df.groupBy(*key).agg(last.alias("__last")).select(*[F.col(c) if c in key else F.col("__last")["__row"][c].alias(c) for c in df.columns])


def merge_keyed(old: DataFrame | None, new: DataFrame, key: Sequence[str], order: Sequence[str | Column] = (ARRIVAL,)) -> DataFrame:
    """Old rows whose key doesn't come again, and the last arrival of each new key."""
    staged = last_wins(new, key, order)
    return staged if old is None else append(old.join(staged.select(*key), list(key), "left_anti").select(*old.columns), staged)


def merge_subtree(old: dict[str, DataFrame], new: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """A record replaces its earlier version and all of its children, in every table once for the whole unit.

    The unit's root ids are taken once; children go by root id, also where the record has none any more.
    Where tables have an ``_arrival`` column, the last version of a record counts, with its own children.
    """
    arrivals = ARRIVAL in new[root].columns
    roots = last_wins(new[root], [N.ROW_ID], [ARRIVAL]) if arrivals else new[root].dropDuplicates([N.ROW_ID])
    ids = roots.select(F.col(N.ROW_ID).alias("__id"), *([F.col(ARRIVAL).alias("__at")] if arrivals else []))
    out = {}
    for table in dict.fromkeys([*old, *new]):
        column = N.ROW_ID if table == root else N.ROOT_ID
        kept = old[table].join(ids, F.col(column) == F.col("__id"), "left_anti") if table in old else None
        staged = None
        if table == root:
            staged = roots
        elif table in new:
            staged = new[table]
            if arrivals and ARRIVAL in staged.columns:
                staged = staged.join(ids, (F.col(column) == F.col("__id")) & (F.col(ARRIVAL) == F.col("__at")), "left_semi")
            staged = staged.dropDuplicates([N.ROW_ID])
        out[table] = append(kept, staged) if staged is not None else kept
    return out


def merge_content(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Merge without key: equal rows collapse by their content id."""
    return append(old, new).dropDuplicates([N.ROW_ID])


def widen_rows(old: DataFrame, schema: T.StructType) -> DataFrame:
    """Committed rows under a wider schema."""
    from millrace.operators.passthrough import conform

    return conform(old, schema)
