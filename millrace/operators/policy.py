"""Schema changes and the policies over them: evolve, freeze, discard the row, discard the value."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.functions.columns import int_is_exact


class Action(str, Enum):
    EVOLVE = "evolve"
    FREEZE = "freeze"
    DISCARD_ROW = "discard_row"
    DISCARD_VALUE = "discard_value"


class ContractViolation(ValueError):
    """A change that a frozen schema doesn't allow; raised before a row is written."""


@dataclass(frozen=True)
class Delta:
    """One change: create_table, add_column or widen_column. Nothing is dropped, renamed or narrowed."""

    kind: str
    table: str
    column: str | None = None
    old: str | None = None
    new: str | None = None


def diff(table: str, known: T.StructType | None, seen: T.StructType) -> list[Delta]:
    """What has to change for ``known`` to hold ``seen``."""
    if known is None:
        return [Delta("create_table", table)]
    out = []
    for f in seen:
        new = L.shape_of_spark(f.dataType, f.metadata)
        if f.name not in known.names:
            out.append(Delta("add_column", table, f.name, None, str(new)))
            continue
        k = known[f.name]
        old = L.shape_of_spark(k.dataType, k.metadata)
        both = L.join_shapes(old, new)
        if both != old:
            out.append(Delta("widen_column", table, f.name, str(old), str(both)))
    return out


def schema_hash(schema: T.StructType) -> str:
    """The version of a schema: a digest of its columns in order."""
    body = json.dumps([[f.name, str(L.shape_of_spark(f.dataType, f.metadata)), f.nullable] for f in schema])
    return hashlib.sha256(body.encode()).hexdigest()


@dataclass
class Policy:
    """Actions by column, table or default; a table without entry takes its nearest ancestor's."""

    default: Action = Action.EVOLVE
    tables: dict[str, Action] = field(default_factory=dict)
    columns: dict[tuple[str, str], Action] = field(default_factory=dict)

    def action(self, table: str, column: str | None = None, ancestors: tuple[str, ...] = ()) -> Action:
        """``ancestors``: parent tables, nearest first."""
        if column is not None and (table, column) in self.columns:
            return self.columns[table, column]
        for t in (table, *ancestors):
            if t in self.tables:
                return self.tables[t]
        return self.default


def fits(c: Column, have: T.DataType, want: T.DataType, rendered: bool = True) -> Column:
    """Whether a value is one of the known type without widening; nulls are.

    ``rendered``: texts may be renderings of what was widened to text, and fit if they are; else text is no number.
    """
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if have == want:
        return F.lit(True)
    if isinstance(want, T.LongType) and isinstance(have, integral):
        return F.lit(True)
    if isinstance(want, T.DoubleType) and isinstance(have, (*integral, T.FloatType)):
        return c.isNull() | (int_is_exact(c) if isinstance(have, T.LongType) else F.lit(True))
    if isinstance(want, T.StringType) and not isinstance(have, (T.StructType, T.ArrayType, T.BinaryType)):
        return F.lit(True)
    if rendered and isinstance(have, T.StringType) and not isinstance(want, (T.StructType, T.ArrayType, T.BinaryType)):
        return c.isNull() | (c.try_cast(want).isNotNull() & (F.trim(c) == c))
    if isinstance(want, T.DecimalType) and isinstance(have, (T.DecimalType, *integral)):
        return c.isNull() | F.coalesce(c.try_cast(want) == c, F.lit(False))
    return c.isNull()


@dataclass
class Governed:
    """A batch under a policy: what goes on, its schema, and what was discarded."""

    rows: DataFrame
    schema: T.StructType
    deltas: list[Delta]
    dropped: DataFrame | None
    discarded: DataFrame


def govern(df: DataFrame, table: str, known: T.StructType | None, policy: Policy, ancestors: tuple[str, ...] = (), bootstrapped: bool = True, unfit: str | None = None, rendered: bool = True) -> Governed:
    """Apply a policy to a batch.

    ``unfit`` names a column with the names of the columns whose value, as it came, isn't of the known type; without
    it the test goes by the types of the batch, and ``rendered`` says what texts are (see ``fits``).

    ``discarded`` is one row of counts (``rows``, ``values``); it is a lazy aggregate. A table that appears
    after the first batches is a change too.
    """
    spark = df.sparkSession
    marked, df = df, df.drop(unfit) if unfit else df
    nothing = spark.range(1).select(F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("values"))
    if known is None:
        if bootstrapped:
            action = policy.action(table, None, ancestors)
            if action is Action.FREEZE:
                raise ContractViolation(f"table {table} is new")
            if action is not Action.EVOLVE:
                return Governed(df.limit(0), df.schema, [], df, df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("values")))
        return Governed(df, df.schema, diff(table, None, df.schema), None, nothing)
    from millrace.operators.passthrough import joined_schema

    deltas = diff(table, known, df.schema)
    offends, nulled, dropped_columns = F.lit(False), [], set()
    schema, kept_deltas = known, []
    for d in deltas:
        action = policy.action(table, d.column, ancestors)
        if action is Action.FREEZE:
            raise ContractViolation(f"{d.kind} {table}.{d.column}: {d.old} -> {d.new}")
        if action is Action.EVOLVE:
            kept_deltas.append(d)
            schema = joined_schema(schema, T.StructType([df.schema[d.column]]))
            continue
        c = F.col(f"`{d.column}`")
        if d.kind == "add_column":
            bad = c.isNotNull()
        elif unfit:
            bad = F.array_contains(F.col(unfit), d.column)
        else:
            bad = ~fits(c, df.schema[d.column].dataType, known[d.column].dataType, rendered)
        if action is Action.DISCARD_ROW:
            offends = offends | bad
        else:
            nulled.append((d.column, bad))
        if d.kind == "add_column":
            dropped_columns.add(d.column)
    bad_values = [F.coalesce(F.sum(F.when(bad & ~offends, 1)), F.lit(0)) for _, bad in nulled]
    total = sum(bad_values[1:], bad_values[0]) if bad_values else F.lit(0)
    counts = marked.agg(F.coalesce(F.sum(F.when(offends, 1)), F.lit(0)).cast("long").alias("rows"), total.cast("long").alias("values"))
    kept = marked.where(~offends)
    by_name = dict(nulled)
    columns = []
    for f in schema:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        c = F.when(~by_name[f.name], c) if f.name in by_name else c
        columns.append(_as_known(c, df.schema[f.name].dataType, f.dataType).alias(f.name))
    return Governed(kept.select(*columns), schema, kept_deltas, marked.where(offends).select(*df.columns), counts)


def _as_known(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value that fits, in its known type again."""
    if have == want:
        return c
    if isinstance(want, (T.StructType, T.ArrayType)):
        from millrace.operators.passthrough import fill

        return F.from_json(c, want) if isinstance(have, T.StringType) else fill(c, have, want)
    return c.try_cast(want)


def under(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a parent among the dropped ids (``__gone``)."""
    met = F.col(N.PARENT_ID) == F.col("__gone")
    return rows.join(gone, met, "left_anti"), rows.join(gone, met, "left_semi")


def cascade(children: dict[str, DataFrame], dropped_roots: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Children at any depth without those of dropped roots, and the ones that went (to count)."""
    gone = dropped_roots.select(F.col(N.ROW_ID).alias("__gone")).distinct()
    kept = {t: c.join(gone, F.col(N.ROOT_ID) == F.col("__gone"), "left_anti") for t, c in children.items()}
    lost = {t: c.join(gone, F.col(N.ROOT_ID) == F.col("__gone"), "left_semi") for t, c in children.items()}
    return kept, lost
