"""Typed data passed through: rename, stamp, fill, and cast only where nothing is lost."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.functions.columns import int_is_exact


class InexactCast(ValueError):
    """A cast that would change a value."""


def logical_schema(schema: T.StructType) -> list[tuple[str, L.Shape]]:
    """Names and shapes of a typed schema; what has no logical type is refused."""
    namer = N.UniqueNamer()
    return [(namer.name_for(f.name), L.shape_of_spark(f.dataType, f.metadata)) for f in schema]


def project(df: DataFrame, load_id: str) -> DataFrame:
    """Normalised names and the load's id; data as it is."""
    logical_schema(df.schema)
    namer = N.UniqueNamer()
    return df.select(F.lit(load_id).alias(N.LOAD_ID), *[F.col(f"`{c}`").alias(namer.name_for(c)) for c in df.columns])


def inexact(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """Whether the cast of a value would lose something. Casts that are never exact are refused outright."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if have == want:
        return F.lit(False)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        known = {f.name: f.dataType for f in have}
        bad = [inexact(c[f.name], known[f.name], f.dataType) for f in want if f.name in known and known[f.name] != f.dataType]
        return c.isNotNull() & F.coalesce(reduce(or_, bad, F.lit(False)), F.lit(False))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: inexact(x, have.elementType, want.elementType)), F.lit(False))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) and isinstance(want, T.StringType):
        raise InexactCast(f"{have.simpleString()} has no text")
    if isinstance(have, T.LongType) and isinstance(want, T.DoubleType):
        return c.isNotNull() & ~int_is_exact(c)
    if isinstance(have, integral) and isinstance(want, (*integral, T.DoubleType)):
        return c.isNotNull() & c.try_cast(want).isNull()
    if isinstance(want, T.DecimalType) and isinstance(have, (T.DecimalType, *integral)):
        return c.isNotNull() & ~F.coalesce(c.try_cast(want) == c, F.lit(False))
    if isinstance(have, T.TimestampNTZType) and isinstance(want, T.DateType):
        return c.isNotNull() & (c.cast("date").cast("timestamp_ntz") != c)
    if isinstance(have, T.FloatType) and isinstance(want, T.DoubleType) or isinstance(want, T.StringType):
        return F.lit(False)
    if isinstance(have, T.DateType) and isinstance(want, T.TimestampNTZType):
        return F.lit(False)
    raise InexactCast(f"no exact cast from {have.simpleString()} to {want.simpleString()}")


def cast_losses(df: DataFrame, want: T.StructType) -> DataFrame:
    """One row: for each column that changes type, values that would be changed and nulls that would be added."""
    sums = []
    for f in want:
        if f.name in df.columns and df.schema[f.name].dataType != f.dataType:
            c = F.col(f"`{f.name}`")
            sums.append(F.coalesce(F.sum(inexact(c, df.schema[f.name].dataType, f.dataType).cast("long")), F.lit(0)).alias(f"inexact_{f.name}"))
            if not isinstance(f.dataType, (T.StructType, T.ArrayType)):
                sums.append((F.count(c) - F.count(c.try_cast(f.dataType))).alias(f"nulls_{f.name}"))
    return df.agg(*sums) if sums else df.sparkSession.range(1).select(F.lit(0).alias("none"))


def fill(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value in a wider type; missing struct fields are null."""
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        known = {f.name: f.dataType for f in have}
        made = F.struct(*[(fill(c[f.name], known[f.name], f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
        return F.when(c.isNotNull(), made)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: fill(x, have.elementType, want.elementType))
    return c.cast(want)


def conform(df: DataFrame, want: T.StructType, check: bool = True) -> DataFrame:
    """``df`` in the columns of ``want``: missing ones and missing struct fields null, types cast exactly.

    The check is one aggregation over the columns that change type, at every depth; nothing is read where none does.
    """
    if check and any(f.name in df.columns and df.schema[f.name].dataType != f.dataType for f in want):
        losses = {k: n for k, n in cast_losses(df, want).first().asDict().items() if n}
        if losses:
            raise InexactCast(f"values would change: {losses}")
    return df.select(*[(fill(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def joined_schema(known: T.StructType, seen: T.StructType) -> T.StructType:
    """Known columns widened to hold what is seen, new ones at the end; nothing narrows or goes."""
    new = {f.name: f for f in seen}
    out = []
    for f in known:
        shape = L.shape_of_spark(f.dataType, f.metadata)
        if f.name in new:
            other = new.pop(f.name)
            shape = L.join_shapes(shape, L.shape_of_spark(other.dataType, other.metadata))
        out.append(T.StructField(f.name, f.dataType if shape == L.shape_of_spark(f.dataType, f.metadata) else L.shape_to_spark(shape), True, f.metadata))
    return T.StructType(out + [f for f in seen if f.name in new])


def union_batches(batches: list[DataFrame], check: bool = True) -> DataFrame:
    """Batches of one stream under their joined schema."""
    schema = batches[0].schema
    for b in batches[1:]:
        schema = joined_schema(schema, b.schema)
    out = conform(batches[0], schema, check)
    for b in batches[1:]:
        out = out.unionByName(conform(b, schema, check))
    return out
