"""Nested rows into a root table and child tables at any depth, with lineage.

``shred`` takes typed nested data (structs and arrays) and is plain projection: one select and one
generator a table, no shuffle, no Python. Lists of structs become child tables, lists of scalars stay
columns or become child tables of ``value``, structs stay structs. Identities are SHA-256 over
length-prefixed key fields, or over the row as JSON with sorted fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.functions.columns import length_prefixed, long_bytes, plain_float
from millrace.functions.values import CHILD, KEYED, KEYLESS


def _sorted_fields(c: Column, t: T.DataType) -> Column:
    """The same value with the fields of all structs in order of name."""
    if isinstance(t, T.StructType):
        made = F.struct(*[_sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(t, key=lambda f: f.name)])
        return F.when(c.isNull(), F.lit(None)).otherwise(made)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted_fields(x, t.elementType))
    return c


def content_key(row: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Identity of a row by content: equal whatever the order of its fields."""
    names = sorted(columns or row.columns)
    whole = F.struct(*[_sorted_fields(F.col(f"`{n}`"), row.schema[n].dataType).alias(n) for n in names])
    return F.sha2(F.concat(F.lit(KEYLESS), length_prefixed(F.to_json(whole, {"ignoreNullFields": "false"}))), 256)


def _key_text(name: str, t: T.DataType | None) -> Column:
    c = F.col(f"`{name}`")
    return plain_float(c) if isinstance(t, T.DoubleType) else c.cast("string")


def declared_key(columns: Sequence[str], schema: T.StructType | None = None) -> Column:
    """Identity of a row by key columns: stable when other columns change. With the schema, 1.0 and 1 are one."""
    types = {f.name: f.dataType for f in schema or ()}
    parts: list[Column] = [F.lit(KEYED)]
    for name in columns:
        # Bound by name when it is used, so it may be of any type; only doubles are rendered on their own.
        value = _key_text(name, types.get(name))
        parts += [length_prefixed(F.lit(name)), F.when(value.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), length_prefixed(value)))]
    return F.sha2(F.concat(*parts), 256)


def _child_key(item: Column, t: T.DataType) -> Column:
    row = _sorted_fields(item, t) if isinstance(t, T.StructType) else F.struct(_sorted_fields(item, t).alias("value"))
    content = F.sha2(F.concat(F.lit(KEYLESS), length_prefixed(F.to_json(row, {"ignoreNullFields": "false"}))), 256)
    return F.sha2(F.concat(F.lit(CHILD), F.unhex(F.col(N.PARENT_ID)), long_bytes(F.col(N.POS)), F.unhex(content)), 256)


def _is_child(t: T.DataType, scalar_lists: bool) -> bool:
    return isinstance(t, T.ArrayType) and (isinstance(t.elementType, T.StructType) or (scalar_lists and not isinstance(t.elementType, T.ArrayType)))


def shred(df: DataFrame, table: str, load_id: str, key: Sequence[str] | None = None, scalar_lists_as_children: bool = False) -> dict[str, DataFrame]:
    """All tables of a nested DataFrame: the root first, children by ``parent__field``.

    Null list items take a position and make no row. Children carry their parent's and their root's id.
    """
    whole = df.withColumn(N.ROW_ID, declared_key(key, df.schema) if key else content_key(df)).withColumn(N.LOAD_ID, F.lit(load_id))
    tables: dict[str, DataFrame] = {}

    def split(now: DataFrame, name: str, system: list[str], fields: list[T.StructField], own: dict[str, Column]) -> None:
        namer = N.UniqueNamer()
        plain = [(own[f.name], namer.name_for(f.name)) for f in fields if not _is_child(f.dataType, scalar_lists_as_children)]
        tables[name] = now.select(*system, *[c.alias(n) for c, n in plain])
        for f in fields:
            if not _is_child(f.dataType, scalar_lists_as_children):
                continue
            t = f.dataType.elementType
            root = F.col(N.ROOT_ID) if N.ROOT_ID in system else F.col(N.ROW_ID)
            items = now.select(N.LOAD_ID, F.col(N.ROW_ID).alias(N.PARENT_ID), root.alias(N.ROOT_ID), F.posexplode(own[f.name]).alias(N.POS, "__item")).where("__item is not null")
            items = items.withColumn(N.POS, F.col(N.POS).cast("long")).withColumn(N.ROW_ID, _child_key(F.col("__item"), t))
            below = list(t) if isinstance(t, T.StructType) else [T.StructField("value", t)]
            inner = {g.name: F.col("__item")[g.name] for g in below} if isinstance(t, T.StructType) else {"value": F.col("__item")}
            child = N.child_table_name(name, f.name)
            if child in tables:
                raise ValueError(f"two lists would share the table {child}")
            split(items, child, [N.LOAD_ID, N.ROW_ID, N.PARENT_ID, N.POS, N.ROOT_ID], below, inner)

    split(whole, N.normalize_ident(table), [N.LOAD_ID, N.ROW_ID], list(df.schema), {f.name: F.col(f"`{f.name}`") for f in df.schema})
    return tables


def orphans(child: DataFrame, parent: DataFrame, column: str = N.PARENT_ID) -> DataFrame:
    """Child rows whose parent (or root) isn't there."""
    return child.join(parent.select(F.col(N.ROW_ID).alias("__id")), F.col(column) == F.col("__id"), "left_anti")


def reassemble(parent: DataFrame, child: DataFrame, prefix: str = "child_") -> DataFrame:
    """Each child row beside its parent."""
    renamed = child.select(*[F.col(c).alias(prefix + c) for c in child.columns])
    return parent.join(renamed, parent[N.ROW_ID] == renamed[prefix + N.PARENT_ID])
