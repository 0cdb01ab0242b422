"""Lowering to what a destination can hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.functions.columns import decimal_text


@dataclass(frozen=True)
class Capabilities:
    """What a destination declares."""

    merge: bool = True
    structs: bool = True
    scalar_lists: bool = True
    json_type: bool = False
    decimal: bool = True
    requires_durable_identity: bool = False
    max_name: int = N.MAX_NAME


def lower(df: DataFrame, to: Capabilities) -> DataFrame:
    """Structs flattened to ``a__b`` and decimals to exact text, where the destination lacks them.

    A null struct gives null fields. Names that meet get a hash of their path.
    """
    namer = N.UniqueNamer(to.max_name, reserved=())
    out: list[Column] = []

    def visit(c: Column, t: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(t, T.StructType) and not to.structs:
            for f in t:
                visit(c[f.name], f.dataType, (*path, f.name))
            return
        name = namer.name_for("__".join(path), "\x1f".join(path))
        out.append((decimal_text(c) if isinstance(t, T.DecimalType) and not to.decimal else c).alias(name))

    # Plain columns come first, so that they keep their names.
    for f in sorted(df.schema, key=lambda f: isinstance(f.dataType, T.StructType)):
        visit(F.col(f"`{f.name}`"), f.dataType, (f.name,))
    return df.select(*out)
