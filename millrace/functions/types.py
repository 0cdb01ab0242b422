"""Logical types, the lattice on which columns widen, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MAX_PRECISION = 38
#: Integers of larger magnitude have no exact double.
EXACT_INT = 1 << 53


@dataclass(frozen=True)
class Logical:
    """A scalar type; only decimals have a precision and scale."""

    name: str
    precision: int = 0
    scale: int = 0

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.name == "decimal" else self.name


BOOL, INT, FLOAT, TEXT, BINARY = (Logical(n) for n in ("bool", "int64", "float64", "utf8", "binary"))
INSTANT, DATETIME, DATE, TIME = (Logical(n) for n in ("timestamp_tz", "timestamp_naive", "date", "time"))
UUID, JSON = Logical("uuid"), Logical("json")
SCALARS = (BOOL, INT, FLOAT, TEXT, BINARY, INSTANT, DATETIME, DATE, TIME, UUID, JSON)


def decimal(precision: int, scale: int) -> Logical:
    if not 1 <= precision <= MAX_PRECISION or not 0 <= scale <= precision:
        raise ValueError(f"no decimal has {precision} digits of which {scale} are a fraction")
    return Logical("decimal", precision, scale)


def _cover(a: Logical, b: Logical) -> Logical:
    """The least decimal with the integer digits and the fraction of both; text if there is none."""
    scale = max(a.scale, b.scale)
    precision = max(a.precision - a.scale, b.precision - b.scale) + scale
    return Logical("decimal", precision, scale) if precision <= MAX_PRECISION else TEXT


def widen(a: Logical, b: Logical) -> Logical:
    """The least type that holds the values of both."""
    pair = {a.name, b.name}
    if a == b:
        return a
    if "json" in pair or "binary" in pair:
        return JSON
    if pair == {"decimal"}:
        return _cover(a, b)
    if pair == {"decimal", "int64"}:
        return _cover(*(Logical("decimal", 19, 0) if x == INT else x for x in (a, b)))
    if pair == {"int64", "float64"}:
        return FLOAT
    return TEXT


# ------------------------------------------------------------------------ shapes


@dataclass(frozen=True)
class Field:
    name: str
    shape: Shape


@dataclass(frozen=True)
class Shape:
    """A column: a scalar, a list of scalars, or a struct."""

    scalar: Logical | None = None
    item: Logical | None = None
    fields: tuple[Field, ...] | None = None

    def __str__(self) -> str:
        if self.scalar is not None:
            return str(self.scalar)
        if self.item is not None:
            return f"list<{self.item}>"
        return f"struct<{', '.join(f'{f.name}: {f.shape}' for f in self.fields or ())}>"


def scalar(t: Logical) -> Shape:
    return Shape(scalar=t)


def join_shapes(a: Shape, b: Shape) -> Shape:
    """Structs join field by field, new fields at the end; lists by item; different shapes are Json."""
    if a.scalar is not None and b.scalar is not None:
        return scalar(widen(a.scalar, b.scalar))
    if a.item is not None and b.item is not None:
        item = widen(a.item, b.item)
        return scalar(JSON) if item == JSON else Shape(item=item)
    if a.fields is not None and b.fields is not None:
        new = {f.name: f.shape for f in b.fields}
        old = [Field(f.name, join_shapes(f.shape, new.pop(f.name)) if f.name in new else f.shape) for f in a.fields]
        return Shape(fields=(*old, *(f for f in b.fields if f.name in new)))
    return scalar(JSON)


# ------------------------------------------------------------------- Spark types

_TO_SPARK = {"bool": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "utf8": T.StringType(), "binary": T.BinaryType(), "timestamp_tz": T.TimestampType(), "timestamp_naive": T.TimestampNTZType(), "date": T.DateType(), "time": T.LongType(), "uuid": T.StringType(), "json": T.StringType()}


def to_spark(t: Logical) -> T.DataType:
    """The physical type; times are microseconds of the day."""
    return T.DecimalType(t.precision, t.scale) if t.name == "decimal" else _TO_SPARK[t.name]


def shape_to_spark(s: Shape) -> T.DataType:
    if s.scalar is not None:
        return to_spark(s.scalar)
    if s.item is not None:
        return T.ArrayType(to_spark(s.item))
    return T.StructType([T.StructField(f.name, shape_to_spark(f.shape)) for f in s.fields or ()])


def of_spark(t: T.DataType, metadata: dict | None = None) -> Logical:
    """The logical type of a Spark scalar; what has none is refused."""
    logical = (metadata or {}).get("logical")
    if isinstance(t, T.StringType):
        return {"json": JSON, "uuid": UUID}.get(logical, TEXT)
    if isinstance(t, T.LongType) and logical == "time":
        return TIME
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, T.DecimalType):
        return Logical("decimal", t.precision, t.scale)
    for kind, logical_type in ((T.BooleanType, BOOL), (T.FloatType, FLOAT), (T.DoubleType, FLOAT), (T.BinaryType, BINARY), (T.TimestampType, INSTANT), (T.TimestampNTZType, DATETIME), (T.DateType, DATE)):
        if isinstance(t, kind):
            return logical_type
    raise TypeError(f"no logical type for {t.simpleString()}")


def shape_of_spark(t: T.DataType, metadata: dict | None = None) -> Shape:
    """The shape of a Spark type; maps, intervals, nested lists and lists of structs are refused."""
    if isinstance(t, T.StructType):
        return Shape(fields=tuple(Field(f.name, shape_of_spark(f.dataType, f.metadata)) for f in t))
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.ArrayType, T.StructType, T.MapType)):
            raise TypeError(f"lists hold scalars only, not {t.elementType.simpleString()}")
        return Shape(item=of_spark(t.elementType))
    return scalar(of_spark(t, metadata))
