"""Schemas of raw JSON: observe in Arrow batches, fold by aggregation, build typed tables.

Pass one parses every line once and emits, per batch, what was seen of each (table, key): kinds, inexact
integers, the first place. These are sets of flags, so folding them is a grouped ``bool_or``: partial
aggregation leaves a few rows a task, and the order of partitions doesn't matter. The driver sees one row
per column. Pass two parses again and emits typed rows of all tables.

A key that holds both nested and scalar values, or objects and lists, anywhere is Json for the whole input
and makes no child rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.functions import types as L
from millrace.functions import values as V

#: Flags of an observation; ``i_`` flags are of list items.
_KINDS = ("bool", "int", "uint", "float", "instant", "str", "object", "array")
FLAGS = (*_KINDS, "inexact", "i_object", "i_nested", *(f"i_{k}" for k in _KINDS[:6]), "i_inexact")
#: Limits of a push.
MAX_DEPTH, MAX_COLUMNS, MAX_CHILDREN, MAX_VALUES = 64, 4096, 1024, 1 << 20
#: Lines whose rows are emitted together, and rows that are held to be observed together.
TOGETHER, HELD = 256, 1 << 14
#: The shortest text that is an instant.
_INSTANT_LENGTH = len("0000-00-00T00:00:00Z")
_STEP = "\x1f"


class Limit(ValueError):
    """A document or schema beyond the limits."""


def _flags(v: Any, lead: str = "") -> tuple[str, ...]:
    k = V.kind(v)
    if k == "null":
        return ()
    if k == "str":
        return (f"{lead}{'instant' if V.parse_instant(v) is not None else 'str'}",)
    if k == "int" and abs(v) > L.EXACT_INT:
        return (f"{lead}int", f"{lead}inexact")
    return (lead + k,)


def _flags_of(values: Sequence[Any], lead: str = "") -> set[str]:
    """``_flags`` of all values; types and ranges are looked at before single values."""
    out: set[str] = set()
    for t in set(map(type, values)):
        if t in (bool, float):
            out.add(lead + V.kind(t()))
            continue
        some = [v for v in values if type(v) is t]
        if t is int and -L.EXACT_INT <= min(some) and max(some) <= L.EXACT_INT:
            out.add(f"{lead}int")
        elif t is str:
            long = {v for v in some if len(v) >= _INSTANT_LENGTH}
            if len(long) < len(some) and any(len(v) < _INSTANT_LENGTH for v in some):
                out.add(f"{lead}str")
            out.update(*(_flags(v, lead) for v in long))
        elif t in (dict, list):
            out.add(lead + V.kind(t()))
        else:
            out.update(*(_flags(v, lead) for v in some))
    return out


class _Observer:
    """What objects show: ``seen`` has (table, path) -> flags in order of sight. Fields of structs have longer paths.

    Scalars of objects of one form are held and looked at together, column by column.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple, set[str]] = {}
        self._forms: dict[tuple, dict[tuple, tuple[list[str], list[tuple]]]] = {}
        self._held = 0

    def add(self, rows: Sequence[dict], table: tuple[str, ...] = (), path: tuple[str, ...] = (), depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise Limit(f"documents may be {MAX_DEPTH} deep")
        here = self._forms.setdefault((table, path), {})
        for row in rows:
            form = (*row, *map(type, row.values()))
            if (known := here.get(form)) is None:
                for key, v in row.items():
                    self.seen.setdefault((table, (*path, key)), set())
                    self._below(v, table, (*path, key), depth)
                known = here[form] = ([k for k, v in row.items() if isinstance(v, (dict, list))], [])
            else:
                for key in known[0]:
                    self._below(row[key], table, (*path, key), depth)
            known[1].append(tuple(row.values()))
        self._held += len(rows)

    def _below(self, v: Any, table: tuple[str, ...], own: tuple[str, ...], depth: int) -> None:
        if isinstance(v, dict):
            self.add((v,), table, own, depth + 1)
        elif isinstance(v, list):
            flags = self.seen[table, own]
            objects = [x for x in v if isinstance(x, dict)]
            if objects:
                flags.add("i_object")
                self.add(objects, (*table, _STEP.join(own)), (), depth + 1)
            if len(objects) < len(v):
                rest = [x for x in v if not isinstance(x, (dict, list))]
                if len(objects) + len(rest) < len(v):
                    flags.add("i_nested")
                flags |= _flags_of(rest, "i_")

    def fold(self, least: int = 0) -> None:
        """Take over what is held, if that are so many rows."""
        if self._held < least:
            return
        for (table, path), forms in self._forms.items():
            for form, (_, rows) in forms.items():
                for key, values in zip(form, zip(*rows, strict=True)):
                    self.seen[table, (*path, key)] |= _flags_of(values)
        self._forms, self._held = {}, 0


def observe(lines: DataFrame, text: str = "line", ordinal: str = "ordinal") -> DataFrame:
    """``path, key, flags..., first``: one row a column, folded over all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            observer = _Observer()
            seen, first = observer.seen, {}
            for text_, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in V.documents(text_ or ""):
                    if len(text_) > MAX_VALUES and _size(row) > MAX_VALUES:
                        raise Limit(f"documents may have {MAX_VALUES} values")
                    observer.add((V.as_row(row),))
                    observer.fold(HELD)
                if len(first) < len(seen):
                    for n, k in enumerate(islice(seen, len(first), None), len(first)):
                        first[k] = (at, n)
            observer.fold()
            rows = [{"path": "\x1e".join(t), "key": _STEP.join(k), "first": first[t, k][0], "place": first[t, k][1], **{f: f in flags for f in FLAGS}} for (t, k), flags in seen.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("key", pa.string()), ("first", pa.int64()), ("place", pa.int64()), *((f, pa.bool_()) for f in FLAGS)]))

    schema = "path string, key string, first long, place long, " + ", ".join(f"{f} boolean" for f in FLAGS)
    seen = lines.select(text, F.col(ordinal).cast("long")).mapInArrow(run, schema)
    return seen.groupBy("path", "key").agg(F.min(F.struct("first", "place")).alias("first"), *[F.bool_or(f).alias(f) for f in FLAGS])


_TYPES = {"bool": L.BOOL, "int": L.INT, "uint": L.TEXT, "float": L.FLOAT, "instant": L.INSTANT, "str": L.TEXT}


def scalar_type(flags: set[str], lead: str = "") -> L.Logical | None:
    """The join of the scalar kinds seen; an integer that no double holds makes a float column text."""
    out: L.Logical | None = None
    for k, t in _TYPES.items():
        if lead + k in flags:
            out = t if out is None else L.widen(out, t)
    return L.TEXT if out == L.FLOAT and lead + "inexact" in flags else out


@dataclass
class Table:
    """A resolved table: columns in order of first sight (source path, name, shape), and child tables by field."""

    name: str
    columns: list[tuple[str, str, L.Shape]] = field(default_factory=list)
    children: dict[str, Table] = field(default_factory=dict)

    def spark_schema(self, child: bool) -> T.StructType:
        system = [N.LOAD_ID, N.ROW_ID, *((N.PARENT_ID, N.POS, N.ROOT_ID) if child else ())]
        fields = [T.StructField(s, T.LongType() if s == N.POS else T.StringType()) for s in system]
        return T.StructType(fields + [T.StructField(n, L.shape_to_spark(s), True, {"logical": str(s.scalar)} if s.scalar in (L.JSON, L.UUID, L.TIME) else {}) for _, n, s in self.columns])

    def walk(self) -> Iterator[Table]:
        yield self
        for c in self.children.values():
            yield from c.walk()


def resolve(observed: DataFrame, table: str, hints: dict[str, L.Logical] | None = None, native_lists: bool = True) -> Table:
    """The tables of an observation; ``hints`` pin the types of root columns."""
    # One row per distinct column of the input, checked against the limits below.
    rows = sorted(observed.collect(), key=lambda r: (tuple(r["first"]), r["path"], r["key"]))
    seen = {(r["path"], r["key"]): {f for f in FLAGS if r[f]} for r in rows}
    hints = hints or {}

    def shape(path: str, key: str, pinned: L.Logical | None) -> tuple[L.Shape | None, bool]:
        """Shape, and whether the field is a child table instead."""
        flags = seen[path, key]
        if pinned is not None:
            return L.scalar(pinned), False
        scalars = scalar_type(flags)
        nested = {k for k in ("object", "array") if k in flags}
        if scalars is not None and nested or len(nested) > 1:
            return L.scalar(L.JSON), False
        if "object" in flags:
            fields = tuple(L.Field(k.split(_STEP)[-1], s) for p, k in seen if p == path and k.rpartition(_STEP)[0] == key and (s := shape(p, k, None)[0]) is not None)
            return (L.Shape(fields=fields), False) if fields else (None, False)
        if "array" in flags:
            items = scalar_type(flags, "i_")
            if "i_nested" in flags or ("i_object" in flags and items is not None):
                return L.scalar(L.JSON), False
            if "i_object" in flags:
                # Lists of objects inside a struct stay text: children belong to rows.
                return (L.scalar(L.JSON), False) if _STEP in key else (None, True)
            if items is None:
                return None, False
            if not native_lists and _STEP not in key:
                return None, True
            return L.Shape(item=items), False
        return (L.scalar(scalars), False) if scalars is not None else (None, False)

    def build(path: str, name: str) -> Table:
        out, namer = Table(name), N.UniqueNamer()
        for p, k in seen:
            if p == path and _STEP not in k:
                found, child = shape(p, k, hints.get(k) if not path else None)
                if child:
                    below = build(f"{path}\x1e{k}" if path else k, N.child_table_name(name, k))
                    if "i_object" not in seen[p, k]:
                        below.columns = [("value", "value", L.scalar(scalar_type(seen[p, k], "i_")))]
                    out.children[k] = below
                elif found is not None:
                    out.columns.append((k, namer.name_for(k), found))
        if sum(_leaves(s) for _, _, s in out.columns) > MAX_COLUMNS or len(out.children) > MAX_CHILDREN:
            raise Limit(f"table {name} has too many columns or children")
        return out

    return build("", N.normalize_ident(table))


def _leaves(s: L.Shape) -> int:
    """Columns of a shape, struct fields at every depth."""
    return sum(_leaves(f.shape) for f in s.fields) if s.fields else 1


def _size(v: Any) -> int:
    """Values in a document."""
    if isinstance(v, dict):
        return sum(map(_size, v.values())) + 1
    return sum(map(_size, v)) + 1 if isinstance(v, list) else 1


def _fit_shape(v: Any, s: L.Shape) -> Any:
    if v is None:
        return None
    if s.scalar is not None:
        return V.fit(v, s.scalar)
    if s.item is not None:
        return [V.fit(x, s.item) for x in v] if isinstance(v, list) else None
    return {f.name: _fit_shape(v.get(f.name), f.shape) for f in s.fields or ()} if isinstance(v, dict) else None


def _misfits(v: Any, out: Any) -> int:
    """Values that weren't null and came out as null, at every depth."""
    if v is None:
        return 0
    if out is None:
        return 1
    if isinstance(out, dict):
        return sum(_misfits(v.get(k), x) for k, x in out.items())
    return sum(map(_misfits, v, out)) if isinstance(out, list) else 0


#: Types of which JSON values are taken as they are.
_PLAIN = {"bool": bool, "int64": int, "float64": float, "utf8": str, "uuid": str}


def _plain(values: Sequence[Any], s: L.Shape) -> bool:
    """Whether all values are of the shape as they are: nothing to convert, no misfits."""
    t = _PLAIN.get(s.scalar.name) if s.scalar is not None else None
    if t is None or not {t, type(None)}.issuperset(map(type, values)):
        return False
    return t is not int or all(V.kind(v) in ("int", "null") for v in (min(filter(None, values), default=0), max(filter(None, values), default=0)))


def together(lines: DataFrame, resolved: Table, load_id: str, key: list[str] | None = None, text: str = "line", known: dict[str, T.StructType] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Typed rows of all tables in one pass: some lines make one row with a list of each table's rows, see ``build``.

    Also the column of each table. For consumers that need several tables once.
    """
    order = list(resolved.walk())
    if len(order) > MAX_CHILDREN:
        raise Limit(f"{resolved.name} has too many tables")
    tests = {t.name: _changed(t, (known or {}).get(t.name)) for t in order}
    number = {id(t): n for n, t in enumerate(order)}
    below = [[(source, number[id(child)]) for source, child in t.children.items()] for t in order]

    def columns(t: Table, rows: list[dict], forms: list, ids: list[bytes], lineage: dict[str, list]) -> dict[str, Sequence]:
        made: dict[str, Sequence] = {N.LOAD_ID: [load_id] * len(rows), N.ROW_ID: [i.hex() for i in ids], **lineage}
        bad = [0] * len(rows)
        alike = forms[0][1] if len(forms) == 1 else None
        for source, name, s in t.columns:
            values = [r.get(source) for r in rows] if alike is None else alike[source] if source in alike else [None] * len(rows)
            if not _plain(values, s):
                found, values = values, [_fit_shape(v, s) for v in values]
                bad = [n + _misfits(v, x) for n, v, x in zip(bad, found, values, strict=True)]
            made[name] = values
        made["_misfits"] = bad
        changed = tests[t.name]
        made["_unfit"] = [[name for source, name, s in changed if not V.admits_shape(r.get(source), s)] if changed else [] for r in rows]
        return made

    def tables(documents: list[dict]) -> dict[str, list[dict[str, Sequence]]]:
        """Of each name, the columns of the tables that have it; parents come first."""
        out: dict[str, list[dict[str, Sequence]]] = {}
        forms = V.columns_of(documents)
        ids = [bytes.fromhex(V.keyed_id(r, key)) for r in documents] if key else V.content_digests(len(documents), forms)
        given: list = [None] * len(order)
        given[0] = (documents, forms, ids, None, {})
        for n, t in enumerate(order):
            rows, forms, ids, roots, lineage = given[n]
            given[n] = None
            made = columns(t, rows, forms, ids, lineage)
            own = made[N.ROW_ID]
            out.setdefault(t.name, []).append(made)
            for source, child in below[n]:
                found = [(p, pos, V.as_row(x)) for p, r in enumerate(rows) if isinstance(items := r.get(source), list) for pos, x in enumerate(items) if x is not None]
                parents, places, objects = map(list, zip(*found, strict=True)) if found else ([], [], [])
                forms = V.columns_of(objects)
                contents = V.content_digests(len(objects), forms)
                made_ids = [V.child_digest(ids[p], pos, c) for p, pos, c in zip(parents, places, contents, strict=True)]
                above = roots or own
                parent_ids, root_ids = [own[p] for p in parents], [above[p] for p in parents]
                given[child] = (objects, forms, made_ids, root_ids, {N.PARENT_ID: parent_ids, N.POS: places, N.ROOT_ID: root_ids})
        return out

    from pyspark.sql.pandas.types import to_arrow_schema

    schemas = [t.spark_schema(t is not resolved).add("_misfits", T.LongType()).add("_unfit", T.ArrayType(T.StringType())) for t in order]
    kinds = [list(to_arrow_schema(s)) for s in schemas]
    names = [f"t{n}" for n in range(len(order))]

    def listed(parts: list[dict[str, Sequence]], fields: list[pa.Field]) -> pa.ListArray:
        """All rows as one list."""
        n = sum(len(p[N.ROW_ID]) for p in parts)
        arrays = [pa.array([v for p in parts for v in p.get(f.name) or [None] * len(p[N.ROW_ID])] if len(parts) > 1 else parts[0][f.name], f.type) for f in fields]
        return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.StructArray.from_arrays(arrays, fields=fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first in range(0, len(texts), TOGETHER):
                out = tables([V.as_row(row) for text_ in texts[first : first + TOGETHER] for row in V.documents(text_ or "")])
                yield pa.RecordBatch.from_arrays([listed(out[t.name], k) for t, k in zip(order, kinds, strict=True)], names)

    whole = lines.select(text).mapInArrow(run, T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in zip(names, schemas, strict=True)]))
    return whole, {t.name: n for t, n in zip(order, names, strict=True)}


def build(lines: DataFrame, resolved: Table, load_id: str, key: list[str] | None = None, text: str = "line", known: dict[str, T.StructType] | None = None, held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """Typed rows of every table with lineage; each also has ``_misfits``, the values that became null, and
    ``_unfit``, the names of columns whose value isn't of the type in ``known``.

    A line is parsed once for all tables, see ``together``. That row set is persisted and put into ``held`` if there
    is one; a consumer that writes several tables should ask for it.
    """
    whole, columns = together(lines, resolved, load_id, key, text, known)
    if held is not None:
        held.append(whole.persist())
    return {t: whole.select(F.inline(c)) for t, c in columns.items()}


def _changed(t: Table, known: T.StructType | None) -> list[tuple[str, str, L.Shape]]:
    """Columns of a table that the known type doesn't hold, with that type."""
    out = []
    for source, name, s in t.columns:
        if known is not None and name in known.names:
            shape = L.shape_of_spark(known[name].dataType, known[name].metadata)
            if L.join_shapes(shape, s) != shape:
                out.append((source, name, shape))
    return out


def infer_types(lines: DataFrame, text: str = "line", ordinal: str = "ordinal") -> DataFrame:
    """``table_name, column_name, logical_type`` of all tables of the lines."""
    resolved = resolve(observe(lines, text, ordinal), "root")
    rows = [(t.name, n, str(s)) for t in resolved.walk() for _, n, s in t.columns]
    return lines.sparkSession.createDataFrame(rows, "table_name string, column_name string, logical_type string")
