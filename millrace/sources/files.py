"""Sources of files: JSON lines by byte offset, and typed files by cursor column."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.base import Batch, Source, SourceError, StreamSpec
from millrace.sources.ranges import lines_between

#: A batch ends at so many rows or bytes; one line may have so many bytes; so much of a tail is hashed.
BATCH_ROWS, BATCH_BYTES, LINE_BYTES, TAIL_BYTES = 1024, 8 << 20, 8 << 20, 4096


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, ordinal`` of every line with something in it: a distributed read of any number of files.

    Ordinals follow file and line; a last line without its end counts here, see ``JsonLines`` for resuming.
    """
    whole = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    numbered = whole.withColumn("__n", F.monotonically_increasing_id())
    return numbered.where(F.trim("line") != "").select("line", F.col("__n").alias("ordinal"))


def tail_hash(path: str, end: int) -> str:
    """A digest of the bytes before ``end``."""
    with open(path, "rb") as f:
        f.seek(max(0, end - TAIL_BYTES))
        return hashlib.sha256(f.read(end - max(0, end - TAIL_BYTES))).hexdigest()


def _last_end(f: BinaryIO, at: int) -> int:
    """Past the last line end after ``at``, or ``at``."""
    end = f.seek(0, os.SEEK_END)
    while end > at:
        first = max(at, end - (1 << 16))
        f.seek(first)
        if (n := f.read(end - first).rfind(b"\n")) >= 0:
            return first + n + 1
        end = first
    return at


class JsonLines(Source):
    """A directory of ``*.jsonl`` on the driver's file system: a stream a file, resumed by byte offset.

    Only lines that have their end are read. A file that shrank, or whose bytes before the cursor changed,
    is refused. With ``batch_bytes`` a batch is so many bytes and is read by the executors, in spans; else the
    driver reads batches of ``batch_rows``.
    """

    def __init__(self, directory: str, specs: dict[str, StreamSpec] | None = None, batch_rows: int = BATCH_ROWS, batch_bytes: int | None = None):
        self.directory, self.specs, self.batch_rows, self.batch_bytes = directory, specs or {}, batch_rows, batch_bytes

    def check(self, spark: SparkSession) -> None:
        if not os.path.isdir(self.directory):
            raise SourceError(f"no directory {self.directory}")

    def streams(self, spark: SparkSession) -> list[StreamSpec]:
        names = sorted(n.removesuffix(".jsonl") for n in os.listdir(self.directory) if n.endswith(".jsonl"))
        return [self.specs.get(n, StreamSpec(n)) for n in names]

    def read(self, spark: SparkSession, stream: StreamSpec, since: Any) -> Iterator[Batch]:
        path = os.path.join(self.directory, f"{stream.name}.jsonl")
        at = 0
        begun = at
        if since is not None:
            at = begun = since["bytes_read"]
            if os.path.getsize(path) < at:
                raise SourceError(f"{path} is shorter than what has been read of it")
            if tail_hash(path, at) != since["tail_hash"]:
                raise SourceError(f"{path} was rewritten before byte {at}")
        if self.batch_bytes:
            yield from self._spans(spark, path, at)
            return
        lines: list[tuple[str, int]] = []
        size = 0
        emitted = False
        with open(path, "rb") as f:
            f.seek(at)
            while True:
                raw = f.readline(LINE_BYTES + 2)
                if not raw.endswith(b"\n"):
                    if len(raw) > LINE_BYTES:
                        raise SourceError(f"a line of {path} at byte {at} is longer than {LINE_BYTES} bytes")
                    break
                if raw.strip():
                    lines.append((raw[:-1].decode(), at))
                    size += len(raw)
                at += len(raw)
                if len(lines) >= self.batch_rows or size >= BATCH_BYTES:
                    yield self._batch(spark, path, lines, begun, at)
                    lines, size, emitted, begun = [], 0, True, at
        if lines or not emitted:
            yield self._batch(spark, path, lines, begun, at)

    def _spans(self, spark: SparkSession, path: str, at: int) -> Iterator[Batch]:
        """Batches that end at the first line end from ``batch_bytes`` on; a last line without its end waits."""
        emitted = False
        with open(path, "rb") as f:
            while True:
                f.seek(at + self.batch_bytes - 1)
                past = f.tell() if f.readline().endswith(b"\n") else _last_end(f, at)
                if past > at or not emitted:
                    rows = lines_between(spark, path, at, past)
                    yield Batch(rows, {"v": 1, "bytes_read": past, "tail_hash": tail_hash(path, past)}, past - at)
                    emitted = True
                if past < at + self.batch_bytes:
                    return
                at = past

    @staticmethod
    def _batch(spark: SparkSession, path: str, lines: list[tuple[str, int]], begun: int, at: int) -> Batch:
        rows = spark.createDataFrame(lines, "line string, ordinal long")
        return Batch(rows, {"v": 1, "bytes_read": at, "tail_hash": tail_hash(path, at)}, at - begun)


class TypedFiles(Source):
    """Parquet, ORC, CSV or JDBC tables: structured streams, read on by a cursor column.

    The cursor filter reaches the scan. ``options`` go to Spark's reader; a CSV needs a schema. A row without a
    cursor has no place among loads, so a table with one is refused at every read.
    """

    def __init__(self, tables: dict[str, str], format: str = "parquet", keys: dict[str, tuple[str, ...]] | None = None, cursors: dict[str, str] | None = None, schemas: dict[str, str] | None = None, **options: str):
        self.tables, self.format, self.options = tables, format, options
        self.keys, self.cursors, self.schemas = keys or {}, cursors or {}, schemas or {}

    def _load(self, spark: SparkSession, name: str) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.option("dbtable", self.tables[name]).load() if self.format == "jdbc" else reader.load(self.tables[name])

    def check(self, spark: SparkSession) -> None:
        for name in self.tables:
            _ = self._load(spark, name).schema

    def streams(self, spark: SparkSession) -> list[StreamSpec]:
        return [StreamSpec(n, self.keys.get(n, ()), self.cursors.get(n), structured=True) for n in self.tables]

    def read(self, spark: SparkSession, stream: StreamSpec, since: Any) -> Iterator[Batch]:
        df = self._load(spark, stream.name)
        if stream.cursor_field is None:
            yield Batch(df, None)
            return
        new = since_cursor(df, stream.cursor_field, since)
        without = F.col(stream.cursor_field).isNull()
        seen = new if since is None else df.where(without | (F.col(stream.cursor_field) > F.lit(since).cast(df.schema[stream.cursor_field].dataType)))
        top, lost = seen.agg(F.max(stream.cursor_field).cast("string"), F.count_if(without)).first()
        if lost:
            raise SourceError(f"{lost} rows of {stream.name} have no {stream.cursor_field}: they can't be read by cursor")
        df = new
        upto = df.where(F.col(stream.cursor_field) <= F.lit(top).cast(df.schema[stream.cursor_field].dataType)) if top is not None else df.limit(0)
        yield Batch(upto, top if top is not None else since)


def since_cursor(df: DataFrame, column: str, since: Any) -> DataFrame:
    """Rows after the cursor."""
    return df if since is None else df.where(F.col(column) > F.lit(since).cast(df.schema[column].dataType))


class Scripted(Source):
    """Given batches, for tests: resumes after the batch of the cursor; an unknown cursor is fatal."""

    def __init__(self, streams: dict[StreamSpec, list[tuple[DataFrame, Any]]] | list[tuple[StreamSpec, list[tuple[DataFrame, Any]]]]):
        self.script = list(streams.items()) if isinstance(streams, dict) else list(streams)

    def check(self, spark: SparkSession) -> None:
        return None

    def streams(self, spark: SparkSession) -> list[StreamSpec]:
        return [s for s, _ in self.script]

    def read(self, spark: SparkSession, stream: StreamSpec, since: Any) -> Iterator[Batch]:
        batches = next(b for s, b in self.script if s.name == stream.name)
        first = 0
        if since is not None:
            places = [n for n, (_, c) in enumerate(batches) if c == since]
            if not places:
                raise SourceError(f"unknown cursor {since!r}")
            first = places[-1] + 1
        for rows, cursor in batches[first:]:
            yield Batch(rows, cursor)
