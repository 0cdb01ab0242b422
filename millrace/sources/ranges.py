"""JSON lines by byte ranges: a data source whose tasks each read a span of one file.

A line belongs to the span in which it begins, so spans may be cut anywhere. The file must be one that all
executors can open by its path (a mounted shared folder).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a span, and lines of a batch.
SPAN, LINES = 16 << 20, 4096
SCHEMA = "line string, ordinal long"


class Span(InputPartition):
    """Bytes ``first`` up to ``past`` of the file."""

    def __init__(self, first: int, past: int):
        self.first, self.past = first, past


class LineRanges(DataSource):
    """``line`` and ``ordinal`` (its first byte) of the lines from ``start`` up to ``end``, both at line starts."""

    @classmethod
    def name(cls) -> str:
        return "millrace_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LineReader:
        o = self.options
        return LineReader(o["path"], int(o["start"]), int(o["end"]), int(o.get("span", SPAN)))


class LineReader(DataSourceReader):
    def __init__(self, path: str, start: int, end: int, span: int):
        self.path, self.start, self.end, self.span = path, start, end, span

    def partitions(self) -> list[InputPartition]:
        return [Span(a, min(a + self.span, self.end)) for a in range(self.start, self.end, self.span)] or [Span(self.start, self.start)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        places: list[int] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(places, pa.int64())], ["line", "ordinal"])

        with open(self.path, "rb") as f:
            at = partition.first
            f.seek(max(at - 1, self.start))
            if at > self.start:
                at += len(f.readline()) - 1
            while at < partition.past:
                raw = f.readline()
                if raw.strip():
                    lines.append(raw.rstrip(b"\n").decode())
                    places.append(at)
                at += len(raw)
                if len(lines) >= LINES:
                    yield batch()
                    lines, places = [], []
        if lines:
            yield batch()


def lines_between(spark: SparkSession, path: str, start: int, end: int, span: int = SPAN) -> DataFrame:
    spark.dataSource.register(LineRanges)
    return spark.read.format(LineRanges.name()).options(path=path, start=start, end=end, span=span).load()
