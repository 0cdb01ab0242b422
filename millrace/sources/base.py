"""What sources and destinations are to the engine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.types import Logical
from millrace.operators.lower import Capabilities


class SourceError(Exception):
    """A failed read. ``retry``: another attempt may do; ``after``: seconds to wait first."""

    def __init__(self, message: str, retry: bool = False, after: float | None = None):
        super().__init__(message)
        self.retry, self.after = retry, after


class DestinationError(SourceError):
    """A failed write."""


@dataclass(frozen=True)
class StreamSpec:
    """A stream of a source; it becomes one root table."""

    name: str
    primary_key: tuple[str, ...] = ()
    cursor_field: str | None = None
    type_hints: dict[str, Logical] = field(default_factory=dict)
    structured: bool = False


@dataclass
class Batch:
    """Rows up to a cursor: typed rows, or text lines in ``line`` with their ``ordinal``. No cursor: not a boundary."""

    rows: DataFrame
    cursor: Any = None
    #: Bytes, where the source knows them.
    size: int | None = None


class Source(ABC):
    """Streams of records that can be read on from a cursor. Rows that a cursor covers don't come again."""

    @abstractmethod
    def check(self, spark: SparkSession) -> None:
        """Raise if the source can't be read; moves no data."""

    @abstractmethod
    def streams(self, spark: SparkSession) -> list[StreamSpec]:
        """The streams there are."""

    @abstractmethod
    def read(self, spark: SparkSession, stream: StreamSpec, since: Any) -> Iterator[Batch]:
        """Batches after ``since`` (None: from the start)."""


class Destination(ABC):
    """Tables that change by atomic commits."""

    capabilities: Capabilities = Capabilities()

    @abstractmethod
    def check(self, spark: SparkSession) -> None:
        """Raise if the destination can't be written; moves no data."""

    @abstractmethod
    def read_state(self, pipeline: str) -> dict:
        """The state of the pipeline's last commit: cursors, schemas, commit."""
