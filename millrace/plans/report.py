"""Reports, events and metrics of loads."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any, TextIO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATE_SECONDS = 5.0


@dataclass
class Report:
    """What a run did, exactly."""

    pipeline: str
    load_id: str
    resumed: str = "fresh"
    commits: int = 0
    attempts: int = 1
    rows_read: dict[str, int] = field(default_factory=dict)
    rows_written: dict[str, int] = field(default_factory=dict)
    discarded_rows: dict[str, int] = field(default_factory=dict)
    discarded_values: dict[str, int] = field(default_factory=dict)
    migrations: int = 0
    seconds: float = 0.0

    @property
    def total_rows(self) -> int:
        return sum(self.rows_written.values())

    @property
    def rows_per_second(self) -> float:
        return self.total_rows / self.seconds if self.seconds else 0.0


@dataclass(frozen=True)
class Event:
    """Something that happened in a run, in causal order by ``n``."""

    n: int
    kind: str
    at: float
    data: dict[str, Any]


KINDS = ("run_started", "resumed", "stream_started", "checkpoint", "table_created", "table_migrated", "discarded", "batch_staged", "committed", "retrying", "stream_finished", "cancelled", "run_finished")


class Events:
    """Numbers events and hands them to listeners; a listener that fails is left out, never the run."""

    def __init__(self, listeners: list[Callable[[Event], None]] | None = None):
        self.listeners, self._n = list(listeners or ()), 0

    def emit(self, kind: str, **data: Any) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        event = Event(self._n, kind, time.time(), data)
        self._n += 1
        for listener in list(self.listeners):
            try:
                listener(event)
            except Exception:
                self.listeners.remove(listener)


def ndjson(out: TextIO) -> Callable[[Event], None]:
    """A listener that writes a line an event."""
    return lambda e: print(json.dumps(asdict(e), default=str), file=out, flush=True)


@dataclass
class Metrics:
    """A live fold of events: sums, and the rate over the last seconds."""

    rows: int = 0
    commits: int = 0
    retries: int = 0
    migrations: int = 0
    discarded: int = 0
    by_table: dict[str, int] = field(default_factory=dict)
    _recent: deque = field(default_factory=deque)

    def __call__(self, e: Event) -> None:
        if e.kind == "committed":
            self.commits += 1
            for table, n in e.data["rows"].items():
                self.by_table[table] = self.by_table.get(table, 0) + n
                self.rows += n
            self._recent.append((e.at, sum(e.data["rows"].values())))
        self.retries += e.kind == "retrying"
        self.migrations += e.kind == "table_migrated"
        self.discarded += e.data.get("rows", 0) + e.data.get("values", 0) if e.kind == "discarded" else 0

    def rate(self, now: float | None = None) -> float:
        """Rows a second over the last seconds, or over the time there has been."""
        now = time.time() if now is None else now
        while self._recent and self._recent[0][0] < now - RATE_SECONDS:
            self._recent.popleft()
        if not self._recent:
            return 0.0
        return sum(n for _, n in self._recent) / max(min(RATE_SECONDS, now - self._recent[0][0]), 1e-3)


# --------------------------------------------------- the same over tables of events


def totals(log: DataFrame, by: str, rows: str) -> DataFrame:
    """Rows and units by table."""
    return log.groupBy(by).agg(F.count("*").alias("units"), F.sum(rows).alias("rows"))


def sliding_rows(log: DataFrame, at: str, rows: str, by: list[str], seconds: int = 5) -> DataFrame:
    """Of each event the rows of the last seconds, its own included."""
    window = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("recent", F.sum(rows).over(window))
