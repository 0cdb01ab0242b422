"""When to commit, which batches a commit covers, and when to try again."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CommitPolicy:
    """Commit when any bound is reached; without bounds there is none, which is refused."""

    every_checkpoints: int | None = 1
    every_bytes: int | None = None
    every_seconds: float | None = None

    def __post_init__(self) -> None:
        bounds = [b for b in (self.every_checkpoints, self.every_bytes, self.every_seconds) if b is not None]
        if not bounds or min(bounds) <= 0:
            raise ValueError("a commit policy needs a bound above zero")

    def due(self, checkpoints: int, size: int, seconds: float) -> bool:
        return (
            (self.every_checkpoints is not None and checkpoints >= self.every_checkpoints)
            or (self.every_bytes is not None and size >= self.every_bytes)
            or (self.every_seconds is not None and seconds >= self.every_seconds)
        )


@dataclass(frozen=True)
class BatchPolicy:
    """How many rows and bytes go into one file; no bound writes through."""

    every_rows: int | None = None
    every_bytes: int | None = None

    def options(self) -> dict[str, str]:
        return {"maxRecordsPerFile": str(self.every_rows)} if self.every_rows else {}

    def coalesced(self, df: DataFrame) -> DataFrame:
        """``df`` in so few partitions that a file gets ``every_bytes``, by the planner's estimate; nothing is shuffled."""
        return df.coalesce(max(1, estimated_bytes(df) // self.every_bytes)) if self.every_bytes else df


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; reads nothing."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 60)


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts and waits: doubling from the first wait to the longest, with full jitter."""

    attempts: int = 5
    first: float = 0.1
    longest: float = 30.0

    def wait(self, attempt: int, after: float | None = None, rng: random.Random | None = None) -> float:
        """Seconds before the next attempt; a wait that was asked for is kept."""
        if after is not None:
            return after
        return (rng or random).uniform(0, min(self.longest, self.first * 2 ** (attempt - 1)))


def covered(segments: DataFrame, checkpoints: DataFrame, stream: str, seq: str) -> DataFrame:
    """Segments that a later checkpoint of their own stream covers.

    Only the last checkpoint of a stream matters, so the range join is one row a stream.
    """
    last = checkpoints.groupBy(stream).agg(F.max(seq).alias("__last"))
    return segments.join(last, stream).where(F.col(seq) <= F.col("__last")).drop("__last")


def commit_units(log: DataFrame, order: str, size: int, stream: list[str]) -> DataFrame:
    """Batches numbered in order within their stream and cut into commits of ``size``."""
    numbered = log.withColumn("__n", F.row_number().over(Window.partitionBy(*stream).orderBy(order)) - 1)
    return numbered.withColumn("commit_seq", F.floor(F.col("__n") / size).cast("long")).drop("__n")
