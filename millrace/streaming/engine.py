"""Pipelines: read, shape, govern, commit, resume.

A run reads each stream from its committed cursor, turns batches into tables, applies the schema policy,
and commits when the commit policy says so and every stream that has rows has reached a checkpoint. A run
that fails for a passing reason starts again from what is committed. A commit holds data and cursor
together, so nothing is lost or doubled wherever a run breaks off.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import naming as N
from millrace.operators import infer, merge, passthrough, policy
from millrace.operators.lower import lower
from millrace.plans.report import Event, Events, Report
from millrace.plans.validate import ConfigError, validate
from millrace.sources.base import Batch, Source, SourceError, StreamSpec
from millrace.sources.store import SnapshotStore, Unit
from millrace.streaming.policy import BatchPolicy, CommitPolicy, RetryPolicy, estimated_bytes


#: The planner's size of what it knows nothing about is beyond this.
UNKNOWN_BYTES = 1 << 50


@dataclass
class Pipeline:
    """A named movement of all streams of a source to a destination."""

    name: str
    source: Source
    destination: SnapshotStore
    mode: str = "append"
    merge_key: dict[str, tuple[str, ...]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    schema_policy: policy.Policy = field(default_factory=policy.Policy)
    commit_policy: CommitPolicy = field(default_factory=CommitPolicy)
    batch_policy: BatchPolicy = field(default_factory=BatchPolicy)
    retry_policy: RetryPolicy = field(default_factory=RetryPolicy)
    #: Streams that are read at the same time; commits come one after another.
    readers: int = 4
    cancelled: threading.Event = field(default_factory=threading.Event)
    workdir: str | None = None
    listeners: list[Callable[[Event], None]] = field(default_factory=list)
    sleep: Callable[[float], None] = time.sleep

    @classmethod
    def from_document(cls, text: str, sources: dict[str, Callable[..., Source]], destinations: dict[str, Callable[..., SnapshotStore]]) -> Pipeline:
        """A pipeline from a YAML or JSON document; unknown entries are refused, values of options never echoed."""
        import yaml

        known = {"pipeline", "workdir", "write_mode", "commit_policy", "batch_policy", "schema_policy", "resources", "source", "destination"}
        doc = yaml.safe_load(text)
        if not isinstance(doc, dict) or not {"pipeline", "source", "destination"} <= set(doc):
            raise ConfigError("a document needs pipeline, source and destination")
        if extra := sorted(set(doc) - known):
            raise ConfigError(f"unknown entries: {', '.join(map(str, extra))}")

        def make(entry: dict, makers: dict[str, Callable[..., Any]]) -> Any:
            kind = entry.get("type")
            if kind not in makers:
                raise ConfigError(f"unknown type {kind!r}; there are {', '.join(sorted(makers))}")
            try:
                return makers[kind](**{k: v for k, v in entry.items() if k != "type"})
            except TypeError as e:
                raise ConfigError(f"options of {kind} are wrong") from e

        write = doc.get("write_mode", "append")
        mode, keys = (write, {}) if isinstance(write, str) else (next(iter(write)), write[next(iter(write))].get("keys", {}))
        default = policy.Action(doc.get("schema_policy", "evolve"))
        return cls(doc["pipeline"], make(doc["source"], sources), make(doc["destination"], destinations), mode, {k: tuple(v) for k, v in keys.items()}, schema_policy=policy.Policy(default), commit_policy=CommitPolicy(**doc.get("commit_policy", {})), batch_policy=BatchPolicy(**doc.get("batch_policy", {})), readers=int(doc.get("resources", {}).get("readers", 4)), workdir=doc.get("workdir"))

    def cancel(self) -> None:
        """End a run before its next batch or commit; what is committed stays, the rest comes again with the next run."""
        self.cancelled.set()

    def check(self, spark: SparkSession) -> None:
        """Whether both ends can be reached; moves no data."""
        self.source.check(spark)
        self.destination.check(spark)

    def run(self, spark: SparkSession) -> Report:
        """Run to the end of all streams, trying again after passing failures."""
        events = Events(self.listeners)
        for attempt in range(1, self.retry_policy.attempts + 1):
            try:
                report = _Run(self, spark, events).go()
                report.attempts = attempt
                return report
            except SourceError as e:
                if not e.retry or attempt == self.retry_policy.attempts:
                    raise
                wait = self.retry_policy.wait(attempt, e.after)
                events.emit("retrying", attempt=attempt, wait=wait)
                self.sleep(wait)
        raise AssertionError("unreachable")


class Cancelled(Exception):
    """The run was asked to end."""


class _Run:
    """One attempt."""

    def __init__(self, pipeline: Pipeline, spark: SparkSession, events: Events):
        self.p, self.spark, self.events = pipeline, spark, events
        self.load_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.report = Report(pipeline.name, self.load_id)
        #: Schemas that this run has seen: the baseline of drift is the run.
        self.known: dict[str, T.StructType] = {}
        #: Lines that are read for several tables, until their commit.
        self.parsed: list[DataFrame] = []
        self.seq = 0
        #: Held by the stream that commits; what the run has seen changes in commits only.
        self.committing = threading.Lock()

    def mode(self, stream: StreamSpec) -> str:
        return self.p.modes.get(stream.name, self.p.mode)

    def go(self) -> Report:
        began = time.time()
        self.events.emit("run_started", load_id=self.load_id)
        streams = self.p.source.streams(self.spark)
        modes = {s.name: (self.mode(s), self.p.merge_key.get(s.name, s.primary_key)) for s in streams}
        tables = validate(streams, modes, self.p.destination.capabilities, self.p.workdir, self.p.readers)
        with self.p.destination.session(self.p.name) as opened:
            replayed = [name for name, verdict in getattr(opened, "recovered", []) if verdict == "recover"]
            state = self.p.destination.read_state(self.p.name)
            if state["last"]:
                self.report.resumed = "replay" if replayed else "cursor"
                self.events.emit("resumed", last=state["last"])
            self.all_streams([(s, tables[s.name], modes[s.name][1], None if self.mode(s) == "replace" else state["cursors"].get(s.name)) for s in streams])
        self.report.seconds = time.time() - began
        self.events.emit("run_finished", rows=self.report.total_rows)
        return self.report

    def all_streams(self, each: list[tuple]) -> None:
        """Streams side by side; the first failure ends the others at their next batch."""
        if len(each) < 2 or self.p.readers < 2:
            for args in each:
                self.stream(*args)
            return
        failed: list[BaseException] = []

        def one(args: tuple) -> None:
            try:
                self.stream(*args, stop=failed)
            except BaseException as e:
                failed.append(e)

        with ThreadPoolExecutor(self.p.readers, "stream") as pool:
            list(pool.map(one, each))
        if failed:
            raise failed[0]

    def stream(self, s: StreamSpec, table: str, key: tuple[str, ...], since: Any, stop: list[BaseException] | None = None) -> None:
        """One stream to its end. Streams commit on their own, so each commit covers whole batches of one."""
        self.events.emit("stream_started", stream=s.name)
        held: list[Batch] = []
        checkpoints, size, since_commit = 0, 0, time.time()
        for batch in self.p.source.read(self.spark, s, since):
            if stop:
                return
            self.go_on()
            held.append(batch)
            if self.p.commit_policy.every_bytes is not None:
                size += batch.size if batch.size is not None else self.bytes_of(batch.rows)
            checkpoints += batch.cursor is not None
            if batch.cursor is not None:
                self.events.emit("checkpoint", stream=s.name)
                if self.p.commit_policy.due(checkpoints, size, time.time() - since_commit):
                    self.commit(s, table, key, held)
                    held, checkpoints, size, since_commit = [], 0, 0, time.time()
        if held and not stop:
            self.commit(s, table, key, held)
        self.events.emit("stream_finished", stream=s.name)

    @staticmethod
    def bytes_of(rows: DataFrame) -> int:
        """Bytes of a batch: the planner's estimate, or where it has none those of the rows as text."""
        if (n := estimated_bytes(rows)) < UNKNOWN_BYTES:
            return n
        return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0

    def go_on(self) -> None:
        if self.p.cancelled.is_set():
            self.events.emit("cancelled")
            raise Cancelled(self.p.name)

    def commit(self, s: StreamSpec, table: str, key: tuple[str, ...], held: list[Batch]) -> None:
        with self.committing:
            self.go_on()
            self.publish(s, table, key, held)

    def publish(self, s: StreamSpec, table: str, key: tuple[str, ...], held: list[Batch]) -> None:
        rows = held[0].rows
        for b in held[1:]:
            rows = rows.unionByName(b.rows, allowMissingColumns=True)
        tables = self.structured(s, table, held) if s.structured else self.raw(s, table, key, rows)
        tables = {t: lower(df, self.p.destination.capabilities) for t, df in tables.items()}
        cursor = held[-1].cursor
        mode = self.mode(s)
        if mode == "merge" and s.structured:
            merge.require_keys(tables[table], key)
        unit = Unit(self.load_id, self.seq, tables, table, mode, tuple(key), {s.name: cursor} if cursor is not None else {}, batch=self.p.batch_policy)
        self.events.emit("batch_staged", stream=s.name, batches=len(held), tables=len(tables))
        receipt = self.p.destination.commit(self.spark, self.p.name, unit)
        # Where all rows are written, they were counted as such: typed input isn't read again to count it.
        if s.structured and mode != "merge" and self.p.schema_policy == policy.Policy():
            read = receipt["rows"][table]
        else:
            read = rows.count()
        self.report.rows_read[s.name] = self.report.rows_read.get(s.name, 0) + read
        for lines in self.parsed:
            lines.unpersist()
        self.parsed = []
        self.seq += 1
        self.report.commits += 1
        for t, n in receipt["rows"].items():
            self.report.rows_written[t] = self.report.rows_written.get(t, 0) + n
        self.events.emit("committed", seq=unit.seq, rows=receipt["rows"])

    def govern(self, table: str, df: DataFrame, new_is_change: bool, unfit: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``new_is_change``: a table that isn't known appears in mid-run, so the policy has a say in it."""
        ancestors = tuple(a for a in sorted(self.known, key=len, reverse=True) if table.startswith(f"{a}__"))
        g = policy.govern(df, table, self.known.get(table), self.p.schema_policy, ancestors, new_is_change, unfit, rendered=False)
        if table in self.known or g.deltas:
            self.known[table] = g.schema
        for d in g.deltas:
            self.events.emit("table_created" if d.kind == "create_table" else "table_migrated", table=table, column=d.column)
            self.report.migrations += d.kind != "create_table"
        if self.p.schema_policy != policy.Policy():
            n = g.discarded.first()
            self.discarded(table, n["rows"], n["values"])
        return g.rows, g.dropped

    def discarded(self, table: str, rows: int, values: int) -> None:
        if rows:
            self.report.discarded_rows[table] = self.report.discarded_rows.get(table, 0) + rows
        if values:
            self.report.discarded_values[table] = self.report.discarded_values.get(table, 0) + values
        if rows or values:
            self.events.emit("discarded", table=table, rows=rows, values=values)

    def structured(self, s: StreamSpec, table: str, held: list[Batch]) -> dict[str, DataFrame]:
        done = []
        for n, b in enumerate(held):
            rows, _ = self.govern(table, passthrough.project(b.rows, self.load_id), False)
            if self.mode(s) == "merge" and merge.ARRIVAL not in rows.columns:
                rows = rows.withColumn(merge.ARRIVAL, F.lit(n).cast("long"))
            done.append(rows)
        return {table: passthrough.union_batches(done)}

    def raw(self, s: StreamSpec, table: str, key: tuple[str, ...], lines: DataFrame) -> dict[str, DataFrame]:
        lines = lines.persist()
        self.parsed.append(lines)
        seen = infer.resolve(infer.observe(lines), table, s.type_hints, self.p.destination.capabilities.scalar_lists)
        # The policy looks at what was known before any table of this batch.
        first_batch = table not in self.known
        built = infer.build(lines, seen, self.load_id, list(key) or None, known=self.known, held=self.parsed)
        above = {child.name: t.name for t in seen.walk() for child in t.children.values()}
        out: dict[str, DataFrame] = {}
        gone: dict[str, DataFrame] = {}
        ids = lambda df: df.select(F.col(N.ROW_ID).alias("__gone"))
        for name, df in built.items():  # parents come first
            went = []
            if above.get(name) in gone:
                df, lost = policy.under(df, gone[above[name]])
                self.discarded(name, lost.count(), 0)
                went.append(ids(lost))
            # What fits no type of its column became null as it was read.
            n = df.agg(F.sum("_misfits")).first()[0] or 0
            if n:
                self.report.discarded_values[name] = self.report.discarded_values.get(name, 0) + n
            rows, dropped = self.govern(name, df.drop("_misfits"), not first_batch and name != table, "_unfit")
            if dropped is not None:
                went.append(ids(dropped))
            if went:
                gone[name] = reduce(DataFrame.union, went)
            if name in self.known:
                out[name] = rows.drop("_unfit")
        return out


def run_stream(spark: SparkSession, files: str, schema: str, store: SnapshotStore, pipeline: str, table: str, checkpoint: str, format: str = "json") -> None:
    """Structured Streaming into the store: all that is there, once, exactly once.

    Spark's checkpoint holds the offsets; a batch that is repeated after a failure has the same number, and
    the store answers it with its receipt.
    """
    stream = spark.readStream.schema(schema).format(format).load(files)

    def publish(df: DataFrame, batch: int) -> None:
        store.commit(spark, pipeline, Unit("stream", batch, {table: df.withColumn(N.LOAD_ID, F.lit(f"stream-{batch}"))}, table))

    with store.session():
        stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
