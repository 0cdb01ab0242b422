"""Store, sources and pipelines: conformance, crashes, resuming."""

import json
import random
import threading

import pytest
from millrace.functions import types as L
from millrace.operators.lower import Capabilities
from millrace.operators.policy import Action, ContractViolation, Policy
from millrace.plans.report import KINDS, Events, Metrics, ndjson
from millrace.plans.validate import ConfigError, validate
from millrace.sources.base import DestinationError, SourceError, StreamSpec
from millrace.sources.files import JsonLines, Scripted, TypedFiles
from millrace.sources.store import JsonParts, SnapshotStore, Unit
from millrace.streaming.engine import Pipeline, run_stream
from millrace.streaming.policy import BatchPolicy, CommitPolicy, RetryPolicy


class Crash(Exception):
    pass


def frame(spark, n, first=0):
    return spark.range(first, first + n).selectExpr("id", "concat('n', id) AS name")


def batches(spark, *sizes):
    out, at = [], 0
    for n, size in enumerate(sizes):
        out.append((frame(spark, size, at), n))
        at += size
    return out


def test_commits_are_atomic_and_repeatable(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    with store.session():
        one = store.commit(spark, "p", Unit("l", 0, {"t": frame(spark, 3)}, "t", cursors={"t": 5}))
        again = store.commit(spark, "p", Unit("l", 0, {"t": frame(spark, 99)}, "t", cursors={"t": 6}))
    assert one == again and store.read(spark, "t").count() == 3
    assert store.read_state("p")["cursors"] == {"t": 5} and store.read_state("other")["cursors"] == {}
    with store.session(), pytest.raises(DestinationError):
        with SnapshotStore(str(tmp_path / "s")).session():
            pass


def test_replace_is_once_a_load(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    with store.session():
        store.commit(spark, "p", Unit("l1", 0, {"t": frame(spark, 3)}, "t", "replace"))
        store.commit(spark, "p", Unit("l1", 1, {"t": frame(spark, 2, 3)}, "t", "replace"))
        assert store.read(spark, "t").count() == 5
        store.commit(spark, "p", Unit("l2", 0, {"t": frame(spark, 1)}, "t", "replace"))
    assert store.read(spark, "t").count() == 1


def test_schemas_widen_in_the_store(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    with store.session():
        store.commit(spark, "p", Unit("l", 0, {"t": spark.createDataFrame([(1,)], "a int")}, "t"))
        store.commit(spark, "p", Unit("l", 1, {"t": spark.createDataFrame([("x", 2.5)], "a string, b double")}, "t"))
    assert sorted(map(tuple, store.read(spark, "t").collect())) == [("1", None), ("x", 2.5)]


POINTS = ("before_write", "after_write", "before_publish", "after_publish")


@pytest.mark.parametrize("mode", ["append", "replace", "merge"])
@pytest.mark.parametrize("point", POINTS)
def test_crash_and_resume_gives_every_row_once(spark, tmp_path, mode, point):
    left = {"n": 1}

    def crash(name):
        if name == point and left["n"]:
            left["n"] -= 1
            raise Crash(name)

    def pipeline():
        spec = StreamSpec("t", ("id",), structured=True)
        return Pipeline("p", Scripted([(spec, batches(spark, 5, 5))]), SnapshotStore(str(tmp_path / "s"), crash=crash), mode)

    with pytest.raises(Crash):
        pipeline().run(spark)
    pipeline().run(spark)
    rows = SnapshotStore(str(tmp_path / "s")).read(spark, "t").collect()
    assert sorted(r.id for r in rows) == list(range(10))
    store = SnapshotStore(str(tmp_path / "s"))
    assert store.reclaim() == [] or store.read(spark, "t").count() == 10


def test_resume_reads_only_what_is_new(spark, tmp_path):
    spec = StreamSpec("t", structured=True)
    all_batches = batches(spark, 4, 4, 2)
    run = lambda n: Pipeline("p", Scripted([(spec, all_batches[:n])]), SnapshotStore(str(tmp_path / "s"))).run(spark)
    assert run(2).rows_read == {"t": 8}
    second = run(3)
    assert second.rows_read == {"t": 2} and second.resumed == "cursor"
    with pytest.raises(SourceError, match="unknown cursor"):
        list(Scripted([(spec, all_batches[:1])]).read(spark, spec, 77))


def test_json_lines_resume_by_offset(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    f = folder / "users.jsonl"
    f.write_text('{"id": 1, "tags": [{"x": 1}]}\n\n{"id": 2}\n{"id": 3')
    run = lambda: Pipeline("p", JsonLines(str(folder)), SnapshotStore(str(tmp_path / "s"))).run(spark)
    assert run().rows_written == {"users": 2, "users__tags": 1}
    with f.open("a") as out:
        out.write(', "late": true}\n')
    report = run()
    assert report.rows_written["users"] == 1
    rows = {r.id: r for r in SnapshotStore(str(tmp_path / "s")).read(spark, "users").collect()}
    assert set(rows) == {1, 2, 3} and rows[3].late is True and rows[1].late is None
    f.write_text("x" * f.stat().st_size)
    with pytest.raises(SourceError, match="rewritten"):
        run()
    f.write_text("")
    with pytest.raises(SourceError, match="shorter"):
        run()


def test_json_merge_by_key(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spec = {"u": StreamSpec("u", ("id",))}
    run = lambda: Pipeline("p", JsonLines(str(folder), spec), SnapshotStore(str(tmp_path / "s")), "merge").run(spark)
    (folder / "u.jsonl").write_text('{"id": 1, "mails": [{"a": "x"}, {"a": "y"}]}\n{"id": 2, "mails": [{"a": "z"}]}\n')
    run()
    with (folder / "u.jsonl").open("a") as f:
        f.write('{"id": 1, "mails": []}\n')
    run()
    store = SnapshotStore(str(tmp_path / "s"))
    assert store.read(spark, "u").count() == 2
    assert [r.a for r in store.read(spark, "u__mails").collect()] == ["z"]


def test_retries_and_fatal_errors(spark, tmp_path):
    class Shaky(Scripted):
        left = 2

        def read(self, spark, stream, since):
            if Shaky.left:
                Shaky.left -= 1
                raise SourceError("busy", retry=True, after=0.5)
            yield from super().read(spark, stream, since)

    waits, seen = [], []
    spec = StreamSpec("t", structured=True)
    p = Pipeline("p", Shaky([(spec, batches(spark, 2))]), SnapshotStore(str(tmp_path / "s")), sleep=waits.append, listeners=[lambda e: seen.append(e)])
    assert p.run(spark).attempts == 3 and waits == [0.5, 0.5]
    kinds = [e.kind for e in seen]
    assert kinds.count("retrying") == 2 and kinds[-1] == "run_finished" and [e.n for e in seen] == list(range(len(seen)))
    assert set(kinds) <= set(KINDS)

    class Broken(Scripted):
        def read(self, spark, stream, since):
            raise SourceError("gone")
            yield

    with pytest.raises(SourceError, match="gone"):
        Pipeline("q", Broken([(spec, [])]), SnapshotStore(str(tmp_path / "s2"))).run(spark)


def test_frozen_schema_writes_nothing_of_the_batch(spark, tmp_path):
    spec = StreamSpec("t", structured=True)
    script = [(frame(spark, 2), 0), (frame(spark, 2, 2).selectExpr("*", "1 AS extra"), 1)]
    store = SnapshotStore(str(tmp_path / "s"))
    with pytest.raises(ContractViolation):
        Pipeline("p", Scripted([(spec, script)]), store, schema_policy=Policy(Action.FREEZE)).run(spark)
    assert store.read(spark, "t").count() == 2


def test_json_parts(spark, tmp_path):
    sink = JsonParts(str(tmp_path / "j"))
    sink.check(spark)
    unit = Unit("l", 0, {"t": frame(spark, 3)}, "t", cursors={"t": 1})
    assert sink.commit(spark, "p", unit) == sink.commit(spark, "p", unit)
    assert sink.read(spark, "t").count() == 3 and sink.read_state("p")["cursors"] == {"t": 1}
    with open(tmp_path / "j" / "receipts.jsonl", "a") as f:
        f.write('{"pipeline": "p", "load_id": "l", "se')
    assert len(sink._receipts()) == 1
    with pytest.raises(DestinationError):
        sink.commit(spark, "p", Unit("l", 1, {"t": frame(spark, 1)}, "t", "merge"))


def test_typed_files_by_cursor(spark, tmp_path):
    frame(spark, 10).write.parquet(str(tmp_path / "in"))
    run = lambda: Pipeline("p", TypedFiles({"t": str(tmp_path / "in")}, cursors={"t": "id"}), SnapshotStore(str(tmp_path / "s"))).run(spark)
    assert run().rows_written == {"t": 10}
    frame(spark, 5, 10).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().rows_written == {"t": 5}
    assert run().rows_written == {"t": 0}


def test_typed_files_refuse_rows_without_a_cursor(spark, tmp_path):
    run = lambda n: Pipeline("p", TypedFiles({"t": str(tmp_path / n)}, cursors={"t": "id"}), SnapshotStore(str(tmp_path / f"s{n}"))).run(spark)
    none = frame(spark, 3).selectExpr("cast(null AS long) AS id", "name")
    none.write.parquet(str(tmp_path / "all"))
    frame(spark, 10).union(none).write.parquet(str(tmp_path / "some"))
    frame(spark, 10).write.parquet(str(tmp_path / "late"))
    assert run("late").rows_written == {"t": 10}
    none.write.mode("append").parquet(str(tmp_path / "late"))
    for name in ("all", "some", "late"):
        with pytest.raises(Exception, match="3 rows of t have no id"):
            run(name)


def test_validation():
    cap = Capabilities()
    ok = validate([StreamSpec("A b"), StreamSpec("c")], {}, cap)
    assert ok == {"A b": "a_b", "c": "c"}
    for streams, modes, capabilities in (
        ([StreamSpec("a b"), StreamSpec("a-b")], {}, cap),
        ([StreamSpec("a"), StreamSpec("a__b")], {}, cap),
        ([StreamSpec("a", ("x",))], {"a": ("merge", ("y",))}, cap),
        ([StreamSpec("a")], {"a": ("merge", ())}, cap),
        ([StreamSpec("a", ("x",))], {"a": ("merge", ("x",))}, Capabilities(merge=False)),
        ([StreamSpec("a", type_hints={"m": L.Logical("decimal", 3, 5)})], {}, cap),
        ([StreamSpec("a")], {}, Capabilities(max_name=4)),
        ([StreamSpec("a")], {}, Capabilities(requires_durable_identity=True)),
        ([StreamSpec("")], {}, cap),
    ):
        with pytest.raises(ConfigError):
            validate(streams, modes, capabilities)
    with pytest.warns(UserWarning):
        validate([StreamSpec("a"), StreamSpec("b", cursor_field="c")], {}, cap)


def test_policies_of_time():
    with pytest.raises(ValueError):
        CommitPolicy(every_checkpoints=None)
    assert CommitPolicy(every_checkpoints=3).due(3, 0, 0) and not CommitPolicy(every_checkpoints=3).due(2, 0, 99)
    assert CommitPolicy(None, every_seconds=2).due(1, 0, 2.5)
    assert BatchPolicy(every_rows=10).options() == {"maxRecordsPerFile": "10"}
    r = RetryPolicy()
    assert all(0 <= r.wait(n, rng=random.Random(n)) <= 30 for n in range(1, 20)) and r.wait(1, 7.0) == 7.0


def test_events_and_metrics(tmp_path):
    m = Metrics()
    with open(tmp_path / "e", "w") as f:
        events = Events([m, ndjson(f), lambda e: 1 / 0])
        events.emit("committed", rows={"t": 5})
        events.emit("retrying")
    assert (m.rows, m.commits, m.retries) == (5, 1, 1) and m.rate() > 0
    assert [json.loads(x)["kind"] for x in open(tmp_path / "e")] == ["committed", "retrying"]
    with pytest.raises(ValueError):
        events.emit("unheard_of")


def test_documents(spark, tmp_path):
    text = f"pipeline: p\nsource: {{type: jsonl, directory: {tmp_path}}}\ndestination: {{type: store, root: {tmp_path / 's'}}}\n"
    makers = {"jsonl": JsonLines}, {"store": SnapshotStore}
    p = Pipeline.from_document(text, *makers)
    p.check(spark)
    with pytest.raises(ConfigError, match="unknown entries"):
        Pipeline.from_document(text + "surprise: 1\n", *makers)
    with pytest.raises(ConfigError) as e:
        Pipeline.from_document(text.replace("directory:", "secret:"), *makers)
    assert str(tmp_path) not in str(e.value)


def test_structured_streaming_is_exactly_once(spark, tmp_path):
    folder, store = tmp_path / "in", SnapshotStore(str(tmp_path / "s"))
    frame(spark, 4).write.json(str(folder))
    go = lambda: run_stream(spark, str(folder), "id long, name string", store, "p", "t", str(tmp_path / "c"))
    go()
    frame(spark, 3, 4).write.mode("append").json(str(folder))
    go()
    go()
    assert sorted(r.id for r in store.read(spark, "t").collect()) == list(range(7))


def test_readers_see_whole_commits_only(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    with store.session():
        store.commit(spark, "p", Unit("l", 0, {"t": frame(spark, 3)}, "t"))
    seen, stop = [], threading.Event()

    def crash(name):
        seen.append((name, SnapshotStore(str(tmp_path / "s")).read(spark, "t").count()))

    store = SnapshotStore(str(tmp_path / "s"), crash=crash)
    with store.session():
        store.commit(spark, "p", Unit("l", 1, {"t": frame(spark, 2, 3)}, "t"))
    stop.set()
    assert dict(seen) == {"before_write": 3, "after_write": 3, "before_publish": 3, "after_publish": 5}
