"""Runs of whole pipelines: policies over nested batches, bounds of commits, replay, side-by-side streams, the command line."""

import io
import json
import threading

import pytest
from millrace import __main__ as cli
from millrace.functions import columns as C
from millrace.functions import naming as N
from millrace.functions import values as V
from millrace.operators import infer, passthrough, policy, shred
from millrace.plans.validate import ConfigError
from millrace.sources.base import Batch, Source, StreamSpec
from millrace.sources.files import JsonLines, Scripted
from millrace.sources.store import SnapshotStore, Unit
from millrace.streaming.engine import Cancelled, Pipeline
from millrace.streaming.policy import BatchPolicy, CommitPolicy
from pyspark.sql import functions as F

A, P = policy.Action, policy.Policy


def lines(spark, *docs):
    return spark.createDataFrame([(json.dumps(d), n) for n, d in enumerate(docs)], "line string, ordinal long")


def run(spark, path, batches, **options):
    store = SnapshotStore(str(path))
    source = Scripted([(StreamSpec("docs", ("id",)), [(b, str(n)) for n, b in enumerate(batches)])])
    return store, Pipeline("nested", source, store, **options).run(spark)


KIDS = {"id": 1, "kids": [{"k": 1, "toys": [{"t": 1}, {"t": 2}]}, {"k": 2, "toys": [{"t": 3}]}]}


@pytest.mark.parametrize("action", list(A))
def test_first_batch_of_a_nested_stream_is_whole(spark, tmp_path, action):
    store, report = run(spark, tmp_path, [lines(spark, KIDS, {"id": 2, "kids": [{"k": 3}]})], schema_policy=P(action))
    assert {t: store.read(spark, t).count() for t in store.tables()} == {"docs": 2, "docs__kids": 3, "docs__kids__toys": 3}
    assert not report.discarded_rows


def test_a_dropped_child_takes_its_own_children(spark, tmp_path):
    second = {"id": 2, "kids": [{"k": "x", "toys": [{"t": 4}, {"t": 5}]}, {"k": 9, "toys": [{"t": 6}]}]}
    store, report = run(spark, tmp_path, [lines(spark, KIDS), lines(spark, second)], schema_policy=P(A.DISCARD_ROW))
    assert sorted(r.k for r in store.read(spark, "docs__kids").collect()) == [1, 2, 9]
    assert sorted(r.t for r in store.read(spark, "docs__kids__toys").collect()) == [1, 2, 3, 6]
    assert report.discarded_rows == {"docs__kids": 1, "docs__kids__toys": 2}
    for child, parent in (("docs__kids", "docs"), ("docs__kids__toys", "docs__kids")):
        assert shred.orphans(store.read(spark, child), store.read(spark, parent)).count() == 0


def test_texts_of_digits_are_no_numbers(spark, tmp_path):
    second = [{"id": 2, "v": "12"}, {"id": 3, "v": " 7 "}, {"id": 4, "v": 5}, {"id": 5, "v": None}]
    store, report = run(spark, tmp_path, [lines(spark, {"id": 1, "v": 1}), lines(spark, *second)], schema_policy=P(A.DISCARD_ROW))
    assert sorted(str(r.v) for r in store.read(spark, "docs").collect()) == ["1", "5", "None"]
    assert report.discarded_rows == {"docs": 2}


def test_a_child_table_in_mid_run_is_a_change(spark, tmp_path):
    batches = [lines(spark, {"id": 1}), lines(spark, {"id": 2, "kids": [{"k": 1, "toys": [{"t": 1}]}]})]
    store, report = run(spark, tmp_path / "a", batches, schema_policy=P(A.DISCARD_ROW))
    assert store.tables() == ["docs"] and store.read(spark, "docs").count() == 2
    assert report.discarded_rows == {"docs__kids": 1, "docs__kids__toys": 1}
    with pytest.raises(policy.ContractViolation):
        run(spark, tmp_path / "b", batches, schema_policy=P(A.FREEZE))
    store, _ = run(spark, tmp_path / "c", batches)
    assert store.tables() == ["docs", "docs__kids", "docs__kids__toys"]


def test_commits_by_bytes(spark, tmp_path):
    batches = [lines(spark, {"id": n}) for n in range(6)]
    _, report = run(spark, tmp_path / "a", batches, commit_policy=CommitPolicy(every_checkpoints=None, every_bytes=1))
    assert report.commits == 6
    _, report = run(spark, tmp_path / "b", batches, commit_policy=CommitPolicy(every_checkpoints=None, every_bytes=1 << 40))
    assert report.commits == 1


def test_files_are_coalesced(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8)
    for bound, files in ((BatchPolicy(), 8), (BatchPolicy(every_bytes=1 << 30), 1), (BatchPolicy(every_rows=50), 24)):
        store = SnapshotStore(str(tmp_path / str(files)))
        with store.session():
            store.commit(spark, "p", Unit("l", 0, {"t": df}, "t", batch=bound))
        assert len(list((tmp_path / str(files)).glob("data/t/*/*.parquet"))) == files
        assert store.read(spark, "t").count() == 1000


def test_parts_of_one_schema_are_one_scan_and_receipts_are_bounded(spark, tmp_path):
    store = SnapshotStore(str(tmp_path))
    with store.session():
        for n in range(70):
            wide = spark.range(1) if n % 2 else spark.range(1).withColumn("v", F.lit(n))
            store.commit(spark, "p", Unit("l", n, {"t": wide}, "t"))
        assert store.commit(spark, "p", Unit("l", 0, {"t": spark.range(1)}, "t"))["rows"] == {}
    df = store.read(spark, "t")
    assert df.count() == 70 and len(store.manifest()["receipts"]) == 64
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2


def test_verdicts_over_the_log(spark, tmp_path):
    class Crash(Exception):
        pass

    def die(point):
        if point == "before_publish":
            raise Crash

    def staged(root):
        with SnapshotStore(str(root)).session("p") as s:
            s.commit(spark, "p", Unit("l", 0, {"t": spark.range(2)}, "t", cursors={"t": 0}))
        with pytest.raises(Crash), SnapshotStore(str(root), crash=die).session("p") as s:
            s.commit(spark, "p", Unit("l", 1, {"t": spark.range(3)}, "t", cursors={"t": 1}))
        return SnapshotStore(str(root))

    store = staged(tmp_path / "a")
    with store.session("p") as s:
        assert [v for _, v in s.recovered] == ["recover"]
        assert s.read(spark, "t").count() == 5 and s.read_state("p")["cursors"] == {"t": 1}
        s.commit(spark, "p", Unit("l", 1, {"t": spark.range(3)}, "t"))
        assert s.read(spark, "t").count() == 5
    store = staged(tmp_path / "b")
    with store.session("other") as s:
        assert [v for _, v in s.recovered] == ["foreign"]
    with store.session("p") as s:
        assert [v for _, v in s.recovered] == ["recover"]
    store = staged(tmp_path / "c")
    for f in (tmp_path / "c" / "log").iterdir():
        f.write_text(f.read_text()[:-3])
    with store.session("p") as s:
        assert [v for _, v in s.recovered] == ["damaged"] and s.read(spark, "t").count() == 2


class Endless(Source):
    def __init__(self, spark, names):
        self.spark, self.names, self.seen = spark, names, threading.Event()

    def check(self, spark):
        pass

    def streams(self, spark):
        return [StreamSpec(n, structured=True) for n in self.names]

    def read(self, spark, stream, since):
        n = since or 0
        while True:
            n += 1
            yield Batch(spark.range(n, n + 1), n)
            self.seen.set()


def test_cancelled_runs_keep_what_is_committed(spark, tmp_path):
    source = Endless(spark, ["a", "b"])
    p = Pipeline("endless", source, SnapshotStore(str(tmp_path)), readers=2)
    threading.Thread(target=lambda: (source.seen.wait(60), p.cancel())).start()
    with pytest.raises(Cancelled):
        p.run(spark)
    state = SnapshotStore(str(tmp_path)).read_state("endless")
    for stream, n in state["cursors"].items():
        assert SnapshotStore(str(tmp_path)).read(spark, stream).count() == n
    with pytest.raises(ConfigError):
        Pipeline("endless", source, SnapshotStore(str(tmp_path)), readers=0).run(spark)


def test_lines_in_spans_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "t.jsonl"
    path.write_text("".join(json.dumps({"id": n, "pad": "é" * (n % 40)}) + "\n" for n in range(500)) + "\n  \n" + '{"id": 50')
    store = SnapshotStore(str(tmp_path / "out"))
    for more in ("", '0}\n{"id": 501}\n'):
        with path.open("a") as f:
            f.write(more)
        Pipeline("spans", JsonLines(str(tmp_path / "in"), batch_bytes=4000), store).run(spark)
    assert sorted(r.id for r in store.read(spark, "t").collect()) == list(range(502))


def test_casts_inside_structs_are_checked(spark):
    df = spark.sql("SELECT named_struct('v', 9007199254740993L) AS s, array(named_struct('w', 1L)) AS a")
    ok = spark.sql("SELECT named_struct('v', 3L) AS s, array(named_struct('w', 1L)) AS a")
    want = spark.sql("SELECT named_struct('v', 1.5D, 'x', 'y') AS s, array(named_struct('w', 1.5D)) AS a").schema
    with pytest.raises(passthrough.InexactCast):
        passthrough.conform(df, want)
    assert passthrough.conform(ok, want).first().s.v == 3.0
    deep = spark.sql("SELECT named_struct('v', 3L) AS s, array(named_struct('w', 9007199254740993L)) AS a")
    with pytest.raises(passthrough.InexactCast):
        passthrough.conform(deep, want)


FLOATS = [0.0, 1.0, -1.0, 0.1, 1.5, 123456.75, 1e7, 12345678.9, 1e16, 1.25e20, 1e-3, 1e-4, 1.5e-7, -2.5e-10, 1e300, 9007199254740992.0]


def test_floats_have_one_identity(spark):
    docs = [{"id": x, "kids": [{"x": x, "s": "a\u0001\"\\é\n"}, {"x": -x, "s": None}]} for x in FLOATS]
    typed = spark.createDataFrame([(d["id"], [(k["x"], k["s"]) for k in d["kids"]]) for d in docs], "id double, kids array<struct<x:double,s:string>>")
    raw = lines(spark, *docs)
    tables = infer.build(raw, infer.resolve(infer.observe(raw), "t"), "l", ["id"])
    for name, df in shred.shred(typed, "t", "l", ["id"]).items():
        assert sorted(r[N.ROW_ID] for r in df.collect()) == sorted(r[N.ROW_ID] for r in tables[name].collect())
    got = spark.createDataFrame([(x,) for x in FLOATS], "x double").select(C.plain_float(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [V.render_scalar(x) for x in FLOATS]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "users.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    doc = tmp_path / "p.yaml"
    doc.write_text(f"pipeline: users\nsource: {{type: jsonl, directory: {tmp_path}/in}}\ndestination: {{type: store, root: {tmp_path}/out}}\nbatch_policy: {{every_rows: 100}}\nresources: {{readers: 2}}\n")
    act = lambda *words: (cli.act(cli.parser().parse_args([*words, str(doc)]), out := io.StringIO(), spark), out.getvalue())
    assert act("check")[0] == cli.DONE
    code, said = act("watch")
    assert code == cli.DONE and '"committed"' in said
    code, said = act("schema")
    assert code == cli.DONE and json.loads(said)["table"] == "users"
    assert act("reclaim") == (cli.DONE, '{"recovered": []}\n')
    doc.write_text("pipeline: users\n")
    assert act("run")[0] == cli.USAGE
