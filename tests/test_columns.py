"""Values treated column by column against the same treated one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import infer
from millrace.plans import catalog

catalog.load_all()

SCALARS = [None, True, False, 0, -1, 7, 2**53, 2**53 + 1, 2**63, 2**64, -(2**63) - 1, 0.0, -0.0, 1.0, 0.05, 1e-3, 9.99e-4, 9999999.5, 1e7, 1e16, 1e300, "", "a", 'q"\\\n\x01%s', "é€😀", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.1234567+01:00", "2024-01-01T00:00:00.000"]


def made(rng: random.Random, depth: int = 0):
    pick = rng.random()
    if depth < 4 and pick < 0.25:
        return {k: made(rng, depth + 1) for k in rng.sample(["a", "b", "%d", 'k"', "User Name", "z"], rng.randint(0, 4))}
    if depth < 4 and pick < 0.45:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(SCALARS)


def one_by_one(row, table, seen, path=()):
    """What an object shows, a value at a time."""
    for key, v in row.items():
        own = (*path, key)
        flags = seen.setdefault((table, own), set())
        flags.update(infer._flags(v))
        if isinstance(v, dict):
            one_by_one(v, table, seen, own)
        for item in v if isinstance(v, list) else ():
            if isinstance(item, dict):
                flags.add("i_object")
                one_by_one(item, (*table, "\x1f".join(own)), seen)
            else:
                flags.update({"i_nested"} if isinstance(item, list) else infer._flags(item, "i_"))


@pytest.mark.parametrize("seed", range(20))
def test_columns_equal_single_values(seed):
    rng = random.Random(seed)
    rows = [V.as_row(made(rng)) for _ in range(300)] + [{"a": n, "b": str(n), "z": n / 8} for n in range(50)]
    assert V.identity_texts(rows) == [V.identity_json(r) for r in rows]
    assert [d.hex() for d in V.content_digests(len(rows), V.columns_of(rows))] == [V.content_id(r) for r in rows]
    slow, observer = {}, infer._Observer()
    for r in rows:
        one_by_one(r, (), slow)
        observer.add((r,))
        observer.fold(100)
    observer.fold()
    assert list(observer.seen.items()) == list(slow.items())


def test_floats_as_before():
    rng = random.Random(1)
    for v in [rng.uniform(-1, 1) * 10.0 ** rng.randint(-4, 8) for _ in range(20_000)]:
        sign, digits, power = __import__("decimal").Decimal(repr(v)).as_tuple()
        text = V._jvm_float(v)
        assert float(text) == v and ("E" in text) == (not 1e-3 <= abs(v) < 1e7)


def test_one_pass_builds_all_tables(spark):
    docs = [{"id": n, "kids": [{"v": k / 4, "deep": [{"w": "x" * k}]} for k in range(n % 4)]} for n in range(700)]
    df = spark.createDataFrame([(json.dumps(d), n) for n, d in enumerate(docs)], "line string, ordinal long").repartition(3)
    seen = infer.resolve(infer.observe(df), "r")
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(line):
        runs.add(1)
        return line

    whole, columns = infer.together(df.select(once("line").alias("line")), seen, "l", ["id"])
    got = whole.select(*[F.transform(c, lambda x: x["_sys_id"]).alias(t) for t, c in columns.items()]).collect()
    assert runs.value == len(docs)
    apart = infer.build(df, seen, "l", ["id"])
    for t in columns:
        assert sorted(i for r in got for i in r[t]) == sorted(r["_sys_id"] for r in apart[t].collect())
    parent = V.keyed_id(docs[3], ["id"])
    kid = V.child_id(parent, 2, docs[3]["kids"][2])
    assert kid in {i for r in got for i in r["r__kids"]} and V.child_id(kid, 0, {"w": "xx"}) in {i for r in got for i in r["r__kids__deep"]}


def test_orders_without_items(spark, sf, tmp_path):
    for name, keep in (("orders", "o_orderkey % 100 = 0"), ("lineitem", "false")):
        spark.read.parquet(f"{sf}/{name}.parquet").where(keep).write.parquet(f"{tmp_path}/{name}.parquet")
    n = spark.read.parquet(f"{tmp_path}/orders.parquet").count()
    found = {q: sorted(map(tuple, catalog.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("raw_jsonl_tables", "identity_raw_typed")}
    assert found == {"raw_jsonl_tables": [("orders", n), ("orders__items", 0)], "identity_raw_typed": [("orders", n, n), ("orders__items", 0, 0)]}
