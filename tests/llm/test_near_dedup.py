import random
import re

import numpy as np
import pytest
from millrace.llm import near_dedup as N
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute(rows, k, share=(80, 100)):
    """doc_id -> (set size, least id reachable), by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and share[1] * len(s & t) >= share[0] * len(s | t):
                label[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        least[r] = min(least.get(r, i), i)
    return {i: (len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, planted, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(planted, words=k).collect()}
    want = brute([(r.doc_id, r.text) for r in planted.collect()], k)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_query_equals_brute_force_on_the_small_table(spark, sf):
    import __spark_entry__

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in __spark_entry__.queries()["op8_near_dedup"](spark, sf).collect()}
    assert got == brute(rows, 2)


def test_members_outside_the_pivots_component_are_still_linked(spark):
    # A chain in which neighbours are alike and the ends aren't: stars alone can miss links of it.
    base = [f"c{i}" for i in range(200)]
    rows = []
    for n in range(40):
        words = list(base)
        for j in range(n * 4):
            words[j] = f"x{j}"
        rows.append((100 - n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_a_large_group_of_near_copies_equals_brute_force(spark):
    # Edits of one text at all distances: one large component, and many members that are just outside it.
    r = random.Random(5)
    base = [f"g{i}" for i in range(150)]
    rows = []
    for n in range(700):
        words = list(base)
        for _ in range(r.randint(0, 30)):
            words[r.randrange(150)] = f"y{r.randrange(300)}"
        rows.append((n * 11 % 700, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, words=2).collect()}
    want = brute(rows, 2)
    assert got == want
    assert 100 < len({c for _, c in want.values()}) < 600


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for n in (5, 150, 4000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(a), np.unique(np.concatenate([a[n // 10 :], r.integers(0, 1 << 63, n // 8, dtype=np.uint64)])), np.zeros(0, np.uint64)]
        bits = N.parities(sets).view(np.uint64)
        apart = lambda x, y: sum(int(v).bit_count() for v in bits[x] ^ bits[y])
        for x, y in ((0, 1), (0, 2), (1, 2)):
            assert 0 <= len(np.setxor1d(sets[x], sets[y])) - apart(x, y)
        if n == 150:
            assert apart(0, 1) >= 0.9 * len(np.setxor1d(sets[0], sets[1]))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = N.near_duplicates(odd_documents, words=2).collect()
    assert len(rows) == odd_documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1]
    assert by[2][0].n_shingles == 0 and by[2][0].component_id == 2 and by[2][0].kept
    assert by[6][0].n_shingles == 1
    assert by[None][0].component_id is None and by[None][0].kept
    assert N.near_duplicates(no_documents).count() == 0
    assert N.drop_near_duplicates(no_documents).columns == no_documents.columns
    clash = odd_documents.withColumn("component_id", F.lit(5)).withColumn("kept", F.lit("x"))
    assert N.near_duplicates(clash).count() == odd_documents.count()
    clash = odd_documents.select("*", *[F.lit(1).alias(c) for c in ("__r1", "__row", "__stays", "k1", "node")])
    assert N.drop_near_duplicates(clash).columns == clash.columns


def test_sketches_estimate_high_similarities():
    r = np.random.default_rng(0)
    for share in (0.95, 0.9, 0.8):
        total = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
        both = int(1000 * share)
        half = (1000 - both) // 2
        a, b = np.unique(total[: both + half]), np.unique(np.concatenate([total[:both], total[both + half :]]))
        odd = N.odd_sketches(np.array([N.signature(a), N.signature(b)]))
        bits = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64))
        estimate = 1 + N.SKETCH / (4 * N.SAMPLES) * np.log(1 - 2 * bits / N.SKETCH)
        assert abs(estimate - share) < 0.12


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_one_row_of_each_component_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*base[:-1], f"x{n}"])
    other = " ".join(f"o{i}" for i in range(40))
    alone = " ".join(f"a{i}" for i in range(40))
    blank = " ".join(f"b{i}" for i in range(40))
    rows = [
        (1, near(0)), (None, near(1)),  # a null id loses
        (None, alone),  # and takes no other null id with it
        (2, near(2)), (2, other),  # of one id, only the text that loses goes
        (3, blank), (3, blank), (3, blank),  # repeated rows
        (None, f"{blank} more"), (None, " ".join(f"n{i}" for i in range(40))), (None, " ".join(f"n{i}" for i in range(40))),
        (4, ""), (4, ""), (None, None),
    ]
    got = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = [(1, near(0)), (None, alone), (2, other), (3, blank), (None, rows[-4][1]), (4, ""), (4, ""), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_settings_leave_own_ones(spark):
    from millrace.llm.work import SETTINGS, settled

    (key,) = SETTINGS
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert settled(spark).conf.get(key) == "false"
        spark.conf.set(key, "true")
        assert settled(spark).conf.get(key) == "true"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
