import random

import pytest
import xxhash
from millrace.llm import line_dedup as L
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"


def brute(rows, least):
    """Texts after line dedup, by dictionaries over all lines (rows: distinct ids, no nulls)."""
    docs = []
    for i, t in sorted(rows):
        lines = [(n, x.strip(SPACE)) for n, x in enumerate(t.split("\n")) if x.strip(SPACE)]
        docs.append((i, t, lines, [len(x.split()) for _, x in lines]))
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    order = lambda x: (signed(xxhash.xxh64(x.encode(), seed=42).intdigest()), x)
    where = {}
    for i, _, lines, words in docs:
        for a in range(len(lines)):
            b, total = a, 0
            while b < len(lines) and total < least:
                total += words[b]
                b += 1
            if total >= least:
                best = min(range(a, b), key=lambda p: (order(lines[p][1]), -p))
                where.setdefault(lines[best][1], set()).add((i, best))
    part = {i for places in where.values() if len(places) > 1 for i, _ in places}
    seen, pairs, out = set(), set(), {}
    for i, t, lines, words in docs:
        gone = set()
        if i in part:
            run = []

            def close(run=run, words=words, lines=lines, gone=gone):
                if sum(words[p] for p in run) >= least:
                    gone.update(lines[p][0] for p in run)
                run.clear()

            for p, (_, x) in enumerate(lines):
                again = x in seen
                follows = p > 0 and (lines[p - 1][1], x) in pairs
                if not (again and follows):
                    close()
                if again:
                    run.append(p)
                seen.add(x)
                if p > 0:
                    pairs.add((lines[p - 1][1], x))
            close()
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def made(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 5) for _ in range(n))
    pool = [line(r.choice([1, 3, 5, 9, 20, 60])) for _ in range(40)]
    passages = [[line(r.choice([4, 12, 30])) for _ in range(r.randint(2, 6))] for _ in range(5)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 7)):
            kind = r.random()
            lines += r.choice(passages) if kind < 0.3 else [r.choice(pool)] if kind < 0.6 else [line(r.randint(1, 30))] if kind < 0.9 else ["", "  "]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("least", [10, 50])
def test_equals_brute_force(spark, seed, least):
    rows = made(seed)
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()}
    assert got == brute(rows, least)


def test_query_equals_brute_force_on_the_small_table(spark, sf):
    import hashlib

    import __spark_entry__

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, L.MIN_WORDS)
    got = {r.doc_id: r.text_sha256 for r in __spark_entry__.queries()["op7_line_dedup"](spark, sf).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_a_long_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(5)] + [(9, "nothing shared here")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[5][1]
    assert all(got[i] == f"own line {i}\nlast line {i}" for i in range(1, 5))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = L.dedup_lines(odd_documents, min_words=3)
    assert rows.columns == [*odd_documents.columns, "removed_lines", "removed_words"]
    inner = odd_documents.select("*", *[F.lit(1).alias(c) for c in ("__gone", "__row", "__text", "__k1", "__cut", "__words")])
    assert L.dedup_lines(inner).count() == odd_documents.count()
    assert sorted(map(str, (r.text for r in rows.collect()))) == sorted(map(str, (r.text for r in odd_documents.collect())))
    assert L.dedup_lines(no_documents).count() == 0
    twice = L.dedup_lines(rows.withColumnRenamed("lang", "removed_words2"))
    assert twice.columns.count("removed_lines") == 1


def true_repeats(rows, least):
    """Texts without the runs that stand at one earlier place (rows: distinct ids, no nulls)."""
    docs = {i: [(n, x.strip(SPACE)) for n, x in enumerate(t.split("\n")) if x.strip(SPACE)] for i, t in sorted(rows)}
    places = [(i, p) for i, lines in docs.items() for p in range(len(lines))]
    out = {}
    for i, t in rows:
        gone = set()
        for p in range(len(docs[i])):
            for j, q in places:
                if (j, q) >= (i, p):
                    break
                n = 0
                while p + n < len(docs[i]) and q + n < len(docs[j]) and docs[i][p + n][1] == docs[j][q + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in docs[i][p : p + n]) >= least:
                    gone.update(m for m, _ in docs[i][p : p + n])
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_a_run_from_several_sources_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    long = " ".join(f"l{i}" for i in range(55))
    rows = [(1, f"{a}\n{b}\n{long}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}\nown\n{long}")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: f"{a}\n{b}\n{c}\nown"}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_true_repeats(spark, seed):
    # Few lines in many orders: runs that are stitched from several places are common.
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdef") for _ in range(r.choice([1, 2, 4, 7]))) for _ in range(9)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(50)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=12).collect()}
    assert got == true_repeats(rows, 12)
    assert got != brute(rows, 12)
