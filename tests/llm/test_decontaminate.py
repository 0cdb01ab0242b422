import hashlib
import random
import re

from millrace.llm import decontaminate as D
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if f := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= f
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted((tuple(r) for r in D.contamination_digest(D.mark_contamination(docs, items, **kw)).collect()), key=str)


def made(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "ab" for i in range(12)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, line(r.choice([3, 9, 10, 11, 25]))) for i in range(20)] + [(50, None), (51, ""), (None, line(12)), (52, "...")]
    items += [(60, items[0][1]), (61, items[0][1].upper() + "!")]
    docs = []
    for i in range(80):
        parts = [line(r.randint(0, 15))]
        if r.random() < 0.5:
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 10))
            parts += [", ".join(w[a : a + r.choice([9, 10, 12, 40])]), line(r.randint(0, 10))]
        docs.append((i, " -- ".join(parts)))
    docs += [(100, None), (101, ""), (102, "a1"), (102, "a1")]
    return docs, items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = made(spark, seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert run(d, b) == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = made(spark, 3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(d, b, block_bytes=400) == brute(docs, items)


def test_query_equals_brute_force(spark, sf):
    import __spark_entry__

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in __spark_entry__.queries()["op10_decontaminate"](spark, sf).collect()), key=str)
    assert got == brute(docs, items)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    marked = D.mark_contamination(odd_documents.withColumn("n_words", F.lit("x")), items)
    assert sum(bool(r.hit_spans) for r in marked.collect()) == 2
    assert D.drop_contaminated(odd_documents, items).count() == odd_documents.count() - 2
    assert D.drop_contaminated(odd_documents, items).columns == odd_documents.columns
    assert D.mark_contamination(no_documents, items).count() == 0
    assert run(odd_documents.select("doc_id", "text"), items.limit(0)) == brute([(r.doc_id, r.text) for r in odd_documents.collect()], [])
