import re
from collections import Counter

from millrace.llm import quality as Q
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def got(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    import __spark_entry__

    df = __spark_entry__.queries()["op5_quality_rules"](spark, sf)
    assert got(df) == {r.doc_id: counts(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(not (r.base_failed and r.kept) for r in df.collect())


def test_repeats(spark):
    base = [f"w{i}" for i in range(8)]
    texts = [" ".join(base * 2), " ".join([*base, "x", *base[:7]]), " ".join(["a"] * 20), "a\n" * 30, " ".join([*base, *base[4:], *base]), "x\ny\nx\n \n\nx", "\x0b".join(base * 3) + "\x1c"]
    df = Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got(df) == {i: counts(t) for i, t in enumerate(texts)}


def test_no_user_functions_and_no_shuffle(spark, sf):
    plan = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_labels_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = Counter((r.quality, r.kept) for r in Q.judge(docs).collect())
    clean = [r for r in Q.judge(docs).where("quality = 1 and not base_failed").collect()]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert n[0, True] <= 0.05 * max(1, n[0, True] + n[0, False]) + 1


def test_odd_rows(spark, odd_documents, no_documents):
    rows = Q.judge(odd_documents.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))).collect()
    assert len(rows) == odd_documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert not by[2][0].kept and by[2][0].n_words == 0 and by[3][0].failed_rules[0] == "base"
    assert by[1][0] == by[1][1]
    assert Q.judge(no_documents).count() == 0
    assert Q.keep_good(odd_documents).columns == odd_documents.columns
    inner = odd_documents.select("*", *[F.lit(1).alias(c) for c in ("__words", "__row", "__text", "__counts")])
    assert Q.judge(inner).count() == Q.keep_good(inner).count() + Q.judge(inner).where("not kept").count() == odd_documents.count()
