import numpy as np
import pyarrow as pa
from millrace.llm import toxicity as X
from pyspark.sql import functions as F


def made(spark, n=600):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.integers(0, 300)}" for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            words[r.integers(0, 40)] = ["vile", "nasty"][i % 16 // 8]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    model = X.train(docs, labels.where("doc_id < 450"))
    rows = X.score(docs.where("doc_id >= 450"), model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in rows)
    assert len(model[0]) < 2000


def test_labels_are_no_input_of_scores(spark):
    docs, labels = made(spark, 200)
    model = X.train(docs, labels)
    a = {r.doc_id: r.score for r in X.score(docs.withColumn("toxic", F.lit(1)), model).collect()}
    b = {r.doc_id - 7: r.score for r in X.score(docs.withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert a == b


def test_the_sample_is_bounded(spark):
    docs, labels = made(spark, 300)
    small = X.train(docs, labels, how=X.Ftrl(sample=50))
    again = X.train(docs.repartition(5), labels.repartition(3), how=X.Ftrl(sample=50))
    assert all(np.array_equal(a, b) for a, b in zip(small, again, strict=True))


def test_features_stay_in_their_text():
    one = X.features(pa.array(["a b", "c d", "", None]))
    assert sorted(np.bincount(one[0], minlength=4).tolist()) == [0, 0, 3, 3]


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    model = X.train(odd_documents, labels)
    rows = X.score(odd_documents.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    none = X.train(no_documents, labels.limit(0))
    assert X.score(no_documents, none).count() == 0
    assert all(r.score < 0.3 for r in X.score(odd_documents, none).collect())


def test_query(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.queries()["op9_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.predicted for r in rows} <= {0, 1} and all((r.score >= 0.3) == bool(r.predicted) for r in rows)
