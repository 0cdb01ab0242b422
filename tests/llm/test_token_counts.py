import random

import public_tokenizers as P
import pytest
from millrace.llm import token_counts as C
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FILE = P.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "'re", "'ll", "'", "r", "l", "the", "é", "漢", "😀", "<|endoftext|>", "<|endof", "\xa0", "　", "\x1c", "\x85", "12", "३", "Ⅷ", "_", "...", "A", "́", "​", "'s"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(library):
    c, r = C.PrefixCounter(FILE), random.Random(4)
    for _ in range(800):
        x = "".join(r.choice(PARTS) for _ in range(r.randint(0, 9)))
        assert c.prefix_counts(x).tolist() == [library(x[:i]) for i in range(len(x) + 1)], x
        assert c.count(x) == library(x)


def test_budgets_need_no_encoding(library):
    c = C.PrefixCounter(FILE)
    text = "The quick brown fox,  don't you know?\n\nIt's here. " * 5
    table = c.prefix_counts(text)
    for budget in (0, 1, 7, 20, 1000):
        n = C.longest_prefix(table, budget)
        assert library(text[:n]) <= budget and all(library(text[:m]) > budget for m in range(n + 1, min(n + 6, len(text)) + 1))
    assert C.fits(table, 10, library(text[:10])) and not C.fits(table, len(text), library(text) - 1)
    ends = C.cut_points(table, 10)
    assert ends[-1] == len(text) and ends == sorted(set(ends))


def test_query_equals_the_library(spark, sf, library):
    import __spark_entry__

    got = {r.doc_id: r for r in __spark_entry__.queries()["op4_token_counts"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n = library(r.text or "")
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 1024)


def test_odd_rows(spark, odd_documents, no_documents, library):
    rows = C.count_tokens(odd_documents.withColumn("n_tokens", F.lit("x")), FILE, prefixes=True).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r.n_tokens == library(r.text or "") == r.prefix_tokens[-1]
        assert len(r.prefix_tokens) == len(r.text or "") + 1
    assert C.count_tokens(no_documents, FILE).count() == 0
