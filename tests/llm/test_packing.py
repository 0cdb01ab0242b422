import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from millrace.llm import packing
from pyspark.sql import functions as F

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encode():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: [*e.encode_ordinary(t or ""), 50256]


def plain_best_fit(lengths, capacity):
    """Best fit decreasing with a scan over all rows."""
    rows = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rows if sum(r) + n <= capacity]
        max(fits, key=sum).append(n) if fits else rows.append([n])
    return sorted(sorted(r) for r in rows)


def test_tree_search_equals_a_scan():
    r = random.Random(3)
    for capacity in (1, 7, 64, 100):
        for _ in range(40):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
            rows = packing.best_fit_decreasing(lengths, capacity)
            assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in row) <= capacity for row in rows)
            assert sorted(sum(lengths[i] for i in row) for row in rows) == sorted(map(sum, plain_best_fit(lengths, capacity)))


def check(df, encode, row_tokens, **kw):
    packed = packing.pack_documents(df, RANKS, P.PATTERN, 50256, row_tokens=row_tokens, **kw)
    rows = packed.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        assert len(r.ids) == len(r.positions) == row_tokens and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert len(r.doc_ids) == len(r.pieces) == len(r.cu_seqlens) - 1
        want = np.concatenate([np.arange(b - a) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])])
        assert r.positions[: r.n_tokens] == want.tolist() and not any(r.ids[r.n_tokens :]) and not any(r.positions[r.n_tokens :])
    back = {}
    for r in packing.unpack(packed).collect():
        back.setdefault(r.doc_id, []).append((r.piece, r.ids))
    want = {}
    for r in df.select("doc_id", "text").collect():
        ids = encode(r.text)
        want.setdefault(r.doc_id, []).extend((n, ids[a : a + row_tokens]) for n, a in enumerate(range(0, len(ids), row_tokens)))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    return rows


def test_every_id_comes_back(spark, sf, encode):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check(docs.coalesce(1), encode, 512)
    assert sum(r.n_tokens for r in rows) / (512 * len(rows)) > 0.97
    check(docs, encode, 128, block_tokens=5000)


def test_odd_rows(spark, odd_documents, no_documents, encode):
    check(odd_documents.withColumn("ids", F.lit(1)), encode, 256)
    assert packing.pack_documents(no_documents, RANKS, P.PATTERN, 50256).count() == 0


def test_written_matrices(spark, sf, tmp_path):
    packed = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), RANKS, P.PATTERN, 50256, row_tokens=256)
    packing.write_packed(packed, str(tmp_path / "out"))
    written = {r.pack_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for r in packed.collect():
        assert np.frombuffer(written[r.pack_id].ids, "<i4").tolist() == r.ids
        assert np.frombuffer(written[r.pack_id].positions, "<i4").tolist() == r.positions


def test_query(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.queries()["op6_packing"](spark, sf).collect()
    assert sum(len(r.pieces) for r in rows) >= spark.read.parquet(f"{sf}/documents.parquet").count()
