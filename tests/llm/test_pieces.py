import hashlib
import random
import struct
from array import array

import public_tokenizers as P
import pytest
import sentencepiece
from millrace.llm import pieces
from pyspark.sql import functions as F

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_equal_the_library(library):
    c = pieces.PieceCodec(MODEL, check_every=1)
    r = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\r", "▁", "▁▁", "the", "e", "é", "漢", "😀", "<s>", "</s>", "<0x41>", "́", "ａ", "\x00", "\xa0", "'s", "...", "Hello"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    theirs = library.encode(texts, add_bos=True, add_eos=True)
    assert [array("I", x).tolist() for x in c.encode_batch(texts)] == theirs
    assert [c.decode(x) for x in theirs] == library.decode(theirs)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids)


def test_both_agendas_agree():
    c = pieces.PieceCodec(MODEL, check_every=0)
    r = random.Random(5)
    units = ["".join(r.choice("▁abcdehilmnorstuvwy.,'é漢") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    assert [array("I", x).tolist() for x in c.merge_many(units)] == [c.merge(u) for u in units]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "UNITS_KEPT", 50)
    c = pieces.PieceCodec(MODEL)
    for n in range(30):
        c.encode_batch([" ".join(f"word{n}x{i}" for i in range(20))])
        assert len(c.words) <= 50 + 20
    assert c.encode("word1x1 word29x3") == library.encode("word1x1 word29x3")


def test_a_difference_raises():
    c = pieces.PieceCodec(MODEL, check_every=1)
    a, b = c.ids["▁the"], c.ids["▁of"]
    c.merge_many = lambda units: [array("I", [a if u != "▁the" else b]).tobytes() for u in units]
    with pytest.raises(pieces.Mismatch):
        c.encode_batch(["the the"])


def test_query_equals_the_library(spark, sf, library):
    import __spark_entry__

    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_sentencepiece"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_odd_rows(spark, odd_documents, no_documents, library):
    clash = odd_documents.withColumn("piece_ids", F.lit("x"))
    rows = pieces.encode_documents(clash, MODEL).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r.piece_ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.piece_text == library.decode(r.piece_ids)
    assert pieces.encode_documents(no_documents, MODEL).count() == 0
