"""The pipeline against a brute-force version, and what each stage does to planted documents."""

import re

import corpus_pipeline as P
import public_tokenizers
import sentencepiece
from millrace.llm import line_dedup, quality

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_near_dedup import brute as grouped
from tests.llm.test_quality import WORD, counts


def good(text):
    n, chars, symbols, dup, _, failed = counts(text)
    if failed:
        return False
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = sum(x.lower() in quality.STOP_WORDS for x in w)
    upper = sum(c.isupper() for c in text)
    return (
        2 <= chars / n <= 14
        and symbols / n <= 0.15
        and upper / chars <= 0.4
        and stop / n >= 0.04
        and dup / len(lines) <= 0.5
        and sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines) / len(lines) <= 0.9
        and sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / len(lines) <= 0.3
    )


def test_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if good(t)]
    clean = without_lines(docs, line_dedup.MIN_WORDS)
    docs = [(i, clean[i]) for i, t in docs if clean[i] == t or re.search(r"[^\x20\x09-\x0d]", clean[i])]
    groups = grouped(docs, 5)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    bad = {r[0] for r in contaminated(docs, items) if r[5]}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t, add_bos=True, add_eos=True) for i, t in docs if i not in bad}
    rows = P.run(spark, sf).collect()
    assert {r.doc_id: r.piece_ids for r in rows} == want
    assert all(r.round_trip and r.n_tokens == len(r.piece_ids) for r in rows)
    assert 0 < len(rows) < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_keep_columns_and_take_anything(spark, sf, odd_documents, no_documents):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, odd_documents, sf).dtypes == odd_documents.dtypes
        assert stage(spark, no_documents, sf).count() == 0
    last = P.STAGES[-1][1]
    assert last(spark, odd_documents, sf).count() == odd_documents.count()
    assert last(spark, no_documents, sf).count() == 0


def test_stages_are_the_contract():
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near dedup", "benchmark decontamination", "sentencepiece"]
