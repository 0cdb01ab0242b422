import math
import re
import zlib
from collections import Counter

import numpy as np
from millrace.llm import pitman_yor as P

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "\n"]


def base(rows):
    """What the contract fixes, counted plainly."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(tokens(x)), sum(t in c for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in rows]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = P.score_documents(df).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    ours = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(ours, sorted(base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9), (a, b)
    return got


def test_base_and_better_perplexity(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    ours, plain = (10 ** (-sum(x) / n) for x in ([r.score for r in held], [r.base_score for r in held]))
    assert all(r.score < 0 for r in got)
    assert ours < plain


def test_odd_rows(spark, odd_documents, no_documents, planted):
    assert len(check(odd_documents)) == odd_documents.count()
    assert P.score_documents(no_documents).count() == 0
    check(planted)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    words, contexts = r.integers(1, 60, 4000).astype(np.uint64), r.integers(0, P.CONTEXTS, 4000) % 7
    totals = np.bincount(contexts, minlength=P.CONTEXTS)
    s = P.Seating(words, contexts, np.ones(4000, np.int64), totals, 4000, 1)
    tables, v = s.table_sums(), len(s.words)
    for k in (0, 3, 500):
        every = np.concatenate([s.words, np.array([10**9], np.uint64)])
        log_p, _, _ = s.score(every, np.full(len(every), k), tables, v)
        assert math.isclose((10**log_p).sum(), 1, rel_tol=1e-9)


def test_stirling_numbers_and_table_counts():
    table = P.log_stirling(6, 0.5)
    # S_d(3, t): 1 table (1-d)(2-d), 2 tables 3(1-d), 3 tables 1
    assert np.allclose(np.exp(table[3, 1:4]), [0.5 * 1.5, 3 * 0.5, 1])
    words = np.repeat(np.arange(1, 20, dtype=np.uint64), 30)
    s = P.Seating(words, np.zeros(len(words), np.int64), np.ones(len(words), np.int64), np.bincount([0], [len(words)], minlength=P.CONTEXTS), len(words), 5)
    for t in s.samples:
        assert (t >= 1).all() and (t <= s.c).all()


def test_scores_equal_one_place_with_every_context(spark, planted):
    # Every context has its own restaurant, and all sums are the true ones: as in one place that has the whole corpus.
    rows = [(r.doc_id, r.text) for r in planted.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words = {t: int(h) for _, x in rows for t, h in zip(tokens(x), P.tokens_of(P.pa.array([x]))[0], strict=True)}
    back = {t: n for n, t in enumerate(["", *words], start=0)}
    pairs = [(words[t], back[k]) for i, x in rows if not held[i] for k, t in zip(["", *tokens(x)], tokens(x), strict=False)]
    w, k = np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs])
    c = Counter(pairs)
    totals = Counter(b for _, b in pairs)
    got = {r.doc_id: r.score for r in P.score_documents(planted).collect()}
    one = P.Seating(w, k, np.ones(len(w), np.int64), np.bincount(k, minlength=len(back)), len(w), 0)
    assert len(totals) > 400 and len(one.key) == len(c)
    want = 0.0
    for _, x in rows:
        t = tokens(x)
        want += one.score(np.array([words[y] for y in t], np.uint64), np.array([back[y] for y in ["", *t[:-1]]]), one.table_sums(), len(one.words))[0].sum()
    # Random numbers differ, the model doesn't.
    assert math.isclose(want, sum(got.values()), rel_tol=0.01)


def test_every_word_is_a_context_of_its_own():
    _, contexts, _ = P.tokens_of(P.pa.array([" ".join(f"w{i}" for i in range(5000))]))
    assert len(np.unique(contexts)) == 5001


def test_scores_do_not_depend_on_the_number_of_places(spark, planted, monkeypatch):
    once = {r.doc_id: r.score for r in P.score_documents(planted).collect()}
    monkeypatch.setattr(P, "PLACE_BYTES", 2000)
    again = {r.doc_id: r.score for r in P.score_documents(planted).collect()}
    assert once.keys() == again.keys() and all(math.isclose(once[i], again[i], rel_tol=1e-9) for i in once)


def test_tables_of_large_dishes_are_drawn_from_their_own_distribution(monkeypatch):
    c = 700
    exact = P.log_stirling(c, P.DISCOUNT)[c]
    t = np.array([1, 2, 9, 80, 300, 600])
    assert np.allclose(P.log_stirling_large(np.full(6, c), t), exact[t], atol=0.01)
    args = (np.full(800, 300.0), np.full(800, 40.0), 1e4, 1e-3, np.random.default_rng(2).random(800))
    small = P.draw_tables(np.full(800, c), *args)
    monkeypatch.setattr(P, "EXACT", 100)
    monkeypatch.setattr(P, "_STIRLING", [])
    large = P.draw_tables(np.full(800, c), *args)
    assert (np.abs(small - large) <= 1).all()
