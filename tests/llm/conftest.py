import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 22),
        (1, "the cat sat on the mat", "en", "a", 22),
        (2, None, None, None, None),
        (None, "text without an id", "en", "a", 18),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "en", "a", 4),
        (5, LONG, "en", "b", len(LONG)),
        (6, "one", "en", "b", 3),
        (7, "é漢字 😀 \x00 \x1c  end ", "xx", "b", 14),
        (8, "<|endoftext|> <s> </s> ▁ a▁b", "xx", "b", 28),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def planted(spark):
    """Documents with exact copies, near copies at many distances, and chains of them."""
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(base))
        now = base
        for _ in range(r.randint(0, 6)):
            now = list(now if r.random() < 0.5 else base)
            for _ in range(r.randint(0, 5)):
                now[r.randrange(len(now))] = r.choice(vocabulary)
            texts.append(" ".join(now).upper() if r.random() < 0.2 else " ".join(now))
    texts += [None, "", "  ", "one", "ONE", "two words", "two words"]
    r.shuffle(texts)
    return spark.createDataFrame([(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC_SCHEMA)
