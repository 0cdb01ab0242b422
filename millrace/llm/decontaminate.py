"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Items are cut into windows of ``width`` consecutive words (a shorter item is one window). Words are
ordered by rarity, which is their document frequency over the whole corpus. A text that contains a
window contains all its words, so of the ordered words the necessary prefix is one: the window's rarest
word. Only places where a document has such a word are looked at. The word's offset in the window gives
where the window must start; starts before the text or windows past its end are out by position and
length; what is left is compared word by word, so no hash decides a hit.

Benchmarks are joined in blocks of bounded text (``block_bytes``); the driver and each worker hold one
block's windows and vocabulary only, however large the benchmark is, and every block meets all documents.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; rows
without item id are no items; equal windows of several items count for each; repeated rows are handled
one by one; empty tables give empty results or no hits; columns named as the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.kernel import slices, strings
from millrace.llm.pieces import with_columns

#: Bytes of benchmark text that are joined at once.
BLOCK_BYTES = 2 << 20


def _word_table() -> bytes:
    """ASCII letters in lower case; all ASCII but letters and digits as spaces; other bytes as they are."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


WORD_TABLE = _word_table()


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(WORD_TABLE).split()


def windows_of(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """All windows of an item; the item itself if it is shorter."""
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


class WindowIndex:
    """Windows of one block of items, found through their rarest words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int, frequency: dict[bytes, int]):
        self.items: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for item, text in items:
            for window in windows_of(words_of(text), width):
                self.items[window].append(item)
        # The set join's index: rarest word -> where it stands in windows of which length.
        starts: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for window in self.items:
            rarest = min(set(window), key=lambda w: (frequency.get(w, 0), w))
            starts[rarest].add((window.index(rarest), len(window)))
        self.starts = {w: sorted(s) for w, s in starts.items()}
        self.rarest = frozenset(self.starts)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, one past the last) of windows in a text, and the items they are of."""
        near = self.rarest.intersection(words)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if near:
            n = len(words)
            for p, word in enumerate(words):
                if word in near:
                    for offset, length in self.starts[word]:
                        first = p - offset
                        if first >= 0 and first + length <= n:
                            found = self.items.get(tuple(words[first : first + length]))
                            if found is not None:
                                spans.append((first, first + length))
                                items.update(found)
        return spans, items


def _document_frequency(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary is; counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, text):
                for t in strings(part.column(0)).cast(pa.large_binary()).to_pylist():
                    seen.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.toLocalIterator()}


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text each, one block in memory at a time."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n if total else 0):
        block = rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.item, r.text.encode()) for r in block.toLocalIterator()]


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (array of first, past) and ``hit_items`` (sorted ids).

    Documents are read twice: once to count the rarity of the items' words, once to join. Neither pass
    shuffles texts.
    """
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    schema = with_columns(docs, added)
    kept = [f.name for f in schema.fields[:-3]]
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def step(index: WindowIndex | None, begin: bool, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for part in slices(batch, text):
                    at = part.schema.get_field_index
                    counts, spans, found = [], [], []
                    before = None if begin else list(zip(part.column(at("hit_spans")).to_pylist(), part.column(at("hit_items")).to_pylist(), strict=True))
                    for k, t in enumerate(strings(part.column(at(text))).cast(pa.large_binary()).to_pylist()):
                        words = words_of(t)
                        counts.append(len(words))
                        s, i = known.match(words) if known is not None else ([], set())
                        old = [] if begin else [(x["first"], x["past"]) for x in before[k][0]]
                        spans.append([{"first": a, "past": b} for a, b in sorted({*old, *s})])
                        found.append(sorted(i if begin else i.union(before[k][1])))
                    arrays = [part.column(at(n)) for n in kept]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], schema.names)

        return df.mapInArrow(run, schema)

    out, begin = docs, True
    for block in item_blocks(items, item_id, item_text, block_bytes):
        vocabulary = frozenset(w for _, t in block for w in words_of(t))
        out = step(WindowIndex(block, width, _document_frequency(docs, text, vocabulary)), begin, out)
        begin = False
    return out if not begin else step(None, True, out)


def covered(spans: list[tuple[int, int]]) -> int:
    """Words that lie in any of the sorted spans."""
    total, past = 0, 0
    for first, last in spans:
        total += max(0, last - max(first, past))
        past = max(past, last)
    return total


def contamination_digest(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document the number of words, words in hits, and items, with a digest of the item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x["first"], x["past"]) for x in s] for s in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            hits = np.array([covered(s) for s in spans], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(hits),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                    pa.array(hits > 0),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    columns = marked.select(doc_id, "n_words", "hit_spans", "hit_items")
    return columns.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", width: int = 10, max_share: float = 0.0) -> DataFrame:
    """``docs`` without those of whose words more than ``max_share`` lie in item windows."""
    marked = mark_contamination(docs, items, text, width=width)
    inside = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("past")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["past"] - F.greatest(s["first"], acc["past"]))).alias("n"), F.greatest(acc["past"], s["past"]).alias("past")),
    )["n"]
    return marked.where(inside <= F.col("n_words") * F.lit(max_share)).select(*docs.columns)
