"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between, A-Z
lower-cased. FTRL-proximal keeps two sums per coordinate, which give each its own learning rate, and L1
keeps the weights of all but telling features at exactly zero; what is left is a short list of (coordinate,
weight) that is broadcast (at most 2^18 entries, whatever the input).

The model is fitted on a bounded sample of labelled rows (``sample``: the rows with the least hashes of
their ids, so the same ones each time) in one task; scoring covers every row and shuffles nothing.

Defined cases: null and empty texts have no features and get the score of the bias; null ids, null labels
and labels without document are not learned from; of several labels of an id the largest counts; without
any label the bias is that of a rare class; ties and repeated rows get equal scores; an empty table gives
an empty table; columns named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.kernel import mix64, slices, word_hashes
from millrace.llm.pieces import with_columns

DIMENSION_BITS = 18
DIMENSION = 1 << DIMENSION_BITS
_KINDS = mix64(np.arange(1, 4, dtype=np.uint64))


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the fit. ``sample`` bounds the labelled rows that are learned from.

    Rates and penalties were chosen by log loss on an inner fifth of the labels that may be learned from (never
    on the held-out quarter).
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 4
    sample: int = 12_000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of every feature occurrence of all texts."""
    hashes, bounds = word_hashes(column)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    texts, places = [text], [mix64(hashes + _KINDS[0])]
    for gap in (1, 2):
        same = text[:-gap] == text[gap:]
        texts.append(text[:-gap][same])
        places.append(mix64(mix64(hashes[:-gap][same] + _KINDS[gap]) + hashes[gap:][same]))
    return np.concatenate(texts), (np.concatenate(places) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that aren't zero, and the bias."""
    z, n = np.zeros(DIMENSION), np.zeros(DIMENSION)
    rate = (sum(y for _, y in examples) + 0.1) / (len(examples) + 1.0)
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= how.l1, 0.0, -(zs - np.sign(zs) * how.l1) / ((how.beta + np.sqrt(ns)) / how.alpha + how.l2))

    for epoch in range(how.epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)).tolist():
            at, y = examples[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            root = np.sqrt(ns)
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / how.alpha * w
            n[at] = ns + g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", how: Ftrl | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the sample of ``labels`` (already without held-out rows)."""
    how = how or Ftrl()
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(how.sample)
    )
    # At most ``sample`` rows of two numbers, small enough to send to every task by construction.
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, place = features(part.column(1))
                flat = np.unique(at << DIMENSION_BITS | place)
                bounds = np.searchsorted(flat, np.arange(part.num_rows + 1) << DIMENSION_BITS)
                each = [(flat[a:b] & (DIMENSION - 1)).astype(np.int32).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(each, pa.binary())], ["id", "y", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, p, y) for batch in batches for i, y, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        at, w, bias = fit([(np.frombuffer(p, np.int32), y) for _, p, y in rows], how)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int64)), pa.array(np.concatenate([[bias], w]))], ["place", "weight"])

    # Features are made where the texts are; only those of the sample go to the task that learns.
    fitted = texts.select("id", "text", "y").mapInArrow(prepare, "id long, y int, places binary").repartition(1).mapInArrow(learn, "place long, weight double")
    rows = fitted.toPandas()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(0.1 / 0.9))
    own = rows[rows.place >= 0]
    return own.place.to_numpy(), own.weight.to_numpy(), float(rows[rows.place < 0].weight.iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score``, the probability of the label, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_columns(docs, [T.StructField("score", T.DoubleType())])
    if not keep_text:
        schema = T.StructType([f for f in schema if f.name != text])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weight = np.zeros(DIMENSION)
        weight[at] = w
        for batch in batches:
            for part in slices(batch, text):
                owner, place = features(part.column(part.schema.get_field_index(text)))
                hit = weight[place] != 0
                once = np.unique(owner[hit] << DIMENSION_BITS | place[hit])
                total = np.bincount(once >> DIMENSION_BITS, weight[once & (DIMENSION - 1)], minlength=part.num_rows) + bias
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept] + [pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))], schema.names)

    return docs.mapInArrow(run, schema)
