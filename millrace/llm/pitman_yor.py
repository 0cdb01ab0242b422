"""Scores of texts under a hierarchical Pitman-Yor language model.

Every context has a Chinese restaurant whose customers are the words seen after it. A context is the word
before, by its 64-bit hash, so there are as many restaurants as the corpus has contexts; all of them share one
parent restaurant, whose customers are their tables; above it new words come from a mass of their own. A word
w after context k has

    p(w | k) = (c_kw - d t_kw) / (theta + c_k)  +  (theta + d t_k) / (theta + c_k) * p(w)

with c customers and t tables. Seating is sampled by Gibbs: given everything else, the number of tables at
which a dish's c customers sit has probability ~ S_d(c, t) times the rising factorials of its restaurant's and
the parent's tables, with the generalised Stirling numbers S_d; all customers of a dish in a restaurant are
drawn at once. Up to ``EXACT`` customers S_d comes from a table, beyond from the coefficients of
(1 - (1 - z)^d)^t, by quadrature along a contour or at the saddle point. The predictive probabilities of
several samples after burn-in are averaged.

How it is laid out: a grid of places is spanned by the hashes of contexts and of words, so a key is in one row or
column of it and a common one in many places. Texts are taken a buffer at a time; a buffer deals its distinct
pairs out to the places, with their training counts. A place keeps its pairs and, for each buffer, which of them it
was dealt. Pairs that occur once always sit at one table, so only the others are drawn; after each sweep their
tables are summed by context and by word in shards (parts of a row or column of the grid) and the sums go back to
the places that have the key. So each sweep is conditioned on the true sums of the one before; all pairs are drawn
at once from these, with random numbers of the pair's hash, and scores don't depend on the number of places. In
the end a place gives each buffer the probabilities of the pairs that it dealt, and a second pass over the texts
adds them up. Rows moved are buffers times places at most, never more than distinct pairs. Only totals of the
whole corpus reach the driver.

The texts are read twice and must come in the same partitions and order (a table or a checkpoint); a buffer that
comes out otherwise the second time is an error, never a wrong score.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Unseen words share one
outcome. Logarithms have base 10.

Defined cases: null and empty texts are one end token; null ids are learned from (they are in no fold);
repeated rows are learned from and scored one by one; without training texts every token is unseen, the
model's score is 0 and the base is as defined; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.kernel import mix64, slices, word_hashes
from millrace.llm.work import checkpointed, release

#: Contexts of a ``Seating``, the model of one place with all its sums at hand.
CONTEXTS = 1024
#: Customers up to which Stirling numbers come from a table.
EXACT = 1024
BURN_IN, SAMPLES = 2, 3
#: Discounts and strengths of the context restaurants and of their parent.
DISCOUNT, STRENGTH, TOP_DISCOUNT, TOP_STRENGTH = 0.85, 1.0, 0.6, 1.0
#: Bytes of text whose pairs make one place.
PLACE_BYTES = 24 << 20
#: Tokens whose pairs are dealt out together.
BUFFER = 1_200_000

END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: The context of a text's first token.
START = np.uint64(0x57A7)


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t) for 1 <= t <= c <= n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        stay = np.log(np.maximum(c - d * t, 1e-300)) + out[c]
        stay[c - d * t <= 0] = -np.inf
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


_STIRLING: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _STIRLING:
        _STIRLING.append(log_stirling(EXACT, DISCOUNT))
    return _STIRLING[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    x = np.asarray(x, np.float64)
    y = x + 8
    low = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


_ANGLE = np.linspace(0, 4, 41)


def log_stirling_large(c: np.ndarray, t: np.ndarray, d: float = DISCOUNT) -> np.ndarray:
    """log S_d(c, t) for large c and real 1 <= t <= c.

    S_d(c, t) = c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t. The coefficient is an integral over s, z = exp(-s), along
    a parabola around the cut s < 0; where the saddle is far from the cut, its own value is as good.
    """
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    lo, hi = np.full(c.shape, -700.0), np.full(c.shape, -1e-9)
    goal = np.log(c / t)
    for _ in range(50):
        x = (lo + hi) / 2
        above = math.log(d) + (d - 1) * x + np.log(-np.expm1(x)) - np.log(-np.expm1(d * x)) > goal
        lo, hi = np.where(above, x, lo), np.where(above, hi, x)
    q = np.exp((lo + hi) / 2)
    s = -np.log1p(-q)
    qd = q**d
    curve = c / t * ((1 - q) / np.maximum(q, 1e-300)) * ((1 - d) + q / (1 - q) - d * qd / (1 - qd))
    out = t * np.log1p(-qd) + s * c - 0.5 * np.log(2 * math.pi * np.maximum(t * curve, 1e-300))
    near = s * c < 30
    if near.any():
        cn, tn = c[near][:, None], t[near][:, None]
        mu = np.maximum(s[near][:, None], 2 / cn)
        ray = 1 + 1j * _ANGLE
        at = mu * ray**2
        value = tn * np.log(1 - (-np.expm1(-at)) ** d) + at * cn
        first = value[:, :1].real
        sums = (np.exp(value - first) * ray).real
        sums[:, 0] /= 2
        total = sums.sum(axis=1) * (_ANGLE[1] - _ANGLE[0]) * 2 * mu[:, 0] / math.pi
        out[near] = first[:, 0] + np.log(np.maximum(total, 1e-300))
    out = np.where(t >= c, c * math.log(d), out)
    return out + log_gamma(c + 1) - log_gamma(t + 1) - t * math.log(d)


def _rising(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    return log_gamma(a + t) - log_gamma(a)


def draw_tables(c: np.ndarray, tables: np.ndarray, dish: np.ndarray, tables_all: float, fresh: float, uniform: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the other tables of their restaurant and dish, and of all.

    ``fresh``: probability of a dish that no other table has, for its first one.
    """
    t = np.minimum(c, 1)
    stirling = _table()
    order = np.flatnonzero((c > 1) & (c <= EXACT))
    order = order[np.argsort(c[order], kind="stable")]
    first = 0
    while first < len(order):
        width = int(c[order[first]])
        top = width if width <= 16 else min(EXACT, 2 * width)
        past = int(np.searchsorted(c[order], top, side="right"))
        past = min(past, first + max(1, (1 << 19) // top))
        rows = order[first:past]
        i = np.arange(top)
        others = dish[rows, None] + i
        parent = np.where(others > 0, (others - TOP_DISCOUNT) / (TOP_STRENGTH + tables_all + i), fresh)
        weight = stirling[c[rows], 1 : top + 1] + np.log((STRENGTH + DISCOUNT * (tables[rows, None] + i)) * parent).cumsum(axis=1)
        weight -= weight.max(axis=1, keepdims=True)
        heap = np.exp(weight).cumsum(axis=1)
        t[rows] = np.minimum((heap < uniform[rows, None] * heap[:, -1:]).sum(axis=1) + 1, c[rows])
        first = past
    large = np.flatnonzero(c > EXACT)
    for first in range(0, len(large), 512):
        rows = large[first : first + 512]
        t[rows] = _draw_large(c[rows], tables[rows], dish[rows], tables_all, fresh, uniform[rows])
    return t


def _draw_large(c: np.ndarray, tables: np.ndarray, dish: np.ndarray, tables_all: float, fresh: float, uniform: np.ndarray) -> np.ndarray:
    c, tables, dish = c[:, None].astype(np.float64), tables[:, None], dish[:, None]
    # The first table of a dish without others, then the rest.
    lead = np.where(dish > 0, 0.0, math.log(fresh) - math.log((1 - TOP_DISCOUNT)) + math.log(TOP_STRENGTH + tables_all))
    above = np.where(dish > 0, dish - TOP_DISCOUNT, 1 - TOP_DISCOUNT)

    def weight(t: np.ndarray) -> np.ndarray:
        own = t * math.log(DISCOUNT) + _rising(STRENGTH / DISCOUNT + tables, t)
        up = np.where(dish > 0, _rising(above, t), _rising(above, t - 1) + math.log(1 - TOP_DISCOUNT)) - _rising(np.float64(TOP_STRENGTH + tables_all), t)
        return log_stirling_large(c, t) + own + up + lead

    t = np.exp(np.linspace(0, 1, 41) * np.log(c))
    points, low, high = 41, np.ones_like(c), c
    for _ in range(4):
        w = weight(t)
        good = w > w.max(axis=1, keepdims=True) - 30
        a = np.maximum(good.argmax(axis=1) - 1, 0)
        b = np.minimum(t.shape[1] - good[:, ::-1].argmax(axis=1), t.shape[1] - 1)
        rows = np.arange(len(c))
        low, high = np.floor(t[rows, a])[:, None], np.minimum(np.ceil(t[rows, b])[:, None], c)
        points = 65
        step = np.maximum((high - low) / (points - 1), 1)
        t = np.minimum(low + step * np.arange(points), c)
    w = weight(t)
    # Narrow ranges have a point for each number; those beyond the end would repeat it.
    w[:, 1:][(t[:, 1:] <= t[:, :-1]) | (t[:, 1:] > high + 0.5)] = -np.inf
    heap = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
    goal = uniform * heap[:, -1]
    at = np.minimum((heap < goal[:, None]).sum(axis=1), points - 1)
    rows = np.arange(len(c))
    before = np.where(at > 0, heap[rows, at - 1], 0)
    within = (goal - before) / np.maximum(heap[rows, at] - before, 1e-300) - 0.5
    drawn = np.where(step[:, 0] > 1, t[rows, at] + within * step[:, 0], t[rows, at])
    return np.clip(np.rint(drawn), 1, c[:, 0]).astype(np.int64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with ends, contexts (the token before), and bounds of each text's tokens."""
    hashes, bounds = word_hashes(column)
    n = len(bounds) - 1
    words = np.diff(bounds)
    ends = np.cumsum(words + 1)
    tokens = np.empty(len(hashes) + n, np.uint64)
    last = np.zeros(len(tokens), bool)
    last[ends - 1] = True
    tokens[~last] = hashes
    tokens[last] = END
    context = np.empty(len(tokens), np.uint64)
    context[1:] = tokens[:-1]
    context[np.concatenate([[0], ends[:-1]])[:n]] = START
    return tokens, context, np.concatenate([[0], ends])


def pairs_of(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """64 bits that name a word after a context."""
    return mix64(words + mix64(contexts ^ np.uint64(0x9A1A)))


def _uniform(pairs: np.ndarray, sweep: int) -> np.ndarray:
    return (mix64(pairs ^ mix64(np.array([sweep + 77], np.uint64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], bool)


def _first_tables(c: np.ndarray) -> np.ndarray:
    return np.minimum(c, np.ceil(c**DISCOUNT).astype(np.int64))


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.rint(np.bincount(at, x, minlength=n)).astype(np.int64)


def _sweep(pairs: np.ndarray, c: np.ndarray, t: np.ndarray, tables: np.ndarray, dish: np.ndarray, tables_all: int, vocabulary: int, sweep: int) -> np.ndarray:
    """New tables of pairs, given the sums of tables of their context, of their word and of all."""
    seen = c > 0
    fresh = (TOP_STRENGTH + TOP_DISCOUNT * vocabulary) / (TOP_STRENGTH + tables_all) / max(1, vocabulary)
    out = np.zeros_like(t)
    out[seen] = draw_tables(c[seen], (tables - t)[seen], (dish - t)[seen], float(tables_all), fresh, _uniform(pairs[seen], sweep))
    return out


def _probability(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, dish: np.ndarray, tables_all: int, vocabulary: int) -> np.ndarray:
    top = TOP_STRENGTH + tables_all
    parent = np.where(dish > 0, dish - TOP_DISCOUNT, TOP_STRENGTH + TOP_DISCOUNT * vocabulary) / top
    return (c - DISCOUNT * t + (STRENGTH + DISCOUNT * tables) * parent) / (STRENGTH + customers)


class Seating:
    """The model of one place that has the whole corpus, with contexts as numbers."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, counts: np.ndarray, context_totals: np.ndarray, total: int, seed: int):
        """words, contexts, counts: training tokens (repeats are added up)."""
        self.words, pair = np.unique(words, return_inverse=True)
        self.key, at = np.unique(pair * len(context_totals) + contexts, return_inverse=True)
        self.c = _sums(at, counts, len(self.key))
        self.word, self.context = self.key // len(context_totals), self.key % len(context_totals)
        self.count, self.context_totals = _sums(self.word, self.c, len(self.words)), context_totals
        self.samples: list[np.ndarray] = []
        t, pairs = _first_tables(self.c), pairs_of(self.words[self.word], self.context.astype(np.uint64))
        for sweep in range(BURN_IN + SAMPLES):
            t = _sweep(pairs, self.c, t, self._by_context(t)[self.context], self._by_word(t)[self.word], int(t.sum()), len(self.words), sweep + seed)
            if sweep >= BURN_IN:
                self.samples.append(t)

    def _by_context(self, t: np.ndarray) -> np.ndarray:
        return _sums(self.context, t, len(self.context_totals))

    def _by_word(self, t: np.ndarray) -> np.ndarray:
        return _sums(self.word, t, len(self.words))

    def table_sums(self) -> np.ndarray:
        """Tables by sample and context."""
        return np.array([self._by_context(t) for t in self.samples])

    def score(self, words: np.ndarray, contexts: np.ndarray, tables: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities of the model, training counts, and whether known, of tokens."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        k = np.minimum(np.searchsorted(self.key, at * len(self.context_totals) + contexts), len(self.key) - 1)
        seen = known & (self.key[k] == at * len(self.context_totals) + contexts)
        p = np.zeros(len(words))
        for t, own in zip(self.samples, tables, strict=True):
            p += _probability(
                np.where(seen, self.c[k], 0), np.where(seen, t[k], 0), self.context_totals[contexts], own[contexts], np.where(known, self._by_word(t)[at], 0), int(t.sum()), vocabulary
            )
        return np.log10(p / len(self.samples)), np.where(known, self.count[at], 0), known


# ------------------------------------------------------------------------- places

_ROWS = "seat int, kind int, place int, name long, n long, blob binary"
_NAMES = ["seat", "kind", "place", "name", "n", "blob"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
DEALT, FIXED, DRAWN, BY_CONTEXT, BY_WORD, SHARD_CONTEXT, SHARD_WORD, TEXTS = range(8)
_SIDES = (BY_CONTEXT, BY_WORD)


def _pack(*arrays: np.ndarray) -> bytes:
    """Floats, and whole numbers from 0 on: rising ones as differences, all as planes of bytes."""
    made = []
    for x in arrays:
        back, rising = x.dtype.str, False
        if x.dtype.kind != "f":
            back = "<u8" if x.dtype == np.uint64 else "<i8"
            x = x.astype(np.uint64)
            rising = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
            if rising:
                x = np.concatenate([x[:1], x[1:] - x[:-1]])
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        made.append((back, rising, x.dtype.str, x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()))
    raw = pickle.dumps(made, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for back, rising, kind, raw in pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)):
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
        x = x.astype(back)
        out.append(np.cumsum(x, dtype=back) if rising else x)
    return out


def _batch(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_TYPES)], _NAMES)


def _grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each group in a partition."""
    held: dict[tuple, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(tuple(r[n] for n in names), []).append(r)
    for key in sorted(held):
        yield key, held.pop(key)


def _mapped(df: DataFrame, f, schema: str = _ROWS) -> DataFrame:
    return df.mapInArrow(f, schema)


class Grid:
    """Places by hash of context (rows) and of word (columns); the shards of a row or column are as many as its places."""

    def __init__(self, docs: DataFrame, size: int):
        self.side = max(2, math.ceil(math.sqrt(size / PLACE_BYTES)))
        self.places = self.side**2
        # For each place a number that Spark's hash deals to a partition of its own.
        tries = docs.sparkSession.range(40 * self.places + 400).select(F.col("id").cast("int").alias("seat"))
        found = tries.groupBy(F.pmod(F.hash("seat"), F.lit(self.places)).alias("place")).agg(F.min("seat").alias("seat")).collect()
        self.seats = [s for _, s in sorted((r.place, r.seat) for r in found)]

    def place(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (mix64(contexts) % np.uint64(self.side) * np.uint64(self.side) + mix64(words) % np.uint64(self.side)).astype(np.int64)

    def line(self, kind: int, place: int) -> int:
        return place // self.side if kind == BY_CONTEXT else place % self.side

    def part(self, keys: np.ndarray) -> np.ndarray:
        """Which shard of its line has a key."""
        return (mix64(keys ^ np.uint64(0x5A5A)) % np.uint64(self.side)).astype(np.int64)

    def asked(self, kind: int, place: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a place says of its keys, to the shards."""
        part = self.part(keys)
        for j in np.unique(part).tolist():
            own = part == j
            shard = self.line(kind, place) * self.side + j
            yield _batch((self.seats[shard], kind, place, shard, 0, _pack(keys[own], *[v[own] for v in values])))

    def answered(self, rows: list[dict], kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """The values of a place's keys, from the answers of its shards."""
        answers = [_unpack(r["blob"]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["name"])]
        order = np.argsort(self.part(keys), kind="stable")
        out = []
        for x in zip(*answers, strict=True):
            values = np.empty(len(keys), np.int64)
            values[order] = np.concatenate(x)
            out.append(values)
        return out

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.places, "seat")


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Ids, tokens and bounds of consecutive texts, some ``BUFFER`` tokens at a time."""

    def joined() -> tuple[list[int | None], np.ndarray, np.ndarray]:
        lengths = np.concatenate([np.diff(bounds) for _, _, bounds in held])
        return [i for ids, _, _ in held for i in ids], np.concatenate([words for _, words, _ in held]), np.concatenate([[0], np.cumsum(lengths)])

    held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            words, _, bounds = tokens_of(part.column(1))
            held.append((part.column(0).to_pylist(), words, bounds))
            size += len(words)
            if size >= BUFFER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _entries(words: np.ndarray, bounds: np.ndarray, grid: Grid) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a buffer by place, context and word.

    Name of the buffer (a hash of its pairs), sorted keys, contexts and words (places among the keys), places, and
    which pair each token is.
    """
    keys, w = np.unique(np.append(words, START), return_inverse=True)
    k = np.empty(len(words), np.int64)
    k[1:] = w[:-2]
    k[bounds[:-1]] = w[-1]
    code, at = np.unique(k * len(keys) + w[:-1], return_inverse=True)
    k, w = np.divmod(code, len(keys))
    place = grid.place(keys[k], keys[w])
    order = np.argsort(place, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    name = int(mix64(np.array([mix64(pairs_of(keys[w], keys[k])).sum(dtype=np.uint64)])).view(np.int64)[0])
    return name, keys, k[order], w[order], place[order], rank[at]


def _deal(grid: Grid):
    """Distinct pairs of each buffer with their training counts, to their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds in _buffers(batches):
            name, keys, k, w, place, at = _entries(words, bounds, grid)
            n = _sums(at, np.repeat(~_held_out(ids), np.diff(bounds)), len(k))
            for p in np.unique(place).tolist():
                a, b = np.searchsorted(place, [p, p + 1])
                ku, kk = np.unique(k[a:b], return_inverse=True)
                wu, ww = np.unique(w[a:b], return_inverse=True)
                yield _batch((grid.seats[p], DEALT, p, name, 0, _pack(keys[ku], kk, keys[wu], ww, n[a:b])))

    return run


def _open(grid: Grid):
    """The pairs of each place by context and word: keys, counts, and which of them each buffer dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place,), rows in _grouped(batches, "place"):
            parts = [_unpack(r["blob"]) for r in rows]
            u, v = (np.unique(np.concatenate([x[i] for x in parts])) for i in (0, 2))
            code = np.concatenate([np.searchsorted(u, ku)[kk] << 32 | np.searchsorted(v, wu)[ww] for ku, kk, wu, ww, _ in parts])
            code, at = np.unique(code, return_inverse=True)
            c = _sums(at, np.concatenate([x[4] for x in parts]), len(code))
            cuts = np.cumsum([len(x[4]) for x in parts])[:-1]
            names = np.array([r["name"] for r in rows], np.int64).view(np.uint64)
            yield _batch((grid.seats[place], FIXED, place, 0, int(c.sum()), _pack(u, v, code >> 32, code & 0xFFFFFFFF, c, names, *np.split(at, cuts))))

    return run


def _ask_all(grid: Grid):
    """Of every key of a place: customers, pairs of one, first tables of the others, and whether it has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u, v, k, w, c = _unpack(r["blob"])[:5]
                more = c > 1
                t = _first_tables(c[more])
                for kind, keys, x in ((BY_CONTEXT, u, k), (BY_WORD, v, w)):
                    n = len(keys)
                    yield from grid.asked(kind, r["place"], keys, _sums(x, c, n), np.bincount(x[c == 1], minlength=n), _sums(x[more], t, n), np.bincount(x[more], minlength=n) > 0)

    return run


def _first_seats(grid: Grid):
    """What is drawn in a place: keys, pairs, counts and tables of the pairs that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u, v, k, w, c = _unpack(r["blob"])[:5]
                more = c > 1
                ku, kk = np.unique(k[more], return_inverse=True)
                wu, ww = np.unique(w[more], return_inverse=True)
                t = _first_tables(c[more])
                yield _batch((r["seat"], DRAWN, r["place"], int((c == 1).sum()), int((c == 1).sum() + t.sum()), _pack(u[ku], kk, v[wu], ww, c[more], t)))

    return run


def _gather(grid: Grid):
    """Each shard's keys, and to each place the sums of those of its keys that have pairs to draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, shard), rows in _grouped(batches, "kind", "name"):
            asked = [_unpack(r["blob"]) for r in rows]
            keys, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            customers, once, tables = (_sums(at, np.concatenate([a[i] for a in asked]), len(keys)) for i in (1, 2, 3))
            own = np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1])
            places = np.array([r["place"] for r in rows])
            yield _batch((grid.seats[shard], SHARD_CONTEXT if kind == BY_CONTEXT else SHARD_WORD, 0, shard, int((customers > 0).sum()), _pack(keys, customers, once, places, *own)))
            for r, a, x in zip(rows, asked, own, strict=True):
                x = x[a[4] > 0]
                if len(x):
                    yield _batch((grid.seats[r["place"]], kind, r["place"], shard, 0, _pack(once[x], (once + tables)[x])))

    return run


def _answer(grid: Grid):
    """The sums of what places say of a key, to each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, shard), rows in _grouped(batches, "kind", "name"):
            asked = [_unpack(r["blob"]) for r in rows]
            keys, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            sums = _sums(at, np.concatenate([a[1] for a in asked]), len(keys))
            for r, x in zip(rows, np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1]), strict=True):
                yield _batch((grid.seats[r["place"]], kind, r["place"], shard, 0, _pack(sums[x])))

    return run


def _step(grid: Grid, sweep: int, tables_all: int, vocabulary: int):
    """Draw the tables of a place given the sums of the sweep before, and say what they add to the sums.

    The last sweep says what each sample adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place,), rows in _grouped(batches, "place"):
            state = next(r for r in rows if r["kind"] == DRAWN)
            u, k, v, w, c, t, *rest = _unpack(state["blob"])
            if len(c):
                answers = [grid.answered(rows, kind, keys) for kind, keys in ((BY_CONTEXT, u), (BY_WORD, v))]
                if not sweep:
                    rest = [answers[0][0], answers[1][0]]
                    tables, dish = answers[0][1], answers[1][1]
                else:
                    tables, dish = answers[0][0] + rest[0], answers[1][0] + rest[1]
                t = _sweep(pairs_of(v[w], u[k]), c, t, tables[k], dish[w], tables_all, vocabulary, sweep)
            elif not sweep:
                rest = [t, t]
            if sweep >= BURN_IN:
                rest = [*rest, t]
            yield _batch((state["seat"], DRAWN, place, state["name"], state["name"] + int(t.sum()), _pack(u, k, v, w, c, t, *rest)))
            says = [t] if sweep + 1 < BURN_IN + SAMPLES else rest[2:]
            for kind, keys, x in ((BY_CONTEXT, u, k), (BY_WORD, v, w)):
                yield from grid.asked(kind, place, keys, *[_sums(x, y, len(keys)) for y in says])

    return run


def _totals(grid: Grid):
    """Customers, and tables in each sample, of every key of a shard, to all places that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in _grouped(batches, "name"):
            for kind, fixed in ((BY_CONTEXT, SHARD_CONTEXT), (BY_WORD, SHARD_WORD)):
                for own in (r for r in rows if r["kind"] == fixed):
                    keys, customers, once, places, *lists = _unpack(own["blob"])
                    tables = [once.copy() for _ in range(SAMPLES)]
                    for r in rows:
                        if r["kind"] == kind:
                            some, *sums = _unpack(r["blob"])
                            at = np.searchsorted(keys, some)
                            for x, more in zip(tables, sums, strict=True):
                                x[at] += more
                    for place, x in zip(places.tolist(), lists, strict=True):
                        yield _batch((grid.seats[place], kind, place, shard, 0, _pack(customers[x], *[y[x] for y in tables])))

    return run


def _price(grid: Grid, tables_all: list[int], vocabulary: int):
    """To each buffer the logarithms of the averaged probabilities of the pairs that it dealt, and their words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place,), rows in _grouped(batches, "place"):
            u, v, k, w, c, names, *lists = _unpack(next(r["blob"] for r in rows if r["kind"] == FIXED))
            drawn = _unpack(next(r["blob"] for r in rows if r["kind"] == DRAWN))[8:]
            customers, *tables = grid.answered(rows, BY_CONTEXT, u)
            count, *dishes = grid.answered(rows, BY_WORD, v)
            p = np.zeros(len(c))
            for own, x, y, n in zip(drawn, tables, dishes, tables_all, strict=True):
                t = np.minimum(c, 1)
                t[c > 1] = own
                p += _probability(c, t, customers[k], x[k], y[w], n, vocabulary)
            log_p, count = np.log10(p / SAMPLES).astype(np.float32), count[w]
            for name, x in zip(names.view(np.int64).tolist(), lists, strict=True):
                yield _batch((0, DEALT, place, name, 0, _pack(log_p[x], count[x])))

    return run


def _texts(grid: Grid):
    """Ids and tokens of each buffer, as numbers of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds in _buffers(batches):
            name, _, k, _, _, at = _entries(words, bounds, grid)
            known = np.array([i is not None for i in ids])
            yield _batch((0, TEXTS, 0, name, len(k), _pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), known, _held_out(ids), np.diff(bounds), at)))

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(total: int, vocabulary: int):
    """The sums of each text of a buffer."""
    norm = math.log10(total + 0.5 * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "name"):
            # Buffers of equal pairs have one name, and equal answers.
            answers = {r["place"]: r["blob"] for r in rows if r["kind"] == DEALT}
            parts = [_unpack(answers[p]) for p in sorted(answers)]
            for r in rows:
                if r["kind"] != TEXTS:
                    continue
                if r["n"] != sum(len(x[0]) for x in parts):
                    raise RuntimeError("the texts came in another order the second time: score a table or a checkpoint")
                log_p, count = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                ids, known, held, sizes, at = _unpack(r["blob"])
                cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                log_c = np.log10(count + 0.5)
                score, base, seen = (np.add.reduceat(x[at], cuts) for x in (log_p.astype(np.float64), log_c, (count > 0).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64), mask=known == 0),
                        pa.array(held > 0),
                        pa.array(sizes),
                        pa.array(seen),
                        pa.array(np.full(len(sizes), total)),
                        pa.array(base - sizes * norm),
                        pa.array(score),
                        pa.array(10 ** (-score / sizes)),
                    ],
                    [c.split()[0] for c in _SCORES.split(", ")],
                )

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of each row.

    The fold that is held out is ``crc32(doc_id as text) mod 5 = 1``. ``perplexity`` is that of the text under the
    model, 10 ^ (-score / n_tokens).
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    grid = Grid(docs, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    priced, total, vocabulary = _sampled(docs, grid)
    # What came before is needed no more, nor are its shuffle files and checkpoints.
    release(docs.sparkSession, 4, 0.5)
    return _mapped(priced.union(_mapped(docs, _texts(grid))).repartition(grid.places, "name"), _score(total, vocabulary), _SCORES)


def _sampled(docs: DataFrame, grid: Grid) -> tuple[DataFrame, int, int]:
    """The prices of all buffers, and the numbers of training tokens and of words in them."""
    fixed = checkpointed(_mapped(grid.dealt(_mapped(docs, _deal(grid))), _open(grid)))
    total = fixed.agg(F.sum("n")).first()[0] or 0
    shards = checkpointed(_mapped(grid.dealt(_mapped(fixed, _ask_all(grid))), _gather(grid)))
    vocabulary = shards.where(F.col("kind") == SHARD_WORD).agg(F.sum("n")).first()[0] or 0

    state, answers = _mapped(fixed, _first_seats(grid)), shards.where(F.col("kind").isin(*_SIDES))
    tables_all = state.agg(F.sum("n")).first()[0] or 0
    samples: list[int] = []
    for sweep in range(BURN_IN + SAMPLES):
        now = checkpointed(_mapped(grid.dealt(state.union(answers)), _step(grid, sweep, tables_all, vocabulary)))
        state, says = now.where(F.col("kind") == DRAWN), now.where(F.col("kind").isin(*_SIDES))
        answers = _mapped(grid.dealt(says), _answer(grid))
        tables_all = state.agg(F.sum("n")).first()[0] or 0
        if sweep >= BURN_IN:
            samples.append(tables_all)

    del now, answers
    release(docs.sparkSession, 4, 0.3)
    totals = _mapped(grid.dealt(shards.where(F.col("kind").isin(SHARD_CONTEXT, SHARD_WORD)).union(says)), _totals(grid))
    priced = checkpointed(_mapped(grid.dealt(fixed.union(state).union(totals)), _price(grid, samples, vocabulary)))
    return priced, total, vocabulary
