"""MinHash near-dedup with odd sketches.

A document is the set of its distinct word shingles (64-bit hashes). Equal sets form a class, and only one
set per class goes on. A MinHash signature of 256 values gives 32 band keys of 4 values each, and is folded
into an odd sketch: a 1,024-bit parity bitmap. The XOR of two sketches has as many set bits as the samples
differ, which estimates high similarities closely, so it turns most wrong band matches away before any
full set is read. The whole set is folded in the same way, into 2,048 bits: there the XOR has at most as many
set bits as the sets differ in members, so a pair that it turns away is certain to be below the threshold,
and for sets of up to some 2,500 members little else than true links gets past it. Every link is confirmed
on the full sets.

At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8^4)^32 < 1e-7. The sketch of the
samples turns a pair away only if its estimate is 0.18 below the threshold, six standard deviations (0.03).

Buckets are never expanded into all pairs:

1. Bands take turns. In each bucket, members outside its largest component are held against one member of
   that component; confirmed links are joined to components before the next bands come up. So a member of a
   large group is compared a few times, whatever the size of the group.
2. Where a bucket then still has members of several components, those outside its largest one are held
   against the members of other components, in salted blocks; sizes and sketches are compared inside the
   join, and a pair comes out of its first common bucket only.

A link that is seen by neither step is one inside a component, where it can change nothing. Components are
found by alternating large and small stars, with a checkpoint each round; nothing of it is collected.

Defined cases: null and empty texts have empty sets and are linked with nothing; a text with fewer words
than a shingle is one shingle; rows with equal ids are nodes of their own by their sets; null ids never are
a component's id unless nothing else is in it; an empty table gives an empty table; columns named as the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.kernel import mix64, slices, word_hashes
from millrace.llm.work import checkpointed

SAMPLES, BANDS, ROWS, SKETCH = 256, 32, 4, 1024
#: Bits into which a whole set is folded.
PARITY = 2048
#: Bands that are used together: few pairs join most of a group before the others are looked at.
TURNS = ((0, 2), (2, 8), (8, 32))
#: Bits of the bitmap that thins documents out before their sets are made anew (2 MB).
THIN_BITS = 24
#: Estimates may be so much below the threshold.
MARGIN = 0.18
#: Members of a bucket that meet in one block of the second step.
BLOCK = 1000
MAX_ROUNDS = 60

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_SKETCH_LONGS, _PARITY_LONGS = SKETCH // 64, PARITY // 64


# ------------------------------------------------------------------ shingle sets


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    hashes, bounds = word_hashes(column)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        rolled = mix64(rolled + hashes[i : i + len(rolled)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix64(np.array([whole ^ h]))[0] + np.uint64(1)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set (two int64 columns): sums of two mixes of the members."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            m = mix64(s)
            out[i, 0] = m.sum(dtype=np.uint64) + np.uint64(len(s))
            out[i, 1] = mix64(m ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return mix64(out).view(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    short = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 512):
        values = short[a : a + 512, None] ^ _FLIP
        values *= _TIMES
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of the bands (int64), different in each band."""
    wide = signatures[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(_BAND, wide.shape[:2]).copy()
    for r in range(wide.shape[2]):
        key = mix64(key + wide[:, :, r])
    return key.view(np.int64)


def _parity_words(bits: list[np.ndarray], width: int) -> np.ndarray:
    """Parity bitmaps of ``width`` bits as int64 words, a row for each array of bit numbers; some rows at a time."""
    out = np.zeros((len(bits), width // 64), np.int64)
    for first in range(0, len(bits), 256):
        some = bits[first : first + 256]
        own = np.repeat(np.arange(len(some)) * width, [len(x) for x in some])
        parity = np.bincount(np.concatenate([np.zeros(0, np.int64), *some]) + own, minlength=len(some) * width) & 1
        out[first : first + 256] = np.packbits(parity.astype(np.uint8).reshape(len(some), width), axis=1, bitorder="little").view(np.int64)
    return out


def odd_sketches(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as int64 words."""
    return _parity_words([(mix64(s.astype(np.uint64) + _PLACE) % np.uint64(SKETCH)).astype(np.int64) for s in signatures], SKETCH)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of the whole sets, as int64 words."""
    return _parity_words([(s >> np.uint64(20)).astype(np.int64) % PARITY for s in sets], PARITY)


def most_bits(similarity: float) -> int:
    """XOR bits of two sketches whose estimate is ``similarity``."""
    return int(SKETCH / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / SKETCH)))


def _thin(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of a class's chosen document in the thinning bitmap."""
    return (mix64(keys.view(np.uint64) ^ mix64(ids.view(np.uint64))) >> np.uint64(64 - THIN_BITS)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes and rows."""
    for batch in batches:
        for part in slices(batch, "text"):
            for first in range(0, part.num_rows, 2000):
                yield part.slice(first, 2000)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(0))


def sketch_documents(docs: DataFrame, doc_id: str, text: str, k: int, keyed: bool = False) -> DataFrame:
    """``doc_id, n, k1, k2, thin, bands, odd, parity`` of each row, ``keyed`` with its ``r1, r2``; no text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = shingle_sets(part.column(1), k)
            signed = np.array([signature(s) for s in sets], np.uint32).reshape(len(sets), SAMPLES)
            keys = set_keys(sets)
            bands, odd = band_keys(signed), odd_sketches(signed)
            step = lambda n: pa.array(np.arange(0, n * len(sets) + 1, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array(_thin(keys[:, 0].copy(), _ids(part.column(0)))),
                    pa.ListArray.from_arrays(step(BANDS), pa.array(bands.ravel())),
                    pa.ListArray.from_arrays(step(_SKETCH_LONGS), pa.array(odd.ravel())),
                    pa.ListArray.from_arrays(step(_PARITY_LONGS), pa.array(parities(sets).ravel())),
                    *part.columns[2:],
                ],
                ["doc_id", "n", "k1", "k2", "thin", "bands", "odd", "parity", *part.schema.names[2:]],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(_row_key(doc_id, text) if keyed else []))
    return chosen.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, thin long, bands array<long>, odd array<long>, parity array<long>" + ", r1 long, r2 long" * keyed)


def _row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that name an id with its text."""
    i = F.col(doc_id).cast("long")
    return [F.xxhash64(i, F.col(text)).alias("r1"), F.xxhash64(F.lit(1), F.col(text), i).alias("r2")]


def _full_sets(docs: DataFrame, doc_id: str, text: str, k: int, nodes: DataFrame) -> DataFrame:
    """``node, n, shingles`` (packed sorted hashes) of the given classes, each from one document.

    A bitmap of fixed size says which documents may be a chosen one; only their sets are made and moved.
    """
    spark = docs.sparkSession
    words = nodes.groupBy(F.shiftright("thin", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(thin, 64) AS int)))").alias("bits"))
    bitmap = np.zeros(1 << (THIN_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        bitmap[r.word] = r.bits
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value.view(np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), k)
                keys = set_keys(sets)
                thin = _thin(keys[:, 0].copy(), _ids(part.column(0)))
                hit = np.flatnonzero(chosen[thin >> 6] >> (thin & 63).astype(np.uint64) & np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[hit, 0]), pa.array(keys[hit, 1]), pa.array([sets[i].tobytes() for i in hit.tolist()], pa.binary())],
                    ["k1", "k2", "shingles"],
                )

    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "k1 long, k2 long, shingles binary")
    return made.join(nodes.select("node", "n", "k1", "k2"), ["k1", "k2"]).select("node", "n", "shingles").dropDuplicates(["node"])


# --------------------------------------------------------------------- candidates


def _alike(a: str, b: str, share: tuple[int, int]) -> Column:
    """What sizes and sketches allow."""
    least, most = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")

    def bits(name: str, longs: int) -> Column:
        return sum((F.bit_count(F.get(f"{a}{name}", i).bitwiseXOR(F.get(f"{b}{name}", i))) for i in range(longs)), F.lit(0))

    # With m members in one set only, the similarity is (an + bn - m) / (an + bn + m).
    apart = F.lit(share[0] + share[1]) * bits("parity", _PARITY_LONGS) <= F.lit(share[1] - share[0]) * (least + most)
    return (F.lit(share[1]) * least >= F.lit(share[0]) * most) & apart & (bits("odd", _SKETCH_LONGS) <= most_bits(share[0] / share[1] - MARGIN))


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{name}{'' if c == 'node' else c}") for c in nodes.columns])


def _confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                keep.append(share[1] * both >= share[0] * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    full = sets.select("node", "shingles")
    both = pairs.join(_side(full, "a"), "a").join(_side(full, "b"), "b")
    return both.select("a", "b", "ashingles", "bshingles").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, label`` (least node of its component) of every node with an edge ``a, b``.

    With ``rounds``, it ends after so many: equal labels then still mean one component, but a component may
    have several.

    Alternating stars: each node is tied to the least of its neighbourhood until nothing changes. Joins are
    one to many, so a node with very many neighbours is split by adaptive execution.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    for n in range(MAX_ROUNDS):
        if n == rounds:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        mark = None if rounds else now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen and not rounds:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(small.select("e.*").where("u > v").distinct())
    raise RuntimeError("components did not settle")


def similarity_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100), keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their class keys; the classes (``node``); links between classes that join all components."""
    rows = checkpointed(sketch_documents(docs, doc_id, text, words, keyed))
    classes = (
        rows.where("n > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("thin", "doc_id"), F.first("thin")).alias("thin"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("parity").alias("parity"))
    )
    nodes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    keyed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(keyed.join(buckets, "bucket"))
    brief = nodes.select("node", "n", "odd", "parity")
    sets = checkpointed(_full_sets(docs, doc_id, text, words, nodes.join(members.select("node").distinct(), "node")))

    links: DataFrame | None = None
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    for first, past in TURNS:
        placed, mixed = _mixed(members.where(F.col("band").between(first, past - 1)), labels)
        stars = placed.join(mixed, "bucket").where("label <> major").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        stars = stars.join(_side(brief, "a"), "a").join(_side(brief, "b"), "b").where(_alike("a", "b", share)).select("a", "b")
        found = checkpointed(_confirm(stars, sets, share))
        links = found if links is None else links.union(found)
        # Labels that aren't final only mean more comparisons.
        labels = components(links, rounds=2)

    placed, mixed = _mixed(members, labels)
    wide = placed.join(mixed, "bucket").join(nodes.select("node", "n", "odd", "parity", "bands"), "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = ("node", "label", "n", "odd", "parity", "bands")
    left = wide.where("label <> major").select("bucket", "band", "major", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"a{c}") for c in own])
    right = wide.select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"b{c}") for c in own])
    earlier = F.exists(F.sequence(F.lit(0), F.col("band")), lambda i: (i < F.col("band")) & (F.get("abands", i) == F.get("bbands", i)))
    # Of two members outside the largest component, the lesser one comes first.
    rest = left.join(right, ["bucket", "block"]).where(
        (F.col("alabel") != F.col("blabel")) & ((F.col("blabel") == F.col("major")) | (F.col("anode") < F.col("bnode"))) & _alike("a", "b", share) & ~earlier
    )
    more = checkpointed(_confirm(rest.select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct(), sets, share))
    return rows, nodes, links.union(more)


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels; of each bucket with several labels the largest one and a member of it."""
    placed = members.join(labels, "node", "left").select("bucket", "band", "node", "size", F.coalesce("label", "node").alias("label"))
    held = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min("node").alias("pivot"))
    largest = F.max(F.struct("n", "label", "pivot"))
    mixed = held.groupBy("bucket").agg(largest["label"].alias("major"), largest["pivot"].alias("pivot"), F.count("*").alias("labels")).where("labels > 1")
    return placed, mixed.select("bucket", "major", "pivot")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; the least id of a component is kept."""
    rows, nodes, links = similarity_links(docs, doc_id, text, words, share)
    labels = components(links)
    named = nodes.select("node", "k1", "k2", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "label").select("k1", "k2", "component_id")
    return rows.where("n > 0").select("doc_id", "n", "k1", "k2").join(by_class, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept")
    ).union(rows.where("n = 0").select("doc_id", "n", "doc_id", F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of ``docs`` for each component: the one with the least id.

    Null ids come last, and equal ids go by a hash of id and text; of rows equal in both any one stays. Rows
    without words are in no component and all stay.
    """
    rows, nodes, links = similarity_links(docs, doc_id, text, words, share, keyed=True)
    named = nodes.select("node", "k1", "k2").join(components(links), "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"))
    rows = rows.where("n > 0").select("doc_id", "k1", "k2", "r1", "r2")
    # The first row of each class, then of each component.
    by_class = rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2")).alias("first")).join(named, ["k1", "k2"])
    best = by_class.groupBy("label").agg(F.min("first").alias("best"))
    of_class = by_class.join(best, "label").select("k1", "k2", F.col("best.r1").alias("b1"), F.col("best.r2").alias("b2"))
    keys = rows.join(of_class, ["k1", "k2"]).groupBy("r1", "r2").agg(F.first((F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2"))).alias("stays"), F.count("*").alias("times"))
    special = checkpointed(keys.where("not stays or times > 1").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("stays").alias("__stays")))
    # The row is one column, so that no column of it can clash with the keys.
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), *[k.alias(f"__{n}") for n, k in zip(("r1", "r2"), _row_key(doc_id, text), strict=True)])
    once = keyed.join(special, ["__r1", "__r2"], "left_anti").select("__row.*")
    repeated = keyed.join(special.where("__stays"), ["__r1", "__r2"], "left_semi").dropDuplicates(["__r1", "__r2"]).select("__row.*")
    return once.union(repeated)
