"""Token ids packed into rows of equal length by best-fit decreasing.

Every document becomes its ids and an end id. Documents longer than a row are cut into pieces of a row's
length and a rest, without losing an id. Pieces are placed in order of falling length, each into the row
with the least room that still takes it; a segment tree over the room of open rows finds that room in
steps of the logarithm of the row length. A packed row has its ids (padded), the cumulative lengths of its
segments, positions that start anew with each segment, and which piece of which document each segment is.

Packing is done within blocks of ``block_tokens`` ids of a partition: enough pieces for rows to be nearly
full, and a bound on memory. Nothing is shuffled; a document that is very long is cut as it comes.

Defined cases: null and empty texts are their end id alone; null ids are kept as null; repeated rows are
packed one by one; equal lengths keep their order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.kernel import slices, strings

ROW_TOKENS, BLOCK_TOKENS = 2048, 4 << 20


class RoomTree:
    """Counts of open rows by their room; finds the least room of at least some size."""

    def __init__(self, largest: int):
        self.size = 1 << max(1, largest.bit_length())
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, room: int) -> int:
        """The least room of an open row that is ``room`` or more; -1 if there is none."""
        count, i = self.count, room + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; each length is 1 to ``capacity``."""
    tree, open_rows, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        room = tree.least(need)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        if room > need:
            open_rows[room - need].append(row)
            tree.add(room - need, 1)
    return rows


def split_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """First and past of the pieces of a document of ``n`` ids."""
    return [(a, min(a + capacity, n)) for a in range(0, n, capacity)]


_encoders: dict[str, object] = {}


def _encoder(rank_file: str, pattern: str) -> object:
    if rank_file not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[rank_file] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[rank_file]


PACKED = "pack_id long, ids array<int>, n_tokens int, cu_seqlens array<int>, positions array<int>, doc_ids array<long>, pieces array<int>"


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def pack_documents(docs: DataFrame, rank_file: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text", row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad_id: int = 0) -> DataFrame:
    """Packed rows (``PACKED``) of all documents.

    ``cu_seqlens`` starts with 0 and ends with the row's own ids (without padding); padding has position 0.
    """

    def pack(block: list[tuple[int | None, int, np.ndarray]], first: int) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(p) for _, _, p in block], row_tokens)
        ids = np.full((len(rows), row_tokens), pad_id, np.int32)
        positions = np.zeros((len(rows), row_tokens), np.int32)
        ends, owners, parts, used = [], [], [], []
        for n, row in enumerate(rows):
            at, cu = 0, [0]
            for piece in row:
                own = block[piece][2]
                ids[n, at : at + len(own)] = own
                positions[n, at : at + len(own)] = np.arange(len(own))
                at += len(own)
                cu.append(at)
            ends.append(np.array(cu, np.int32))
            owners.append([block[p][0] for p in row])
            parts.append(np.array([block[p][1] for p in row], np.int32))
            used.append(at)
        whole = pa.array(np.arange(0, len(rows) * row_tokens + 1, row_tokens, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first + np.arange(len(rows))),
                pa.ListArray.from_arrays(whole, pa.array(ids.ravel())),
                pa.array(used, pa.int32()),
                _lists(ends, pa.int32()),
                pa.ListArray.from_arrays(whole, pa.array(positions.ravel())),
                pa.array(owners, pa.list_(pa.int64())),
                _lists(parts, pa.int32()),
            ],
            ["pack_id", "ids", "n_tokens", "cu_seqlens", "positions", "doc_ids", "pieces"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(rank_file, pattern)
        number = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for owner, t in zip(part.column(0).to_pylist(), strings(part.column(1)).to_pylist(), strict=True):
                    ids = np.append(encoder.encode_to_numpy(t), end_id).astype(np.int32)
                    for n, (a, b) in enumerate(split_lengths(len(ids), row_tokens)):
                        block.append((owner, n, ids[a:b]))
                    held += len(ids)
                    if held >= block_tokens:
                        packed = pack(block, number)
                        number += packed.num_rows
                        block, held = [], 0
                        for a in range(0, packed.num_rows, 256):
                            yield packed.slice(a, 256)
        if block:
            packed = pack(block, number)
            for a in range(0, packed.num_rows, 256):
                yield packed.slice(a, 256)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)


def to_binary(packed: DataFrame) -> DataFrame:
    """Ids and positions as little-endian 32-bit bytes; the rows of a file are the rows of its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name in ("ids", "positions"):
                    bounds, flat = np.asarray(column.offsets).tolist(), np.asarray(column.values).astype("<i4", copy=False)
                    column = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return packed.mapInArrow(run, PACKED.replace("ids array<int>", "ids binary", 1).replace("positions array<int>", "positions binary"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with binary matrices, beside the lengths and owners of their segments."""
    to_binary(packed).write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """``doc_id, piece, ids`` of every segment: the way back."""
    each = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces")).alias("n", "s"))
    start, past = F.get("cu_seqlens", F.col("n")), F.get("cu_seqlens", F.col("n") + 1)
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.slice("ids", start + 1, past - start).alias("ids"))


def pack_digest(packed: DataFrame) -> DataFrame:
    """Each packed row with digests in place of its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in ("ids", "positions"):
                column = batch.column(batch.schema.get_field_index(name))
                bounds, flat = np.asarray(column.offsets).tolist(), np.asarray(column.values).astype("<i4", copy=False)
                digests.append(pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
            own = [batch.column(batch.schema.get_field_index(n)) for n in ("pack_id", "n_tokens", "cu_seqlens", "doc_ids", "pieces")]
            yield pa.RecordBatch.from_arrays([*own, *digests], ["pack_id", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "ids_sha256", "positions_sha256"])

    return packed.mapInArrow(run, "pack_id long, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, ids_sha256 string, positions_sha256 string")
