"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost first).
The best pair is merged, its neighbours give new pairs, and pairs of which a side has changed since
are skipped when they come up. What no merge covers falls back to byte pieces or the unknown id.

A text is cut where no piece of the vocabulary can reach across (before a word-start mark, around
characters that are in no longer piece); such units are independent, so each distinct unit is run
through the agenda once and kept in a bounded memory. Units new to an Arrow batch are encoded
together, and all of them are compared with the sentencepiece library before ids are used (``check_every``
makes it a share of them); a difference raises.

Defined cases: a null text is an empty text; an empty text gives the begin and end ids alone and
decodes to the empty text; rows are kept one to one, so repeated rows and extra columns (also ones
named as the outputs, which replace them) are harmless; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.kernel import slices, strings

MARK = "▁"
#: Distinct units that are kept; beyond it the memory starts anew.
UNITS_KEPT = 200_000
#: Units of up to so many characters are merged many at once, so many at a time.
_ROW, _ROWS = 40, 4096
_NEVER = np.int32(2**31 - 1)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("millrace-each-byte", _each_byte)


class Mismatch(AssertionError):
    """The agenda and the library differ on a unit."""


class PieceCodec:
    """Encoder and decoder of one merge-type vocabulary file."""

    def __init__(self, model_file: str, check_every: int = 1):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        with open(model_file, "rb") as f:
            proto = schema.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("a vocabulary of merge type is needed")
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("white space must be marked at the start of words")
        kinds = schema.ModelProto.SentencePiece
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        #: Only for vocabularies that rewrite characters; else the text goes in as it is.
        self.normalizes = bool(spec.precompiled_charsmap) or self.squeeze
        self.cost, self.ids, self.reserved, self.bytes = {}, {}, [], {}
        self.shown: list[str] = []
        for i, p in enumerate(proto.pieces):
            shown = p.piece
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED):
                self.ids[p.piece] = i
                self.cost[p.piece] = -p.score
                if p.type == kinds.USER_DEFINED:
                    self.reserved.append(p.piece)
                elif p.type == kinds.UNUSED:
                    raise ValueError("vocabularies with unused pieces are not handled")
                shown = shown.replace(MARK, " ")
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                shown = chr(value) if value < 0x80 else chr(0xDC00 + value)
            elif p.type == kinds.CONTROL:
                shown = ""
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                shown = proto.trainer_spec.unk_surface or " ⁇ "
            self.shown.append(shown)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self._marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self._high = {i for b, i in self.bytes.items() if b >= 0x80}
        self._silent = {i for i, shown in enumerate(self.shown) if not shown}
        #: No piece holds a mark behind another character: a word start is always a cut.
        self.cuts_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        reach = {c for p in self.ids if len(p) > 1 for c in p}
        self.lone = "".join(c for c in "\n\t\r" if c not in reach)
        self._lone = re.compile(f"([{re.escape(self.lone)}])") if self.lone else None
        self._user = re.compile("|".join(re.escape(p) for p in sorted(self.reserved, key=len, reverse=True))) if self.reserved else None
        self._runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Packed ids by unit; keys of words leave the mark at their start out.
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self._tables()
        self._plain = None
        self.check_every = check_every
        if check_every:
            spec.add_dummy_prefix, spec.remove_extra_whitespaces = False, False
            self._plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    # ---------------------------------------------------------------- agenda

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit (marks in place of spaces) by the score-ordered agenda."""
        symbols, frozen = list(unit), set()
        if self._user is not None:
            symbols, at = [], 0
            for m in self._user.finditer(unit):
                symbols += unit[at : m.start()]
                frozen.add(len(symbols))
                symbols.append(m[0])
                at = m.end()
            symbols += unit[at:]
        n, cost = len(symbols), self.cost.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            c = cost(pair)
            if c is not None and not (frozen and (i in frozen or i + 1 in frozen)):
                agenda.append((c, i, i + 1, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, pair = pop(agenda)
            if right[i] != j or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                wider = pair + symbols[k]
                c = cost(wider)
                if c is not None and k not in frozen:
                    push(agenda, (c, i, k, wider))
            k = left[i]
            if k >= 0:
                wider = symbols[k] + pair
                c = cost(wider)
                if c is not None and k not in frozen:
                    push(agenda, (c, k, i, wider))
        ids: list[int] = []
        for s in symbols:
            if s:
                found = self.ids.get(s)
                if found is not None:
                    ids.append(found)
                elif self.bytes:
                    ids += [self.bytes[b] for b in s.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def _tables(self) -> None:
        """Arrays for the agenda over many units: character ids, and merges sorted by pair of ids."""
        self._char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self._char[ord(p)] = i
        pairs = {}
        order = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[self.cost[p]], i)
        keys = np.array(sorted(pairs) or [-1], np.int64)
        self._pairs = keys
        self._rank = np.array([pairs[k][0] for k in keys.tolist()] if pairs else [_NEVER], np.int32)
        self._into = np.array([pairs[k][1] for k in keys.tolist()] if pairs else [0], np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (best first) and merged id of pairs of ids; negative ids are in no pair."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self._pairs, key)
        at[at == len(self._pairs)] = 0
        hit = (self._pairs[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self._rank[at], _NEVER), self._into[at]

    def merge_many(self, units: list[str]) -> list[bytes]:
        """``merge`` of many units: one agenda a row, and in each round every row's best pair is merged."""
        out: list[bytes] = [b""] * len(units)
        short: list[int] = []
        for i, u in enumerate(units):
            if 1 <= len(u) <= _ROW and self._user is None:
                short.append(i)
            else:
                out[i] = array("I", self.merge(u)).tobytes()
        short.sort(key=lambda i: len(units[i]))
        for first in range(0, len(short), _ROWS):
            rows = short[first : first + _ROWS]
            lengths = np.array([len(units[i]) for i in rows])
            width = int(lengths[-1])
            codes = np.frombuffer("".join(units[i] for i in rows).encode("utf-32-le"), np.uint32)
            symbols = np.full((len(rows), width + 1), -1, np.int32)
            symbols[:, :width][np.arange(width) < lengths[:, None]] = self._char[codes]
            lost = (symbols[:, :width] < 0) & (np.arange(width) < lengths[:, None])
            lost = lost.any(axis=1)
            # Row-wise linked lists in flat arrays; column ``width`` ends every row and is in no pair.
            step = width + 1
            ranks, into = self._ranks(symbols[:, :-1], symbols[:, 1:])
            ranks = np.concatenate([ranks, np.full((len(rows), 1), _NEVER, np.int32)], axis=1)
            into = np.concatenate([into, np.zeros((len(rows), 1), np.int32)], axis=1).ravel()
            symbol = symbols.ravel()
            right = np.arange(1, len(symbol) + 1)
            left = np.arange(-1, len(symbol) - 1)
            flat = ranks.ravel()
            row = np.flatnonzero(~lost)
            while len(row):
                i = ranks[row].argmin(axis=1) + row * step
                more = flat[i] != _NEVER
                if not more.all():
                    row, i = row[more], i[more]
                j = right[i]
                k = right[j]
                merged = into[i]
                symbol[i], symbol[j] = merged, -1
                flat[j] = _NEVER
                right[i] = k
                left[k] = i
                flat[i], into[i] = self._ranks(merged, symbol[k])
                inner = i != row * step
                b, m = left[i[inner]], merged[inner]
                flat[b], into[b] = self._ranks(symbol[b], m)
            kept = symbols >= 0
            ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
            packed, start = symbols[kept].astype("<u4").tobytes(), 0
            for n, i in enumerate(rows):
                out[i] = packed[start : ends[n]]
                start = ends[n]
            for n in np.flatnonzero(lost).tolist():
                out[rows[n]] = array("I", self.merge(units[rows[n]])).tobytes()
        return out

    # ----------------------------------------------------------------- units

    def units(self, text: str) -> list[str]:
        """The independent units of a text, in order."""
        if not text:
            return []
        if self.normalizes or not self.cuts_words or (self._user is not None and self._user.search(text)):
            if self.normalizes:
                text = self.library.normalize(text)
            else:
                text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
            return [text] if text else []
        return self._runs.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def learn(self, units: list[str]) -> list[bytes]:
        """Packed ids of distinct units, by the agenda, held against the library."""
        lone = self._lone.search if self._lone is not None and self._user is None else lambda _: None
        joined = [u for u in units if lone(u)]
        cuts = [[p for p in self._lone.split(u) if p] for u in joined]
        apart = {p for cut in cuts for p in cut}
        fresh = [u for u in units if not lone(u)] if joined else units
        whole = len(fresh)
        fresh = fresh + [p for p in apart if p not in self.parts]
        packed = self.merge_many(fresh)
        if self._plain is not None:
            every = self.check_every
            held = range(len(fresh)) if every == 1 else [k for k in range(len(fresh)) if zlib.crc32(fresh[k].encode()) % every == 0]
            for first in range(0, len(held), _ROWS):
                some = held[first : first + _ROWS]
                for k, theirs in zip(some, self._plain.encode([fresh[k] for k in some], num_threads=1), strict=True):
                    if array("I", theirs).tobytes() != packed[k]:
                        raise Mismatch(f"{fresh[k]!r}: {array('I', packed[k]).tolist()} here, {theirs} in the library")
        if not joined:
            return packed
        self.parts.update(zip(fresh[whole:], packed[whole:], strict=True))
        known = dict(zip(fresh, packed, strict=True))
        get = self.parts.__getitem__
        known.update((u, b"".join(map(get, cut))) for u, cut in zip(joined, cuts, strict=True))
        return [known[u] for u in units]

    def encode_batch(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        head = array("I", [self.begin]).tobytes() if begin else b""
        tail = array("I", [self.end]).tobytes() if end else b""
        simple = self.cuts_words and self.dummy_prefix and not self.normalizes and self._user is None
        for memory in (self.words, self.parts):
            if len(memory) > UNITS_KEPT:
                memory.clear()
        plain, cut = [], []
        for text in texts:
            words = text.split(" ") if simple and text and MARK not in text else [""]
            plain.append("" not in words)
            cut.append(words if plain[-1] else self.units(text))
        new = [w for w in set().union(*(c for c, p in zip(cut, plain, strict=True) if p)) if w not in self.words]
        self.words.update(zip(new, self.learn([MARK + w for w in new]), strict=True))
        new = [w for w in set().union(*(c for c, p in zip(cut, plain, strict=True) if not p)) if w not in self.parts]
        self.parts.update(zip(new, self.learn(new), strict=True))
        word, part = self.words.__getitem__, self.parts.__getitem__
        return [head + b"".join(map(word if p else part, c)) + tail for c, p in zip(cut, plain, strict=True)]

    def encode(self, text: str, begin: bool = False, end: bool = False) -> list[int]:
        return list(array("I", self.encode_batch([text], begin, end)[0]))

    # ---------------------------------------------------------------- decode

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters."""
        ids = list(ids)
        shown = self.shown
        text = "".join(map(shown.__getitem__, ids))
        if not self._high.isdisjoint(ids):
            # Bytes on the two sides of a control piece are no character.
            apart = not self._silent.isdisjoint(ids[1:-1])
            runs = ("".join(map(shown.__getitem__, run)) for silent, run in itertools.groupby(ids, self._silent.__contains__) if not silent) if apart else [text]
            text = "".join(run.encode("utf-8", "surrogateescape").decode("utf-8", "millrace-each-byte") for run in runs)
        if self.dummy_prefix or self.squeeze:
            for i in ids:
                if shown[i]:
                    if i in self._marked:
                        text = text.lstrip(" ") if self.squeeze else text[1:]
                    break
        return text


_codecs: dict[tuple[str, int], PieceCodec] = {}


def codec(model_file: str, check_every: int = 1) -> PieceCodec:
    """One codec per Python worker and file."""
    key = (model_file, check_every)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model_file, check_every)
    return _codecs[key]


def with_columns(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` with the added fields at its end, replacing any of the same name."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in df.schema if f.name.lower() not in names] + added)


def encode_documents(df: DataFrame, model_file: str, text: str = "text", begin: bool = True, end: bool = True, check_every: int = 1, keep_text: bool = True) -> DataFrame:
    """``df`` with ``piece_ids`` (array of int) and ``piece_text`` (the ids decoded again).

    In every batch, the newly encoded units are compared with the library (or one in ``check_every`` of them, by
    crc32; 0: none). Narrow: no shuffle, no state between
    rows beyond the bounded memory of each worker. ``keep_text=False`` leaves the text column out.
    """
    schema = with_columns(df, [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("piece_text", T.StringType())])
    if not keep_text:
        schema = T.StructType([f for f in schema if f.name != text])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, check_every)
        for batch in batches:
            for part in slices(batch, text):
                packed = c.encode_batch(strings(part.column(part.schema.get_field_index(text))).to_pylist(), begin, end)
                lengths = [0]
                for p in packed:
                    lengths.append(lengths[-1] + len(p) // 4)
                ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.Array.from_buffers(pa.int32(), lengths[-1], [None, pa.py_buffer(b"".join(packed))]))
                texts = pa.array([c.decode(array("I", p)) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept] + [ids, texts], kept + ["piece_ids", "piece_text"])

    return df.mapInArrow(run, schema)


def digest_documents(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, of each encoded document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column(1)
            bounds = np.asarray(ids.offsets)
            flat = np.asarray(ids.values).astype("<u4", copy=False)
            packed = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column(2).to_pylist()], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select(doc_id, "piece_ids", "piece_text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
