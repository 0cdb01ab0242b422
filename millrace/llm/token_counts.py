"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair of its tokens is
the encoding of that pair's bytes. So the last token of the encoding of a prefix is the one token
that ends there and follows the last token of what it leaves over, and

    count[i] = count[i - len(last[i])] + 1

gives the count at every prefix of a split piece in one pass. Truncation to a budget, "how many tokens
do the first n characters have" and "does it fit" are lookups in that table; nothing is encoded again.

The pre-tokenizer looks one character ahead at the end of white space and matches contractions as a
whole, so a prefix of a text isn't always split as the text is; ``prefix_counts`` handles both. Strings
of special added tokens inside a text are one token each, as is the default of the library.

Defined cases: null texts are empty and count 0; rows are kept one to one; empty tables stay empty;
columns named as the outputs are replaced.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.kernel import slices, strings, text_bytes
from millrace.llm.pieces import with_columns

#: Distinct units, split pieces and token pairs that are kept.
UNITS_KEPT, PAIRS_KEPT = 400_000, 1_000_000

# Characters of the Unicode property White_Space, and the split pattern of byte-level BPE.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", _WHITE)
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")

#: Marks a unit whose split depends on its neighbours.
_APART = -(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one vocabulary file."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = _byte_letters()
        tokens = [bytes(letters[c] for c in t) for t in model["vocab"]]
        self.vocabulary = frozenset(tokens)
        self.longest = max(map(len, tokens))
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = n
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._split = regex.compile(_SPLIT)
        self._white = frozenset(_WHITE)
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._tokens: dict[bytes, bool] = {}
        self._pieces: dict[str, int] = {}
        self._units: dict[str, int] = {}

    # ------------------------------------------------------------- one piece

    def _merged(self, data: bytes) -> list[bytes]:
        """The BPE encoding of a few bytes, by its definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _alone(self, token: bytes) -> bool:
        known = self._tokens.get(token)
        if known is None:
            known = self._tokens[token] = self._merged(token) == [token]
        return known

    def _follows(self, a: bytes, b: bytes) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            known = self._pairs[a, b] = self._merged(a + b) == [a, b]
        return known

    def piece_counts(self, data: bytes) -> list[int]:
        """Counts at all byte prefixes of one split piece, the empty one first."""
        n, vocabulary, longest, pairs = len(data), self.vocabulary, self.longest, self._pairs
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                token = data[j:i]
                if token in vocabulary:
                    if j:
                        ok = pairs.get((last[j], token))
                        if ok is None:
                            ok = self._follows(last[j], token)
                    else:
                        ok = self._alone(token)
                    if ok:
                        counts[i], last[i] = counts[j] + 1, token
                        break
            else:
                raise ValueError(f"no token ends at byte {i} of {data!r}")
        return counts

    def _piece(self, piece: str) -> int:
        n = self._pieces.get(piece)
        if n is None:
            if len(self._pieces) >= UNITS_KEPT:
                self._pieces.clear()
            n = self._pieces[piece] = self.piece_counts(piece.encode())[-1]
        return n

    # ----------------------------------------------------------- whole texts

    def count(self, text: str) -> int:
        """Tokens of a text: the last entry of its prefix table, without keeping the table.

        Spaces between two other characters always start a new piece, so what lies between such
        spaces is counted once for each distinct unit.
        """
        if not text:
            return 0
        if self._special is not None and any(s in text for s in self.special):
            return sum(self.count(part) for part in self._special.split(text)) + len(self._special.findall(text))
        head, *rest = text.split(" ")
        units, total = self._units, self._unit(head, False)
        for unit in rest:
            n = units.get(unit)
            total += self._unit(unit, True) if n is None else n
        return total if total >= 0 else sum(map(self._piece, self._split.findall(text)))

    def _unit(self, unit: str, spaced: bool) -> int:
        if not unit or unit[0] in self._white or unit[-1] in self._white:
            n = _APART
        else:
            n = sum(map(self._piece, self._split.findall(" " + unit if spaced else unit)))
        if spaced:
            if len(self._units) >= UNITS_KEPT:
                self._units.clear()
            self._units[unit] = n
        return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to its length (int32)."""
        out = [np.zeros(1, np.int32)]
        base, at = 0, 0
        found = list(self._special.finditer(text)) if self._special is not None else []
        for m in [*found, None]:
            part = text[at : m.start() if m else len(text)]
            # Up to its last character a special string is ordinary text after what stands before it.
            table = self._ordinary(part + m[0] if m else part)
            if m:
                table[-1] = table[len(part)] + 1
                at = m.end()
            out.append((table[1:] + base).astype(np.int32))
            base += int(table[-1])
        return np.concatenate(out)

    def _ordinary(self, text: str) -> np.ndarray:
        table = np.zeros(len(text) + 1, np.int64)
        total = 0
        for m in self._split.finditer(text):
            piece, a, b = m[0], m.start(), m.end()
            data = piece.encode()
            counts = np.asarray(self.piece_counts(data))
            if len(data) != len(piece):
                ends = np.cumsum([len(c.encode()) for c in piece])
                counts = counts[np.concatenate([[0], ends])]
            table[a + 1 : b + 1] = total + counts[1:]
            if piece in _LONG_CONTRACTIONS:
                table[a + 2] = total + self._piece(piece[0]) + self._piece(piece[1])
            total += int(counts[-1])
        # A prefix that ends in white space has that whole run as its last piece.
        for m in regex.finditer(f"[{_WHITE}]+", text):
            counts = self.piece_counts(m[0].encode())
            ends = np.cumsum([len(c.encode()) for c in m[0]])
            table[m.start() + 1 : m.end() + 1] = table[m.start()] + np.asarray(counts)[ends]
        return table


def longest_prefix(prefix_counts: np.ndarray | list[int], budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens.

    Counts can fall by a few when a character joins what stands before it, so the last fitting entry
    is searched from the right rather than by bisection alone.
    """
    counts = np.asarray(prefix_counts)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def fits(prefix_counts: np.ndarray | list[int], length: int, budget: int) -> bool:
    """Whether the first ``length`` characters are within ``budget`` tokens."""
    return int(prefix_counts[min(length, len(prefix_counts) - 1)]) <= budget


def cut_points(prefix_counts: np.ndarray | list[int], budget: int) -> list[int]:
    """Ends of consecutive chunks of a text such that each grows the count by at most ``budget``."""
    counts = np.maximum.accumulate(np.asarray(prefix_counts)).tolist()
    ends, at = [], 0
    while at < len(counts) - 1:
        nxt = bisect.bisect_right(counts, counts[at] + budget) - 1
        at = max(nxt, at + 1)
        ends.append(at)
    return ends


_counters: dict[str, PrefixCounter] = {}


def counter(vocabulary_file: str) -> PrefixCounter:
    """One counter per Python worker and file."""
    if vocabulary_file not in _counters:
        _counters[vocabulary_file] = PrefixCounter(vocabulary_file)
    return _counters[vocabulary_file]


def count_tokens(df: DataFrame, vocabulary_file: str, text: str = "text", prefixes: bool = False, keep_text: bool = True) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and, if asked for, ``prefix_tokens``.

    ``prefix_tokens`` is the table of counts at every character prefix (array of int, one more than
    characters), from which ``longest_prefix``, ``fits`` and ``cut_points`` answer without encoding.
    Narrow: no shuffle.
    """
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    if prefixes:
        added.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType(), False)))
    schema = with_columns(df, added)
    if not keep_text:
        schema = T.StructType([f for f in schema if f.name != text])
    kept = [f.name for f in schema.fields[: -len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_file)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(part.schema.get_field_index(text))
                texts = strings(column).to_pylist()
                out = [pa.array(np.diff(text_bytes(column)[1])), None]
                if prefixes:
                    tables = [c.prefix_counts(t) for t in texts]
                    out[1] = pa.array([int(t[-1]) for t in tables], pa.int64())
                    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(tables))))
                else:
                    out[1] = pa.array([c.count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept] + out, schema.names)

    return df.mapInArrow(run, schema)
