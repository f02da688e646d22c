"""Packing documents into sequences of a fixed number of tokens: best-two-fit.

Tokens: texts are cut where the tokenizer's own rules always cut (at white
space, around digits, between ASCII letters and ASCII marks), A-Z in lower
case as the tokenizer reads them, and each distinct run of a worker is encoded
once. Only documents longer than a
sequence are cut. Pieces are dealt into groups of bounded size, each packed
by itself: fill a sequence greedily with the longest piece that fits; then
take out its smallest piece and put in the two unpacked ones that fit the
widened gap best, if that fills more. A group wastes about one sequence.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textbytes import IS_SPACE, LOWER, Slice, slices


@dataclass(frozen=True)
class Params:
    """``cache``: distinct words a worker remembers; ``group``: pieces packed
    together (about)."""

    length: int = 4096
    end_id: int = 1
    cache: int = 400_000
    group: int = 20_000


# Byte classes: 0 white space, 1 letter, 2 digit, 3 mark, 4 the rest (bytes of
# other scripts, the apostrophe of contractions, control characters)
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[b for b in range(33, 127) if b != ord("'")]] = 3
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = 1
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = 2
_CLASS[IS_SPACE] = 0
#: Neighbours that never share a token: a digit and anything, a letter and a mark.
_CUT = np.zeros((5, 5), bool)
_CUT[2, 1:] = _CUT[1:, 2] = _CUT[1, 3] = _CUT[3, 1] = True


def _runs(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the runs of a slice."""
    if not len(s.ws):
        return s.ws, s.we
    cls = _CLASS[s.data]
    start = np.zeros(len(s.data), bool)
    start[1:] = _CUT[cls[:-1], cls[1:]]
    start[s.ws] = True
    at = np.flatnonzero(start)
    word_end = s.we[np.searchsorted(s.ws, at, side="right") - 1]
    return at, np.minimum(np.append(at[1:], len(s.data)), word_end)


class _Words:
    """Token ids of runs by hash, encoded once each while they are remembered.
    Entry 0 is the end of a document."""

    def __init__(self, vocab: str, end_id: int, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.limit = Tokenizer.from_file(vocab), end_id, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.array([self.end_id], np.uint32)
        self.first, self.n = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.array([len(x) for x in got], np.int64)
        self.known.update(zip(keys, range(len(self.n), len(self.n) + len(keys)), strict=True))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.ids, self.n = np.concatenate([self.ids, flat]), np.concatenate([self.n, n])

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, each ended, and the number of each."""
        if len(self.known) > self.limit:
            self._clear()
        # strings of special tokens only count as written
        special = b"<|" in s.data.tobytes()
        if not special:
            s = Slice(LOWER[s.data], s.off, s.first)
        a, b = (s.ws, s.we) if special else _runs(s)
        h, first, inverse = np.unique(s.byte_ranges(a, b), return_index=True, return_inverse=True)
        known, keys = self.known, h.tolist()
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            raw, at = s.data.tobytes(), first[new]
            self._learn([keys[i] for i in new], [raw[x:y].decode() for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)])
        code = np.array([known[k] for k in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64)
        upto = np.searchsorted(a, s.off[1:])
        code = np.insert(code, upto, 0)
        n = self.n[code]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.first[code] - (ends - n), n)
        return self.ids[at], np.diff(np.concatenate([[0], ends[upto + np.arange(s.rows)]]))


_words: dict[tuple, _Words] = {}


def tokenized_pieces(docs: DataFrame, vocab: str, p: Params = Params(), doc_id: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, row, piece, start, length, ids_crc32[, ids]): every
    document's ids and the end id, cut only if longer than a sequence. ``row``
    is one number per row of ``docs``; ids are little-endian 32-bit numbers."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocab, p.end_id, p.cache)
        words = _words.get(key) or _words.setdefault(key, _Words(*key))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s in slices(batch.column(1), max_bytes=1_000_000):
                ids, n = words.encode(s)
                parts = -(-n // p.length)
                of = np.repeat(np.arange(s.rows), parts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * p.length
                length = np.minimum(p.length, n[of] - start)
                a = (np.cumsum(n) - n)[of] + start
                blobs = [ids[x:x + y].tobytes() for x, y in zip(a, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows).take(pa.array(of)), pa.array(row + of), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                     *([pa.array(blobs, pa.binary())] if with_ids else [])], names=names)
                row += s.rows

    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids))


class _Pool:
    """Unpacked pieces by length; a bit set of the lengths at hand."""

    def __init__(self, lengths: np.ndarray):
        self.of: dict[int, list[int]] = {}
        for i in np.lexsort((np.arange(len(lengths)), lengths))[::-1]:
            self.of.setdefault(int(lengths[i]), []).append(int(i))
        self.bits = sum(1 << n for n in self.of)

    def longest(self, most: int) -> int:
        """The longest length at hand up to ``most`` (0: none)."""
        return max((self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0

    def take(self, n: int) -> int:
        at = self.of[n]
        i = at.pop()
        if not at:
            del self.of[n]
            self.bits ^= 1 << n
        return i

    def give(self, n: int, i: int) -> None:
        if n not in self.of:
            self.of[n] = []
            self.bits |= 1 << n
        self.of[n].append(i)

    def best_two(self, most: int, over: int) -> tuple[int, int]:
        """Two lengths at hand whose sum is largest in (over, most]; (0, 0): none."""
        best, x = (0, 0), self.longest(most - 1)
        while x and 2 * x > over:
            y = self.longest(min(x, most - x))
            if y == x and len(self.of[x]) < 2:
                y = self.longest(x - 1)
            if y and x + y > max(over, sum(best)):
                best = (x, y)
                if x + y == most:
                    break
            x = self.longest(x - 1)
        return best


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 .. size)."""
    pool, bins, offset = _Pool(lengths), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while pool.bits:
        gap, items = size, []
        while n := pool.longest(gap):
            items.append((n, pool.take(n)))
            gap -= n
        if gap and pool.bits:
            n, i = items[-1]
            x, y = pool.best_two(gap + n, n)
            if x:
                items[-1:] = [(x, pool.take(x)), (y, pool.take(y))]
                pool.give(n, i)
        at = 0
        for n, i in items:
            bins[i], offset[i], at = number, at, at + n
        number += 1
    return bins, offset


def pack(pieces: DataFrame, p: Params = Params()) -> DataFrame:
    """``pieces`` (row, piece, length and any more) with sequence_id and offset."""
    n = pieces.count()
    groups = int(n // p.group) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["row", "piece"], ignore_index=True)
        bins, offset = best_two_fit(g["length"].to_numpy(), p.length)
        return g.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset)

    return (pieces.groupBy(F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("_g"))
            .applyInPandas(run, schema + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, vocab: str, p: Params = Params(), doc_id: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and the ids as bytes, if wanted).

    Null and empty texts are documents of one token (the end id). Repeated
    rows are packed each, null ids too; other columns are not read; an empty
    table gives no rows. Sequence numbers are unique, not consecutive.
    """
    pieces = materialize(tokenized_pieces(docs, vocab, p, doc_id, text, with_ids), "pieces")
    return pack(pieces, p).drop("row")
