"""Spelling variants by reduced-alphabet neighbourhoods.

Letters are hashed to a few symbols. Each word of the vocabulary gives the full
one-edit neighbourhood of its reduced word (itself, one symbol deleted,
replaced or inserted, each result once) and joins the vocabulary by reduced
words; two words one edit apart meet exactly once that way, and what meets is
verified on the words themselves. Reduced words are polynomial hashes, of which
each neighbour costs a few operations, so long words are no special case.

The number of symbols follows the vocabulary: the fewest for which reduced
words stay almost unique (the sum of squares of their groups is at most
``crowding`` times the vocabulary), so that no group of words meets all with all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textbytes import Slice, mix, slices


@dataclass(frozen=True)
class Params:
    """Words have ``least`` code points and occurrences of at least ``count``; a
    form is ``lead`` times as frequent as its variant. One occurrence in
    ``rate`` is read with a code point dropped (0: none). ``symbols``: the
    sizes of reduced alphabets to choose from; ``map_bits``: the binary
    logarithm of the size of the map of reduced words."""

    least: int = 7
    count: int = 2
    lead: int = 10
    rate: int = 31
    symbols: tuple[int, ...] = (4, 6, 8, 12, 16, 24, 32, 64, 128)
    crowding: float = 1.25
    map_bits: int = 26


#: crc32 of a byte: the polynomial 0xEDB88320 over its eight bits.
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = (_TABLE >> np.uint32(1)) ^ np.where(_TABLE & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def crc32_of(data: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the byte ranges [a, b), each continuing the crc32 ``before``."""
    order = np.argsort(a - b, kind="stable")
    n, out = (b - a)[order], (before[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    long = int((n > 64).sum())
    for k in range(int(n[long]) if long < len(n) else 0):
        on = slice(long, int(np.searchsorted(-n, -k)))
        byte = data[a[order[on]] + k]
        out[on] = _TABLE[(out[on] ^ byte) & np.uint32(0xFF)] ^ (out[on] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        at = order[i]
        out[i] = zlib.crc32(data[a[at]:b[at]].tobytes(), int(before[at]))
    back = np.empty_like(out)
    back[order] = out
    return back


def _runs(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of A-Z, a-z, U+00C0 to U+00FF."""
    data = s.data
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)
    letter |= lead
    letter[1:] |= lead[:-1]
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    full = s.off[:-1] < s.off[1:]
    start[s.off[:-1][full]] = letter[s.off[:-1][full]]
    end[s.off[1:][full] - 1] = letter[s.off[1:][full] - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    return a, b, np.searchsorted(s.off, a, side="right") - 1


def _gather(data: np.ndarray, a: np.ndarray, b: np.ndarray, drop: np.ndarray) -> pa.Array:
    """The byte ranges as strings, without the bytes marked in ``drop``."""
    n = b - a
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(off[-1]) + np.repeat(a - off[:-1], n)
    keep = ~drop[at]
    left = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(left.tobytes()), pa.py_buffer(data[at[keep]].tobytes()))


def _counted(s: Slice, keys: list[str], p: Params) -> pa.Array:
    """Words of a slice (A-Z in lower case) with their counts."""
    a, b, row = _runs(s)
    first = (s.data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(first)])
    size = upto[b] - upto[a]
    long = size >= p.least
    a, b, row, size = a[long], b[long], row[long], size[long]
    drop = np.zeros(len(s.data), bool)
    if p.rate and len(a):
        held = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
        h = crc32_of(s.data, a, b, held[row])
        hit = h % np.uint32(p.rate) == 0
        starts = np.flatnonzero(first)
        at = starts[upto[a[hit]] + h[hit] % size[hit]]
        drop[at] = True
        wide = at[s.data[at] >= 0xC0]
        drop[wide + 1] = True
        stay = size - hit >= p.least
        a, b = a[stay], b[stay]
    return pc.value_counts(_gather(s.data, a, b, drop))


def vocabulary(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts with enough code points and occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z become lower case. A
    null text holds no words; a null id reads as empty; repeated rows count
    each; no rows give no words; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for s in slices(batch.column(1), lower=True):
                found = _counted(s, keys[s.first:s.first + s.rows], p)
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.count))


class _Reduced:
    """Reduced words of a slice of words: symbols 1 to q, and prefix sums of
    their polynomial (symbol i times base**i, modulo 2**64)."""

    BASE = 0x9E3779B97F4A7C15
    BACK = np.uint64(pow(BASE, -1, 1 << 64))

    def __init__(self, s: Slice, q: int):
        first = np.flatnonzero((s.data & 0xC0) != 0x80)
        code = s.data[first].astype(np.uint64)
        wide = np.flatnonzero(code >= 0xC0)
        code[wide] = (code[wide] & np.uint64(0x1F)) << np.uint64(6) | s.data[first[wide] + 1] & np.uint64(0x3F)
        self.off = np.searchsorted(first, s.off)
        self.n = np.diff(self.off)
        self.symbol = mix(code + np.uint64(0x51)) % np.uint64(q) + np.uint64(1)
        self.row = np.repeat(np.arange(s.rows), self.n)
        self.place = np.arange(len(code)) - self.off[self.row]
        powers = np.full(int(self.n.max(initial=0)) + 2, self.BASE, np.uint64)
        powers[0] = 1
        self.power = np.cumprod(powers, dtype=np.uint64)
        cum = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.symbol * self.power[self.place], dtype=np.uint64, out=cum[1:])
        self.before = cum[:-1] - cum[self.off[:-1]][self.row]
        self.total = cum[self.off[1:]] - cum[self.off[:-1]]

    def words(self) -> np.ndarray:
        return mix(self.total)

    def neighbours(self, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, hash) of every string at most one edit from each reduced word, each once."""
        yield np.arange(len(self.n)), mix(self.total)
        row, x, at = self.row, self.symbol, self.power[self.place]
        total, before = self.total[row], self.before
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == x[:-1]) & (row[1:] == row[:-1])
        yield row[~again], mix(before + (total - before - x * at) * self.BACK)[~again]
        ends = np.arange(len(self.n))
        for c in map(np.uint64, range(1, q + 1)):
            other = x != c
            yield row[other], mix(total + (c - x) * at)[other]
            # before each symbol, but not after an equal one, and at the end
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[:-1] != c) | (row[1:] != row[:-1])
            yield row[fresh], mix(before + c * at + (total - before) * np.uint64(self.BASE))[fresh]
            last = np.ones(len(ends), bool)
            some = self.n > 0
            last[some] = x[self.off[1:][some] - 1] != c
            yield ends[last], mix(self.total + c * self.power[self.n])[last]


def _hashed(words: DataFrame, q: int) -> DataFrame:
    """(h, id): the reduced hash of each of ``words`` (word, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(0), max_bytes=200_000):
                h = _Reduced(s, q).words()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1).slice(s.first, s.rows)], names=["h", "id"])

    return words.select("word", "id").mapInArrow(run, "h long, id long")


def alphabet(words: DataFrame, p: Params = Params()) -> int:
    """The fewest symbols that keep the reduced words of (word, id) almost unique."""
    total = words.count()
    for q in p.symbols[:-1]:
        crowd = _hashed(words, q).groupBy("h").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if crowd <= p.crowding * total:
            return q
    return p.symbols[-1]


def _bit_map(reduced: DataFrame, bits: int) -> np.ndarray:
    """A bit for the upper ``bits`` bits of each hash: 2**bits bits, however
    many hashes there are, made in blocks by the tasks."""
    block = min(bits, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for b in np.unique(place >> np.uint64(block)):
                at = (place[place >> np.uint64(block) == b] & np.uint64((1 << block) - 1)).astype(np.int64)
                held.setdefault(int(b), np.zeros(1 << block, bool))[at] = True
        for b, on in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    made = reduced.select("h").repartition(F.shiftrightunsigned("h", 64 - bits + block)).mapInArrow(run, "block long, bits binary")
    for r in made.collect():
        out[r["block"] << (block - 3):(r["block"] + 1) << (block - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sent(words: DataFrame, reduced: DataFrame, q: int, turn: int, turns: int, p: Params) -> DataFrame:
    """(h, id, same): of each word's whole neighbourhood what this turn sends:
    the strings of its part of the hash range that some reduced word may be,
    and that aren't above the word's own (the other word of a pair sends those)."""
    held = words.sparkSession.sparkContext.broadcast(_bit_map(reduced.filter(F.pmod("h", F.lit(turns)) == turn), p.map_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for s in slices(batch.column(0), max_bytes=200_000):
                r, found = _Reduced(s, q), []
                own = r.words().view(np.int64)
                for row, h in r.neighbours(q):
                    place = (h >> np.uint64(64 - p.map_bits)).astype(np.int64)
                    near = h.view(np.int64)
                    hit = (held.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & np.uint8(1) == 1
                    hit &= near <= own[row]
                    if turns > 1:
                        hit &= np.mod(near, turns) == turn
                    found.append((row[hit], near[hit]))
                row, h = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[s.first + row]), pa.array(h == own[row])], names=["h", "id", "same"])

    return words.select("word", "id").mapInArrow(run, "h long, id long, same boolean")


def near_words(words: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n, near, near_n): every two of ``words`` (word, n, id: a hash of
    the word) that differ by exactly one inserted, deleted or replaced code point, once.

    A bit map of fixed size tells which neighbours some reduced word may be;
    a vocabulary too large for one map is gone through in turns.
    """
    q = alphabet(words, p)
    reduced = materialize(_hashed(words, q).join(words.select("id", F.col("word").alias("near"), F.col("n").alias("near_n")), "id")
                          .withColumnRenamed("id", "other"), "reduced")
    turns = max(1, -(-reduced.count() // (1 << (p.map_bits - 3))))
    found = None
    for turn in range(turns):
        meet = _sent(words, reduced, q, turn, turns, p).join(reduced, "h").filter("NOT same OR id < other").select("id", "near", "near_n")
        found = meet if found is None else found.union(meet)
    return found.join(words, "id").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, two steps becoming one each round."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of the vocabulary: word, form (its near word of largest
    n, ties to the smallest in code-point order, if ``lead`` times as frequent,
    else null), root (the last of the forms that follow each other; the word
    itself if it has none), n, n_near (near words), form_n.

    A form is far more frequent than its variant, so forms never run in a ring.
    For odd rows see ``vocabulary``.
    """
    words = materialize(vocabulary(docs, p, doc_id, text).withColumn("id", F.xxhash64("word")), "vocabulary")
    both = F.explode(F.array(F.struct("word", F.struct((-F.col("near_n")).alias("less"), "near").alias("e")),
                             F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("e"))))
    near = near_words(words, p).select(both.alias("b")).groupBy("b.word").agg(F.count("*").alias("n_near"), F.min("b.e").alias("best"))
    rows = words.select("word", "n").join(near, "word", "left")
    leads = -F.col("best.less") >= p.lead * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "forms")
    return rows.join(_roots(rows.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
