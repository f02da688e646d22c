"""Removal of passages that repeat anywhere in a corpus.

Fixed-block anchors: any ``window`` words hold a whole block of ``block``
words that starts at a multiple of ``block`` in its document, when
``2 * block - 1 <= window``. So only those non-overlapping blocks are indexed;
every rolling window of ``block`` words probes the index. Hits are extended to
the ``window``-word sequences around them, and sequences that start in two
places are exact repeats; their union is the maximal repeat.

Texts are dealt into chunks of bounded size and written once as a table
bucketed by chunk, so the three passes over them shuffle no text. Between the
passes only hashes travel: each chunk sends its sorted distinct hashes as
small deltas, dealt by hash range, so a passage in thousands of documents is
one entry per chunk, and gets back the hashes that repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import materialize
from .textbytes import Slice, cover, slices


@dataclass(frozen=True)
class Params:
    """``chunk_bytes``: text of a chunk; ``range_hashes``: about how many
    hashes meet in one task; ``bits``: length of the probing hashes (false
    hits only cost a second look: sequences are compared by 64 bits);
    ``buckets``: of the table of texts, at most (a bucket holds whole chunks)."""

    window: int = 35
    chunk_bytes: int = 8_000_000
    range_hashes: int = 3_000_000
    bits: int = 44
    buckets: int = 10_000

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Deltas in 4 bytes where they fit, else the 8-byte values."""
    d = np.diff(sorted_hashes)
    if len(d) and int(d.max()) >> 32:
        return b"\x08" + sorted_hashes.tobytes()
    return b"\x04" + sorted_hashes[:1].tobytes() + d.astype(np.uint32).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw, np.uint64, count=1, offset=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def _parcels(chunk: int, hashes: list[np.ndarray], anchors: list[np.ndarray], ranges: int, bits: int) -> pa.RecordBatch | None:
    """A chunk's distinct hashes by hash range, with two bits each: held by an
    anchor, and held more than once."""
    h, anchor = np.concatenate(hashes), np.concatenate(anchors)
    if not len(h):
        return None
    order = np.argsort(h)
    h, anchor = h[order], anchor[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    many = np.diff(np.append(first, len(h))) > 1
    anchor = np.logical_or.reduceat(anchor, first)
    h = h[first]
    part = ((h >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)),
         pa.array([_pack(h[cuts[i]:cuts[i + 1]]) for i in full], pa.binary()),
         pa.array([np.packbits(np.concatenate([anchor[cuts[i]:cuts[i + 1]], many[cuts[i]:cuts[i + 1]]])).tobytes() for i in full], pa.binary())],
        names=["part", "chunk", "hashes", "flags"])


def _repeated(parcels: DataFrame) -> DataFrame:
    """(chunk, hashes): for each chunk those of its hashes that an anchor
    holds and that occur at two places at least."""

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        h, anchor, many, chunk = [], [], [], []
        for c, raw, flags in zip(g["chunk"], g["hashes"], g["flags"], strict=True):
            x = _unpack(raw)
            b = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * len(x)).astype(bool)
            h.append(x)
            anchor.append(b[:len(x)])
            many.append(b[len(x):])
            chunk.append(np.full(len(x), c, np.int64))
        h, anchor, many, chunk = map(np.concatenate, (h, anchor, many, chunk))
        order = np.argsort(h)
        s = h[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        places = np.diff(np.append(first, len(s)))
        hit = np.logical_or.reduceat(anchor[order], first) & ((places > 1) | np.logical_or.reduceat(many[order], first))
        rows = order[np.repeat(hit, places)]
        out = pd.DataFrame({"chunk": chunk[rows], "h": h[rows]}).sort_values(["chunk", "h"])
        return pd.DataFrame([(c, x["h"].to_numpy().tobytes()) for c, x in out.groupby("chunk")], columns=["chunk", "hashes"])

    return parcels.groupBy("part").applyInPandas(meet, "chunk long, hashes binary")


def _known(table: pa.Table) -> np.ndarray:
    raw = [x.as_py() for x in table.column("hashes")]
    return np.unique(np.frombuffer(b"".join(raw), np.uint64)) if raw else np.zeros(0, np.uint64)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _candidates(s: Slice, hits: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold a hit, and their hashes."""
    at, h = s.windows(p.block)
    probe = np.zeros(len(s.ws) + 1, np.int64)
    probe[at + 1] = _among(h >> np.uint64(64 - p.bits), hits)
    upto = np.cumsum(probe)
    w = np.arange(len(s.ws))
    w = w[w + p.window <= s.dw[1:][s.word_row]]
    w = w[upto[w + p.window - p.block + 1] > upto[w]]
    return w, s.word_ranges(w, w + p.window)


def remove_repeats(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed (long),
    kept_text (the words left, joined by one space), removed (array of
    [first, end) word ranges).

    A word goes if a ``window``-word sequence over it also starts at another
    place of the input, in the same text or another. Null texts are empty;
    texts shorter than the window are kept whole; repeated rows are copies of
    each other, so their long passages go from all of them; null ids are
    fine; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    block, key = p.block, f"repeats_{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = int(size // p.chunk_bytes) + 1
    ranges = int(size // 6 // p.range_hashes) + 1
    # a row's place depends on id and text, so that no repeated id fills a chunk
    (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
     .withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(chunks)))
     .repartition(min(chunks, p.buckets), "chunk").write.format("parquet").option("path", scratch_path(spark, f"tables/{key}"))
     .option("compression", "zstd").bucketBy(min(chunks, p.buckets), "chunk").sortBy("chunk").saveAsTable(key))
    dealt = spark.table(key)
    parcel = "part int, chunk long, hashes binary, flags binary"

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hashes, anchors = None, [], []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)] if len(ids) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if ids[a] != chunk:
                    if hashes and (out := _parcels(chunk, hashes, anchors, ranges, p.bits)):
                        yield out
                    chunk, hashes, anchors = int(ids[a]), [], []
                for s in slices(batch.column(1).slice(a, b - a)):
                    at, h = s.windows(block)
                    hashes.append(h >> np.uint64(64 - p.bits))
                    anchors.append((at - s.dw[:-1][s.word_row[at]]) % block == 0)
        if hashes and (out := _parcels(chunk, hashes, anchors, ranges, p.bits)):
            yield out

    hits = materialize(_repeated(dealt.select("chunk", "text").mapInArrow(probes, parcel)), "hits")

    def extend(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known, h = _known(right), []
        if len(known):
            for s in slices(left.column("text")):
                h.append(_candidates(s, known, p)[1])
        out = _parcels(key_[0].as_py(), h, [np.ones(len(x), bool) for x in h], ranges, 64) if h else None
        if out is None:
            return pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("flags", pa.binary())]).empty_table()
        return pa.Table.from_batches([out])

    by_chunk = dealt.select("chunk", "text").groupBy("chunk")
    repeats = materialize(_repeated(by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, parcel)), "repeats")

    def cut(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known, parts = _known(right), []
        for s in slices(left.column("text")):
            gone = np.zeros(len(s.ws), bool)
            if len(known):
                at, h = s.windows(p.window)
                gone = cover(at[_among(h, known)], p.window, len(s.ws))
            kept = ~gone
            # the kept words and a space after each, as one run of bytes by row
            lens = (s.we - s.ws + 1)[kept]
            total = np.cumsum(np.concatenate([[0], lens]))
            data = np.append(s.data, np.uint8(32))
            take = np.arange(total[-1]) + np.repeat(s.ws[kept] - total[:-1], lens)
            out = data[take]
            out[total[1:] - 1] = 32
            n_kept = np.searchsorted(np.flatnonzero(kept), s.dw)
            ends = total[n_kept]
            raw = out.tobytes()
            texts = [raw[a:max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) != 0)
            spans = [[] for _ in range(s.rows)]
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                # a run may go on from one row into the next
                while a < b:
                    r = int(np.searchsorted(s.dw, a, side="right")) - 1
                    stop = min(b, s.dw[r + 1])
                    spans[r].append([int(a - s.dw[r]), int(stop - s.dw[r])])
                    a = stop
            n = np.diff(s.dw)
            parts.append(pa.RecordBatch.from_arrays(
                [left.column("doc_id").combine_chunks().slice(s.first, s.rows), pa.array(n.astype(np.int64)),
                 pa.array((n - np.diff(n_kept)).astype(np.int64)), pa.array(texts, pa.string()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"]))
        if not parts:
            kind = left.schema.field("doc_id").type
            return pa.schema([("doc_id", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                              ("removed", pa.list_(pa.list_(pa.int64())))]).empty_table()
        return pa.Table.from_batches(parts)

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return (dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk"))
            .applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string, removed array<array<bigint>>"))
