"""Near-duplicate components by HyperMinHash.

A document is its set of word shingles (64-bit hashes, whole text). The hash
range is dealt into buckets; each keeps its smallest hash as a register of the
number of leading zeros and some mantissa bits (16 bits in all); an empty
bucket borrows the first filled one of a fixed probing order. Bands of
registers are join keys. Copies of one set collapse first, so a group of
copies is one entry. The members of a band bucket are compared in blocks of
bounded size, twice: by a Jaccard estimate of their registers, corrected for
accidental collisions, which leaves only members with a likely partner; then
by the intersections of their full sets. A block answers with the component
each member falls in, so pairs are never listed, however many copies meet. A
bucket larger than a block is compared inside its parts first; only members
that are not yet connected then meet across parts (``buckets``). A pair that
shares several bands meets in the first of them. Where what is not connected
takes several blocks, and each member would be sent to many, the bucket's
members meet at the rarest of all their shingles instead (as many as any similar
set shares one of).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Block, Compare, across, inside, marked, once, spanning, unconnected
from .components import components
from .shared import materialize
from .textbytes import Slice, mix, slices
from .thinning import thinned, unpacked


MEMBER = "key long, id long, fa long"


@dataclass(frozen=True)
class Params:
    """``bands`` of ``rows`` registers each are join keys (a pair at 0.8 shares
    none with a chance of 3 in a million, at 0.85 of 2 in 100 million); an
    estimate may lie ``sigmas`` standard deviations below the threshold before
    a pair is dropped; ``block``, ``block_values``: members, and shingles of
    them, that are compared at once; ``map_bits``: size of the bit map of
    documents whose texts are read again."""

    shingle: int = 5
    percent: int = 80
    registers: int = 128
    rows: int = 4
    bands: int = 24
    mantissa: int = 10
    sigmas: float = 6.0
    block: int = 1024
    block_values: int = 2_000_000
    map_bits: int = 1 << 26


def row_sets(s: Slice, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    at, h = s.windows(k)
    n = np.diff(s.dw)
    ends = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    short = s.word_ranges(s.dw[:-1], s.dw[1:])
    for r in range(s.rows):
        if n[r] >= k:
            yield np.unique(h[ends[r]:ends[r + 1]])
        else:
            yield short[r:r + 1] if n[r] else short[:0]


@lru_cache
def _probes(m: int) -> np.ndarray:
    """For each bucket, a fixed pseudorandom order of all buckets."""
    at = np.arange(m * m, dtype=np.uint64).reshape(m, m)
    return np.argsort(mix(at + np.uint64(7)), axis=1)


def _registers(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """(len(sets), registers) uint16; sets must not be empty."""
    m = p.registers
    bits = 64 - (m.bit_length() - 1)
    edges = (np.arange(m, dtype=np.uint64) << np.uint64(bits))
    low = np.zeros((len(sets), m), np.uint64)
    filled = np.zeros((len(sets), m), bool)
    for i, u in enumerate(sets):
        first = np.searchsorted(u, edges)
        nxt = np.append(first[1:], len(u))
        filled[i] = first < nxt
        low[i] = u[np.minimum(first, len(u) - 1)]
    rest = low & np.uint64((1 << bits) - 1)
    drop = np.uint64(bits - 53)
    zeros = 53 - np.frexp((rest >> drop).astype(np.float64))[1]
    zeros = np.where(rest >> drop == 0, 53, zeros).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) & np.uint64((1 << bits) - 1)
    reg = ((zeros << np.uint64(p.mantissa)) | (tail >> np.uint64(bits - p.mantissa))).astype(np.uint16)
    empty, probes = ~filled, _probes(m)
    for t in range(m):
        r, c = np.nonzero(empty)
        if not len(r):
            break
        source = probes[c, t]
        ok = filled[r, source]
        reg[r[ok], c[ok]] = reg[r[ok], source[ok]]
        empty[r[ok], c[ok]] = False
    return reg


@lru_cache(maxsize=4096)
def _accident(la: int, lb: int, m: int, mantissa: int) -> float:
    """Chance that registers of two unrelated sets of 2**la and 2**lb agree."""
    x = 2.0 ** -(np.arange(54)[:, None] + 1)
    cell = x / (1 << mantissa)
    left = x + cell * np.arange(1 << mantissa)[None, :]
    pa_, pb_ = (np.exp(-(2.0 ** q / m) * left) * -np.expm1(-(2.0 ** q / m) * cell) for q in (la, lb))
    return float((pa_ * pb_).sum())


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    """Jaccard estimates of all rows of ``a`` with all of ``b`` (register
    rows, set sizes), corrected for accidental collisions."""
    same = np.stack([(x == b).mean(axis=1) for x in a])
    la, lb = np.log2(na).round().astype(int), np.log2(nb).round().astype(int)
    ua, ia = np.unique(la, return_inverse=True)
    ub, ib = np.unique(lb, return_inverse=True)
    by = np.array([[_accident(int(x), int(y), p.registers, p.mantissa) for y in ub] for x in ua])[ia[:, None], ib[None, :]]
    return (same - by) / (1 - by)


def sketches(docs: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, fa, fb, sketch): set size, 128-bit fingerprint of the set,
    registers. Empty sets have n 0 and null sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), max_bytes=500_000, lower=True):
                sets = list(row_sets(s, p.shingle))
                n = np.array([len(u) for u in sets], np.int64)
                some = [u for u in sets if len(u)]
                reg = iter(_registers(some, p)) if some else iter(())
                fa = np.array([mix(u).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                fb = np.array([mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), pa.array(n), pa.array(fa), pa.array(fb),
                     pa.array([next(reg).tobytes() if x else None for x in n], pa.binary())],
                    names=["doc_id", "n", "fa", "fb", "sketch"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n long, fa long, fb long, sketch binary"))


def _bit_map(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash place that one of ``ids`` takes: ``bits`` / 8 bytes, whatever their number."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    held = (ids.select(F.shiftright(place, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(bits // 32, np.uint32)
    out[held["w"].to_numpy(np.int64)] = held["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, p: Params, doc_id: str, text: str) -> DataFrame:
    """(id, fa, shingles): full sets of the ``wanted`` ids (and maybe some
    more), the upper 48 bits of each sorted hash (two shingles of a pair agree
    by accident once in 10**11 pairs).

    Few ids are looked up in a bit map of fixed size while the texts are
    scanned; where there are too many for it to tell, a join picks the texts.
    """
    some = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    few = wanted.count() <= p.map_bits // 8
    if few:
        some = some.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(p.map_bits)))
        held = docs.sparkSession.sparkContext.broadcast(_bit_map(wanted, p.map_bits))
    else:
        some = some.join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if few:
                place = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((held.value[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1))
            for s in slices(batch.column(1), max_bytes=500_000, lower=True):
                sets = list(row_sets(s, p.shingle))
                fa = np.array([mix(u).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                raw = [u.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for u in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(fa), pa.array(raw, pa.binary())],
                                                 names=["id", "fa", "shingles"])

    return some.mapInArrow(run, "id long, fa long, shingles binary")


def sized(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that allow the similarity at all, all with all."""
    return 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])


def _band_bits(p: Params) -> int:
    return max(1, (p.bands - 1).bit_length())


def _keys(p: Params) -> Column:
    """A key for each band of a sketch: the band, then a hash of its registers."""
    width, bits = 2 * p.rows, _band_bits(p)
    return F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda b: F.shiftleft(b.cast("long"), 63 - bits).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64(b, F.substring("sketch", b * width + 1, F.lit(width))), 1 + bits)))


def _met(reg: np.ndarray, x: np.ndarray, y: np.ndarray, band: int, p: Params) -> np.ndarray:
    """Pairs that share one of the bands before ``band``, so that they meet there."""
    out = np.zeros((len(x), len(y)), bool)
    for b in range(band):
        _, code = np.unique(reg[:, b * p.rows:(b + 1) * p.rows], axis=0, return_inverse=True)
        out |= code[x][:, None] == code[y][None, :]
    return out


def _likely(p: Params) -> Compare:
    """Marks members (key, id, fa, n, sketch) with a likely partner. A pair
    counts in the bucket of its first common band only, unless the bucket is
    compared inside several ``parts``: each is another chance to meet early."""
    t = p.percent / 100

    def what(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
        n = g["n"].to_numpy()
        reg = np.frombuffer(b"".join(g["sketch"]), np.uint16).reshape(len(g), -1)
        ok = pairs & sized(n[x], n[y], p.percent)
        if "parts" not in g or g["parts"].iat[0] == 1:
            ok &= ~_met(reg, x, y, int(g["key"].iat[0]) >> (63 - _band_bits(p)), p)
        for at in range(0, len(x), 64):    # strips of rows: floats for all pairs at once would be most of a worker's memory
            some = slice(at, at + 64)
            if ok[some].any():
                free = np.minimum(np.minimum(n[x[some]][:, None], n[y][None, :]), p.registers)
                ok[some] &= estimate(reg[x[some]], reg[y], n[x[some]], n[y], p) >= t - p.sigmas * np.sqrt(t * (1 - t) / free)
        return marked(g, x, y, ok)

    return what


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = place[code[keep]], owner[keep]
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for c in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(code, [c, c + 1024])
        held = np.zeros((len(sets), 1024), np.float32)
        held[owner[a:b], code[a:b] - c] = 1
        out += held[x] @ held[y].T
    return out.astype(np.int64)


def similar(raw: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which sets x are similar to which sets y."""
    n = np.array([len(u) for u in raw])
    both = intersections(raw, x, y)
    return (both > 0) & (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both))


def _linked(p: Params) -> Compare:
    """Edges that join what links on the full sets of members (key, id, fa, shingles) connect."""

    def what(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
        return spanning(g, x, y, pairs & similar(unpacked(g["shingles"]), x, y, p.percent))

    return what


def contracted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` that the links so far give each id."""
    found = materialize(components(links), "contracted").withColumnsRenamed({"id": "_i", "component": "_c"})
    return rows.join(found, F.col("id") == F.col("_i"), "left").withColumn("component", F.coalesce("_c", "id")).drop("_i", "_c")


def with_components(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, n, fa, fb) from nodes
    (id, fa, fb) and links (a, b) between their ids. Rows sharing a doc_id are
    one document; those of a null doc_id have no component."""
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), "fa", "fb").join(nodes.select("fa", "fb", "id"), ["fa", "fb"], "left")
    place = F.struct("fa", "fb")
    several = materialize(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
                          .filter("lo <> hi").select("doc_id"), "several")
    if not several.isEmpty():
        # the texts of a document are linked; those without words go with the others
        held = materialize(named.join(several, "doc_id").filter("id is not null").select("doc_id", "id").distinct(), "held")
        low = held.groupBy("doc_id").agg(F.min("id").alias("low"))
        links = links.union(held.join(low, "doc_id").select(F.col("low").alias("a"), F.col("id").alias("b")))
        named = named.join(low, "doc_id", "left").withColumn("id", F.coalesce("id", "low")).drop("low")
    named = named.join(components(links), "id", "left")
    own = named.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
    return own.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (set size),
    component_id (smallest doc_id reachable over links, itself included), kept
    (doc_id = component_id).

    A text with fewer words than a shingle is one shingle; without words (or
    null) it has none and links with nothing. Letters A-Z compare in lower
    case. Rows with a null doc_id take no part (component null, kept). Rows
    sharing a doc_id are one document, linked through any of its texts.
    Columns other than the two named ones are not read. No rows give no rows.
    """
    size, registers, values = Block(p.block, p.block_values), F.lit(p.registers), F.col("n")
    rows = materialize(sketches(docs, p, doc_id, text), "sketches")
    nodes = materialize(rows.filter("n > 0 and doc_id is not null").groupBy("fa", "fb")
                        .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    keyed = nodes.select("id", "fa", "n", F.explode(_keys(p)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    hits = materialize(once(materialize(keyed.join(shared, "key"), "hits")).drop("size"), "hits")
    sketched = nodes.select("id", "fa", "sketch")

    def full(member: DataFrame) -> DataFrame:
        return sets_of(docs, member.select("id").distinct(), p, doc_id, text)

    def confirmed(likely: DataFrame, meet: Callable[..., DataFrame]) -> DataFrame:
        sets = materialize(full(likely), "sets")
        return materialize(meet(likely, sets, size, _linked(p), "a long, b long", values).distinct(), "links")

    # inside the parts of each bucket; then, of buckets of several parts, across those not yet connected
    likely = materialize(inside(hits, sketched, size, _likely(p), MEMBER, registers).distinct(), "likely")
    likely = materialize(hits.join(likely, ["key", "id", "fa"]), "likely")
    links = confirmed(materialize(once(likely).drop("size"), "likely"), inside)
    # a bucket may have taken several parts by its registers or, when confirmed, by its shingles
    most = F.greatest(registers, values)
    left = thinned(materialize(unconnected(contracted(hits, links), size, most), "unconnected"), full, size, p.percent, most)
    if not left.isEmpty():
        likely = materialize(across(left, sketched, size, _likely(p), MEMBER, registers).distinct(), "likely")
        links = links.union(confirmed(materialize(left.join(likely, ["key", "id", "fa"]), "likely"), across))
    own = with_components(rows, nodes, links)
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
