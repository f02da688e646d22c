"""Jaccard self-join of word n-gram sets by adaptive multi-match prefixes.

A document is its set of word shingles (hashes, whole text); copies of one set
collapse to a node. Shingles are ordered by hash, and two similar sets share at
least m of the first ``n - ceil(t * n) + m`` shingles of each, for every m. The
shingles of the longest prefixes are counted; a node with fewer than m shared
ones in any of its prefixes has no partner and goes, without a look at a pair.

Each node left chooses its m from ``levels`` by estimated cost: a longer
prefix, which must share more, against the candidates its shingles bring. Of a
prefix for m the m - 1 most frequent shingles need not be looked up: a pair
that shares m of them meets at the rarest. A node is found under its own m and
under the smaller ones of others; a pair meets under the smaller m of the two.

Shingles are keys of buckets; what meets there must share enough of its prefixes,
then its full sets are compared. Buckets are compared in blocks and answer with
edges that span what they link (``buckets``). Each node goes to its largest
bucket first; in the others only what that left unconnected meets. Where that is
more than a block, and each member would be sent to many, its members meet at the
rarest of all their shingles instead (as many as any similar set shares one of).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .buckets import Block, Compare, across, inside, marked, once, spanning, unconnected
from .shared import materialize
from .textbytes import mix, slices
from .thinning import postings as _postings
from .thinning import thinned


@dataclass(frozen=True)
class Params:
    """``levels``: the numbers of shared prefix shingles to choose from, rising
    from 1; ``block``: members, and shingles of them, that meet at once."""

    shingle: int = 4
    percent: int = 85
    levels: tuple[int, ...] = (1, 4, 16)
    block: Block = Block()


def _need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n shares with any similar set, at least."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, fa, fb, prefix): set size, 128-bit fingerprint of the set, its
    longest prefix (the upper 6 bytes of each hash, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), lower=True):
                sets = list(neardup.row_sets(s, p.shingle))
                n = np.array([len(u) for u in sets], np.int64)
                fa = np.array([mix(u).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                fb = np.array([mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)
                raw = [u[:len(u) - _need(len(u), p.percent) + p.levels[-1]].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for u in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(n), pa.array(fa), pa.array(fb), pa.array(raw, pa.binary())],
                                                 names=["doc_id", "n", "fa", "fb", "prefix"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n long, fa long, fb long, prefix binary"))


def _short(prefix: bytes) -> bytes:
    """The upper 4 bytes of each shingle, in big-endian order."""
    return np.frombuffer(prefix, np.uint8).reshape(-1, 6)[:, :1:-1].tobytes()


def _shortened(nodes: DataFrame) -> DataFrame:
    """(id, fa, prefix) with 4 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_short(x.as_buffer()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["id", "fa", "prefix"])

    return nodes.select("id", "fa", "prefix").mapInArrow(run, "id long, fa long, prefix binary")


def chosen(n: int, place: np.ndarray, df: np.ndarray, token: np.ndarray, p: Params) -> list[tuple[int, np.ndarray]]:
    """The levels under which a node is found, its own last, each with the
    indexes of the shingles to look up; none if it has no partner.

    ``place``, ``df``, ``token`` (place ascending): its prefix shingles that
    others hold too, and the number of nodes that hold them.
    """
    need = int(_need(n, p.percent))
    most = np.arange(1, min(need, p.levels[-1]) + 1)
    if (np.searchsorted(place, n - need + most) < most).any():
        return []
    out, best = [], None
    for m in p.levels:
        if m > need:
            break
        held = np.arange(np.searchsorted(place, n - need + m))
        look = held[np.lexsort((token[held], df[held]))][:len(held) - (m - 1)]
        cost = n - need + m + int((df[look] - 1).sum())
        out.append((m, look))
        if best is None or cost < best[0]:
            best = (cost, len(out))
    return out[:best[1]]


def _lookups(shared: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """(key, id, fa, level, own): the buckets of each node (id, fa, n of ``sizes``) with a possible
    partner; ``level`` its own, ``own``: whether the bucket is of that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                id_, fa, n = (batch.column(k)[i].as_py() for k in range(3))
                held = batch.column(3)[i].values
                place, df, token = (held.field(k).to_numpy() for k in range(3))
                order = np.argsort(place, kind="stable")
                place, df, token = place[order], df[order], token[order]
                levels = chosen(n, place, df, token, p)
                for m, look in levels:
                    key = mix(token[look].view(np.uint64) * np.uint64(64) + np.uint64(m)).view(np.int64)
                    found.append((key, id_, fa, levels[-1][0], m == levels[-1][0]))
            if found:
                size = [len(k) for k, *_ in found]
                rest = [np.repeat(np.array([f[k] for f in found]), size) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, *_ in found])), *map(pa.array, rest)],
                                                 names=["key", "id", "fa", "level", "own"])

    held = shared.groupBy("id", "fa").agg(F.collect_list(F.struct("place", "df", "token")).alias("held"))
    return held.join(sizes, ["id", "fa"]).select("id", "fa", "n", "held").mapInArrow(run, "key long, id long, fa long, level long, own boolean")


def _asked(hits: DataFrame) -> DataFrame:
    """Lookups in buckets of two and more members that are of somebody's own
    level; of buckets with the same members one. ``size`` is added."""
    same = (hits.groupBy("key").agg(F.bool_or("own").alias("own"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("id", "fa")).alias("who"))
            .filter("own AND size > 1").groupBy("who", "size").agg(F.min("key").alias("key")).select("key", "size"))
    return hits.drop("own").join(same, "key")


def _matched(prefix: list[np.ndarray], g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray, p: Params) -> np.ndarray:
    """Pairs of fitting sizes that share as many prefix shingles as the smaller level asks."""
    n, level = g["n"].to_numpy(), g["level"].to_numpy()
    ok = pairs & neardup.sized(n[x], n[y], p.percent)
    if ok.any():
        own = [u[:k] for u, k in zip(prefix, n - _need(n, p.percent) + level, strict=True)]
        ok &= neardup.intersections(own, x, y) >= np.minimum(level[x][:, None], level[y][None, :])
    return ok


def _bounded(prefix: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sets may share enough: below the lesser end of two prefixes
    all that is shared is known; of the rest at most the smaller one is."""
    full = np.iinfo(np.int64).max
    end = np.array([u[-1] if len(u) < k else full for u, k in zip(prefix, n, strict=True)], np.uint64)
    below = lambda a, b: np.stack([np.searchsorted(prefix[i], end[b]) for i in a])
    rest = np.minimum(n[x][:, None] - below(x, y), (n[y][:, None] - below(y, x)).T)
    return (100 + percent) * (neardup.intersections(prefix, x, y) + rest) >= percent * (n[x][:, None] + n[y][None, :])


def _first_met(g: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs for which this is the first of the buckets (``keys``) that hold both."""
    return neardup.intersections([k[k < key] for k, key in zip(g["keys"], g["key"], strict=True)], x, y) == 0


def _fitting(p: Params) -> Compare:
    """Marks members (key, id, fa, n, keys) with another of fitting size that they meet here first."""

    def what(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
        n = g["n"].to_numpy()
        ok = pairs & neardup.sized(n[x], n[y], p.percent)
        return marked(g, x, y, ok & _first_met(g, x, y) if ok.any() else ok)

    return what


def _candidates(p: Params, several: bool) -> Compare:
    """Marks members (key, id, fa, n, level, prefix, and for ``several``
    buckets keys) with a candidate. Shingles of prefixes have 4 bytes here: a
    false agreement can only make one candidate more."""

    def what(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
        prefix = [np.frombuffer(b, ">u4").astype(np.uint64) for b in g["prefix"]]
        ok = _matched(prefix, g, x, y, pairs, p)
        if ok.any():
            ok &= _bounded(prefix, g["n"].to_numpy(), x, y, p.percent)
        if ok.any() and several:
            ok &= _first_met(g, x, y)
        return marked(g, x, y, ok)

    return what


def _verified(p: Params) -> Compare:
    """Edges between members (key, id, fa, n, level, shingles): candidates that are similar."""

    def what(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
        sets = neardup.unpacked(g["shingles"])
        ok = _matched(sets, g, x, y, pairs, p)
        if ok.any():
            a, b = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            ok[np.ix_(a, b)] &= neardup.similar(sets, x[a], y[b], p.percent)
        return spanning(g, x, y, ok)

    return what


def jaccard_components(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (set size), component_id
    (smallest doc_id reachable over links, itself included).

    Two documents link if the Jaccard similarity of their sets is ``percent``
    or more. A text with fewer words than a shingle is one shingle; without
    words (or null) it has none and links with nothing. Letters A-Z compare in
    lower case. Rows with a null doc_id take no part (component null); rows
    sharing a doc_id are one document, linked through any of its texts.
    Columns other than the two named ones are not read. No rows give no rows.
    """
    values, edge, both = F.col("n"), "a long, b long", ["key", "id", "fa"]
    found = prefixes(docs, p, doc_id, text)
    rows = materialize(found.drop("prefix"), "rows")    # prefixes are worked out twice rather than written twice
    sets = (found.filter("n > 0 and doc_id is not null").groupBy("fa", "fb")
            .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    nodes = materialize(sets, "nodes")
    # of an id's only set the fingerprint needn't travel
    several = materialize(nodes.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_i")), "several")
    told = nodes.join(several, F.col("id") == F.col("_i"), "left").withColumn("fa", F.when(F.col("_i").isNull(), 0).otherwise(F.col("fa")))
    postings = _postings(told)
    df = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    sizes = told.select("id", "fa", "n")
    hits = materialize(_lookups(postings.join(df, "token"), sizes, p), "lookups")
    hits = materialize(_asked(hits).join(sizes, ["id", "fa"]), "hits")
    prefix = materialize(_shortened(told)
                         .join(hits.select("id", "fa").distinct(), ["id", "fa"], "left_semi"), "short")

    def full(member: DataFrame) -> DataFrame:
        of = neardup.sets_of(docs, member.select("id").distinct(), neardup.Params(shingle=p.shingle), doc_id, text)
        return of.join(several, F.col("id") == F.col("_i"), "left").withColumn("fa", F.when(F.col("_i").isNull(), 0).otherwise(F.col("fa"))).drop("_i")

    def verified(member: DataFrame, meet: Callable[..., DataFrame]) -> DataFrame:
        return materialize(meet(member, full(member), p.block, _verified(p), edge, values).distinct(), "links")

    first = hits.join(hits.groupBy("id", "fa").agg(F.max_by("key", F.struct("size", "key")).alias("key")), both)
    likely = materialize(inside(first, prefix, p.block, _candidates(p, False), neardup.MEMBER, values).distinct(), "likely")
    links = verified(first.join(likely, both), inside)
    left = materialize(unconnected(neardup.contracted(hits, links), p.block, values, all_parts=True), "unconnected")
    left = thinned(left, full, p.block, p.percent, values)
    if not left.isEmpty():
        # of its keys a member needs those before the bucket's
        keys = lambda rows: rows.groupBy("id", "fa").agg(F.collect_list("key").alias("keys"))
        below = {"keys": F.expr("filter(keys, k -> k < key)")}
        met = materialize(across(left, keys(left), p.block, _fitting(p), neardup.MEMBER, values, below).distinct(), "met")
        left = left.join(met, both)
        likely = materialize(across(left, prefix.join(keys(met), ["id", "fa"]), p.block, _candidates(p, True), neardup.MEMBER, values, below).distinct(), "likely")
        links = links.union(verified(once(left.join(likely, both)), across))
    return neardup.with_components(rows, nodes, links)
