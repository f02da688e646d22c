"""Crowded buckets thinned: their members meet at their rarest shingles.

Where what is not connected takes several half blocks of a bucket, ``across``
would send each member to many blocks. Two similar sets share one of the
rarest shingles of each, so buckets of those shingles lose no link; members
with too few shingles that any other holds have no partner and go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import Block, crowded, once, unconnected
from .shared import materialize


def unpacked(shingles: Iterable[bytes]) -> list[np.ndarray]:
    """Sorted sets from 6 bytes a shingle."""
    out = []
    for b in shingles:
        u = np.zeros((len(b) // 6, 8), np.uint8)
        u[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        out.append(u.view(np.uint64).ravel())
    return out


def postings(nodes: DataFrame, rows: int = 500) -> DataFrame:
    """(token, id, fa, place) of each shingle of each node's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                sets = unpacked(x.as_py() for x in b.column(2))
                size = np.array([len(u) for u in sets])
                row = pa.array(np.repeat(np.arange(len(sets)), size))
                token = np.concatenate(sets).astype(np.int64)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(token), *[b.column(k).take(row) for k in range(2)], pa.array(place.astype(np.int32))],
                                                 names=["token", "id", "fa", "place"])

    return nodes.select("id", "fa", "prefix").mapInArrow(run, "token long, id long, fa long, place int")


def rarest(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(key, id, fa) of the shingles of each set (id, fa, prefix: the full set; n of
    ``sizes``) that a similar one among them shares for sure: of its n shingles the
    n - need + 1 that fewest of the sets hold. Those that no other holds need no look.
    Keys are negative, so none is the key of a band."""
    found = postings(sets, 50)
    df = found.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("id", "fa")
    held = found.join(df, "token").join(sizes, ["id", "fa"]).withColumns({
        "rank": F.row_number().over(own.orderBy("df", "token")), "held": F.count("*").over(own)})
    need = F.ceil(F.col("n") * percent / 100)
    return held.filter(F.col("rank") <= F.col("held") - need + 1).select(F.xxhash64("token", F.lit("rare")).bitwiseOR(F.lit(-(1 << 63))).alias("key"), "id", "fa")


def thinned(left: DataFrame, full: Callable[[DataFrame], DataFrame], size: Block, percent: int, values: Column) -> DataFrame:
    """Members of crowded buckets by the rarest of all their shingles instead;
    ``full`` reads the sets (id, fa, shingles) of members."""
    crowd = materialize(crowded(left, size, values), "crowded")
    if crowd.isEmpty():
        return left
    member = materialize(left.join(crowd, "key").drop("key", "size", "main").distinct(), "crowd")
    sets = full(member).groupBy("id", "fa").agg(F.first("shingles").alias("prefix"))
    sets = materialize(sets.join(member.select("id", "fa"), ["id", "fa"], "left_semi"), "sets")
    rare = materialize(once(materialize(rarest(sets, member.select("id", "fa", "n"), percent), "rare")).join(member, ["id", "fa"]), "rare")
    rare = unconnected(rare, size, values, all_parts=True).select(left.columns)
    return materialize(left.join(crowd, "key", "left_anti").unionByName(rare), "unconnected")
