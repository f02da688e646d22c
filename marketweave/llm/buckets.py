"""Members of buckets compared with each other, in blocks of bounded size.

A bucket (rows of one ``key``) may hold any number of members. First each is
dealt into parts and compared inside them (``inside``); what links contracts to
components. Then only the members outside a bucket's largest component still
meet the rest of it, block by block (``across``): a bucket of copies is sent
once, not once for each of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is done with a frame: places of one and the other side, which pairs count.
Compare = Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


@dataclass(frozen=True)
class Block:
    """At most ``members``, and ``values`` of them, meet at once."""

    members: int = 1024
    values: int = 2_000_000


def _blocks(values: Column, size: Block) -> Column:
    return F.greatest(F.count("*") / size.members, F.sum(values) / size.values)


def _run(dealt: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``one`` over the rows of each (key, i, j), streamed in that order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            by = f[["key", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1)]
            out = [one(f.iloc[s:t].reset_index(drop=True)) for s, t in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = f.iloc[cuts[-1]:]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest):
            yield one(rest.reset_index(drop=True))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, schema)


def inside(rows: DataFrame, load: DataFrame, size: Block, what: Compare, schema: str, values: Column) -> DataFrame:
    """``what`` over each part of each bucket. Rows: key, id, fa (which deal
    them, anew in every bucket), and what ``values``, those of a row, reads;
    ``load`` (id, fa, ...) and ``parts``, those of its bucket, are added to a row that is dealt."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        all_ = np.arange(len(g))
        return what(g, all_, all_, all_[:, None] < all_[None, :])

    parts = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(_blocks(values, size))).alias("parts"))
    dealt = rows.join(parts, "key").withColumns({"i": F.pmod(F.xxhash64("id", "fa", "key"), F.col("parts")), "j": F.lit(0).cast("long")})
    return _run(dealt.join(load, ["id", "fa"]), one, schema)


def unconnected(rows: DataFrame, size: Block, values: Column, all_parts: bool = False) -> DataFrame:
    """Rows (with ``component``) of the buckets of two and more components that
    took several parts (``all_parts``: or one), with ``main``: whether in the bucket's largest."""
    held = rows.groupBy("key", "component").agg(F.count("*").alias("c"), _blocks(values, size).alias("b"))
    wide = (held.groupBy("key").agg(F.count("*").alias("of"), F.sum("b").alias("b"), F.max_by("component", F.struct("c", "component")).alias("main"))
            .filter("of > 1" if all_parts else "of > 1 AND b > 1"))
    return rows.join(wide.select("key", F.col("main").alias("_main")), "key").withColumn("main", F.col("component") == F.col("_main")).drop("_main")


def _cuts(rows: DataFrame, size: Block, values: Column) -> DataFrame:
    """(key, nj, ni): half blocks that the members of each bucket take, and those outside its main component."""
    half = lambda b: F.greatest(F.lit(1), F.ceil(2 * b))
    few = F.when(~F.col("main"), 1)
    return rows.groupBy("key").agg(half(_blocks(values, size)).alias("nj"), half(F.greatest(
        F.count(few) / size.members, F.coalesce(F.sum(F.when(~F.col("main"), values)), F.lit(0)) / size.values)).alias("ni"))


def crowded(rows: DataFrame, size: Block, values: Column) -> DataFrame:
    """Keys of the buckets that ``across`` would send many times over: what is
    outside the main component (``main`` false) takes several half blocks."""
    return _cuts(rows, size, values).filter("ni > 1").select("key")


def across(rows: DataFrame, load: DataFrame, size: Block, what: Compare, schema: str, values: Column, then: dict[str, Column] | None = None) -> DataFrame:
    """``what`` over the members outside a bucket's main component (``main``
    false) against all its members of other components, in blocks; else like ``inside``.
    ``then``: columns of a row and its load, worked out before it is sent."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        left = g["outer"].to_numpy()
        x, y, c = np.flatnonzero(left), np.flatnonzero(~left), g["component"].to_numpy()
        return what(g, x, y, c[x][:, None] != c[y][None, :])

    cuts = _cuts(rows, size, values)
    dealt = rows.join(cuts, "key")
    place = lambda n, salt: F.pmod(F.xxhash64("id", "fa", F.lit(salt)), F.col(n))
    every = dealt.withColumns({"outer": F.lit(False), "j": place("nj", 1), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1))})
    outer = dealt.filter("NOT main").withColumns({"outer": F.lit(True), "i": place("ni", 2), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1))})
    sent = every.unionByName(outer).drop("ni", "nj")
    return _run(sent.join(load, ["id", "fa"]).withColumns(then or {}), one, schema)


def once(members: DataFrame) -> DataFrame:
    """Buckets (key, id, fa, ...) of two and more members, equal ones once; ``size`` is added."""
    same = (members.groupBy("key").agg(F.sum(F.xxhash64("id", "fa").cast("decimal(38,0)")).alias("s"), F.count("*").alias("size"))
            .filter("size > 1").groupBy("s", "size").agg(F.min("key").alias("key")).select("key", "size"))
    return members.drop("size").join(same, "key")


def spanning(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, link: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) between ids that join what the links x to y connect: one for each member but a first."""
    label = np.arange(len(g))
    while link.any():
        new = label.copy()
        np.minimum.at(new, x, np.where(link, label[y][None, :], len(g)).min(axis=1, initial=len(g)))
        np.minimum.at(new, y, np.where(link, label[x][:, None], len(g)).min(axis=0, initial=len(g)))
        if (new == label).all():
            break
        label = new
    ids = g["id"].to_numpy()
    some = label != np.arange(len(g))
    return pd.DataFrame({"a": ids[label[some]], "b": ids[some]})


def marked(g: pd.DataFrame, x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> pd.DataFrame:
    """The members (key, id, fa) with a pair that is ok."""
    hit = np.zeros(len(g), bool)
    hit[x] |= ok.any(axis=1)
    hit[y] |= ok.any(axis=0)
    return g.loc[hit, ["key", "id", "fa"]]
