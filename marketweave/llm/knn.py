"""Exact top-k inner products through a pivot-distance index.

Vectors get one more coordinate so that a larger inner product is a smaller
distance. Each is keyed by its nearest pivot and the distance to it; a pivot's
vectors are sorted into rings (annuli) of distances, and large annuli are dealt
into chunks of bounded size. A query is first compared with its nearest
annulus; its k-th score so far and the triangle inequality then rule out every
annulus that can hold nothing better, and the rest are compared exactly, in
integers. Queries travel in blocks; an annulus of a third of all vectors is
many chunks, each joined by its own key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize


@dataclass(frozen=True)
class Params:
    """The index is fitted on at most ``sample`` vectors (chosen by hash) and
    holds every vector. ``scale``: components become floor(scale * x)."""

    k: int = 5
    scale: int = 256
    pivots: int = 32
    rings: int = 8
    sample: int = 4096
    chunk: int = 4096
    block: int = 256


def _integers(vectors: DataFrame, p: Params, vec_id: str, vector: str) -> DataFrame:
    """(row, id, x, norm2, top): integer vectors as bytes of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(p.scale * v)
                if len(v) and np.abs(v).max() >= 2.0 ** 63:
                    raise OverflowError(f"vector {i}: a component doesn't fit 64 bits")
                rows.append((row, i, v.astype(np.int64).tobytes(), float((v * v).sum()), float(np.abs(v).max(initial=0)), len(v)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int32()), strict=True)],
                                                 names=["row", "id", "x", "norm2", "top", "dim"])

    return (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x"))
            .mapInArrow(run, "row long, id long, x binary, norm2 double, top double, dim int"))


def _matrix(blobs, dim: int) -> np.ndarray:
    """Rows of 64-bit integers, shorter vectors ended by zeros."""
    if all(len(b) == 8 * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), dim)
    out = np.zeros((len(blobs), dim), np.int64)
    for r, b in enumerate(blobs):
        out[r, :len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _distances(x: np.ndarray, norm2: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots (one more coordinate each)."""
    d2 = (norm2 + extra ** 2)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * (x.astype(np.float64) @ pivots[:, :-1].T + np.outer(extra, pivots[:, -1]))
    return np.sqrt(np.maximum(d2, 0))


def _fit(x: np.ndarray, norm2: np.ndarray, most2: float, n: int) -> np.ndarray:
    """Pivots: a few rounds of k-means over the sample."""
    full = np.column_stack([x, np.sqrt(np.maximum(most2 - norm2, 0))])
    pivots = np.unique(full, axis=0)
    pivots = pivots[np.random.default_rng(5).permutation(len(pivots))[:n]]
    for _ in range(5):
        near = _distances(x, norm2, full[:, -1], pivots).argmin(axis=1)
        pivots = np.array([full[near == j].mean(axis=0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def exact_top_k(vectors: DataFrame, queries: Column, p: Params = Params(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds,
    the k largest integer inner products with other vectors (all, if fewer),
    ties to the smaller id.

    Rows with a null id, a null vector, or null or non-finite components take
    no part; shorter vectors count as ended by zeros. Repeated ids are
    candidates each, never of a query of that id; a repeated query gives its
    rows once, those of its vector of smallest bytes. Scores beyond 64 bits raise an error. Other columns are not
    read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    ints = materialize(_integers(vectors, p, vec_id, vector), "integers")
    most2, dim = ints.agg(F.max("norm2"), F.max("dim")).first()
    if most2 is None:
        return spark.createDataFrame([], result)
    dim = max(dim, 1)
    picked = ints.orderBy(F.xxhash64("id", "row"), "row").limit(p.sample).toPandas()
    pivots = _fit(_matrix(list(picked["x"]), dim), picked["norm2"].to_numpy(), most2, p.pivots)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                n2 = f["norm2"].to_numpy()
                d = _distances(_matrix(list(f["x"]), dim), n2, np.sqrt(np.maximum(most2 - n2, 0)), pivots)
                near = d.argmin(axis=1)
                yield f[["row", "id", "x", "norm2"]].assign(pivot=near.astype("int32"), d=d[np.arange(len(f)), near])

    keyed = materialize(ints.select("row", "id", "x", "norm2").mapInPandas(assign, "row long, id long, x binary, norm2 double, pivot int, d double"), "keyed")
    cuts = {r["pivot"]: r["q"] for r in keyed.groupBy("pivot").agg(
        F.percentile_approx("d", [i / p.rings for i in range(1, p.rings)]).alias("q")).collect()}  # pivots x rings numbers
    edges = F.create_map(*[c for k, q in cuts.items() for c in (F.lit(k), F.array(*map(F.lit, q)) if q else F.array().cast("array<double>"))])
    ringed = keyed.withColumn("ring", F.size(F.filter(edges[F.col("pivot")], lambda e: e < F.col("d"))))
    annuli = ringed.groupBy("pivot", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).toPandas()  # pivots x rings rows
    annuli["chunks"] = -(-annuli["n"] // p.chunk)
    chunks = F.create_map(*[F.lit(int(v)) for r in annuli.itertuples() for v in (r.pivot * p.rings + r.ring, r.chunks)])
    index = (ringed.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks[F.col("pivot") * p.rings + F.col("ring")]).cast("int"))
             .groupBy("pivot", "ring", "chunk").agg(F.collect_list("id").alias("ids"), F.collect_list("x").alias("xs")))
    index = materialize(index, "index")
    slack = 1e-6 * (1 + np.sqrt(most2))
    lo, hi, at = annuli["lo"].to_numpy(), annuli["hi"].to_numpy(), annuli["pivot"].to_numpy()

    def bounds(f: pd.DataFrame) -> np.ndarray:
        """Least distance of each query to each annulus, by the triangle inequality."""
        n2 = f["norm2"].to_numpy()
        d = _distances(_matrix(list(f["x"]), dim), n2, np.zeros(len(f)), pivots)[:, at]
        return np.maximum(np.maximum(lo - d, d - hi) - slack, 0)

    def sent(f: pd.DataFrame, which: np.ndarray, least: np.ndarray) -> Iterator[pd.DataFrame]:
        for a in np.flatnonzero(which.any(axis=0)):
            r = annuli.iloc[a]
            rows = np.flatnonzero(which[:, a])
            for b in range(0, len(rows), p.block):
                g = rows[b:b + p.block]
                n = int(r["chunks"])
                yield pd.DataFrame({"pivot": np.full(n, r["pivot"], np.int32), "ring": np.full(n, r["ring"], np.int32), "chunk": np.arange(n, dtype=np.int32),
                                    "q_ids": [f["id"].to_numpy()[g]] * n, "q_xs": [list(f["x"].iloc[g])] * n, "q_least": [least[g]] * n})

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                b = bounds(f)
                home = np.zeros(b.shape, bool)
                home[np.arange(len(f)), b.argmin(axis=1)] = True
                yield from sent(f, home, np.full(len(f), np.iinfo(np.int64).min))

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                b = bounds(f)
                kth = f["kth"].to_numpy()
                reach2 = np.where(f["found"].to_numpy() >= p.k, f["norm2"].to_numpy() + most2 - 2.0 * kth, np.inf)
                open_ = b ** 2 <= reach2[:, None] * (1 + 1e-9)
                open_[np.arange(len(f)), b.argmin(axis=1)] = False
                yield from sent(f, open_, kth)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, ids = np.array(r["q_ids"]), np.array(r["ids"])
                s = _products(_matrix(r["q_xs"], dim), _matrix(r["xs"], dim))
                out = []
                for i in range(len(q)):
                    ok = np.flatnonzero((s[i] >= r["q_least"][i]) & (ids != q[i]))
                    if len(ok) > p.k:
                        kth = np.partition(s[i][ok], len(ok) - p.k)[len(ok) - p.k]
                        ok = ok[s[i][ok] >= kth]
                        ok = ok[np.lexsort((ids[ok], -s[i][ok]))[:p.k]]
                    out.append((np.full(len(ok), q[i]), ids[ok], s[i][ok]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    block = "pivot int, ring int, chunk int, q_ids array<long>, q_xs array<binary>, q_least array<long>"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(blocks: DataFrame) -> DataFrame:
        # neither side has a bound: blocks hold a query once for each open ring
        scored = blocks.join(index.hint("merge"), ["pivot", "ring", "chunk"]).select("q_ids", "q_xs", "q_least", "ids", "xs").mapInArrow(compare, "query_id long, vec_id long, score long")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k)

    # queries that lie together share blocks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = (keyed.withColumnRenamed("id", vec_id).filter(queries).withColumnRenamed(vec_id, "id")
             .groupBy("id").agg(F.min(F.struct("x", "norm2", "pivot", "d")).alias("v")).select("id", "v.*"))
    asked = materialize(asked, "queries")
    together = lambda d: d.repartitionByRange(n, "pivot", "d", "id")
    home = materialize(top(together(asked).select("id", "x", "norm2").mapInPandas(first, block)), "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    none = np.iinfo(np.int64).min
    left = (together(asked.join(kth, asked["id"] == kth["query_id"], "left"))
            .select("id", "x", "norm2", F.coalesce("found", F.lit(0)).alias("found"),
                    F.when(F.col("found") >= p.k, F.col("kth")).otherwise(F.lit(int(none))).alias("kth")))
    both = home.drop("rank").union(top(left.mapInPandas(rest, block)).drop("rank"))
    return (both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
