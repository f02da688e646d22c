"""Merkle manifest of a dataset as a content-addressed DAG.

A row's leaf is a digest of its fields. The leaves of a group ascend by an
order column and every three consecutive nodes become one, level by level, up
to the group's subroot; the subroots, in the order of the groups, likewise
give the root. The DAG is kept as digest -> children records, in packs of five
levels (243 nodes), so a tree of 10**10 leaves is built, and descended, in five
rounds of joins and no task holds more of it than a few packs.

A proof is found by descent: from the root, each pack is looked up by its top's
digest; inside it a request follows the base-3 digits of its rank through the
records and collects the children it doesn't select. Requests below one pack
share its path until they part. The segments found from the root down, reversed,
are the proof from the leaf up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.rank import global_rank
from .shared import materialize, small

#: Children of a node; levels and nodes of a pack.
FAN, LEVELS = 3, 5
PACK = FAN ** LEVELS

_STEP = "struct<digit: int, others: string>"
_PACKED = "grp long, idx long, n long, top string, levels int, records array<struct<digest: string, children: array<string>>>"


def digest(*fields: Column) -> Column:
    """Lower-case hex sha256 of fields: each ``-`` if null, else its UTF-8
    byte count, ``:`` and its value (integers decimal)."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the ``proof`` (from the leaf up) give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(
        F.substring(s["others"], F.lit(1), 64 * s["digit"]), node, F.substr(s["others"], 64 * s["digit"] + 1)), 256))


@dataclass(frozen=True)
class Manifest:
    """``root`` (null for no leaves); ``groups`` (sid, group, n, subroot, rounds: of packs);
    ``leaves`` (sid, rank, leaf and the columns given); ``tops`` and ``trees``:
    the packs over the subroots and over the leaves, lowest round first."""

    root: str | None
    groups: DataFrame
    leaves: DataFrame
    tops: list[DataFrame]
    trees: list[DataFrame]


def _packs(nodes: DataFrame) -> DataFrame:
    """Packs over nodes (grp, idx, n: nodes of the group, node: digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, idx, n, held = (c[i].as_py() for c in batch.columns)
                level = [x["node"] for x in sorted(held, key=lambda x: x["idx"])]
                levels, records = 0, []
                while levels < LEVELS if n > PACK else len(level) > 1:
                    runs = [level[k:k + FAN] for k in range(0, len(level), FAN)]
                    level = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
                    records += [{"digest": d, "children": r} for d, r in zip(level, runs, strict=True)]
                    levels += 1
                row = {"grp": grp, "idx": idx, "n": n, "top": level[0], "levels": levels, "records": records}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    record = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])
    schema = pa.schema([("grp", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("top", pa.string()),
                        ("levels", pa.int32()), ("records", pa.list_(record))])
    held = nodes.groupBy("grp", F.floor(F.col("idx") / PACK).alias("idx")).agg(
        F.first("n").alias("n"), F.collect_list(F.struct("idx", "node")).alias("held"))
    return held.mapInArrow(run, _PACKED)


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Packs by round over groups of at most ``most`` nodes, and the single
    node left of each group: (grp, node, rounds)."""
    packs, ends, done = [], nodes.filter("n = 1").select("grp", "node", F.lit(0).alias("rounds")), 0
    while most > 1:
        packs.append(materialize(_packs(nodes.filter("n > 1")), "packs"))
        done, most = done + 1, -(-most // PACK)
        nodes = packs[-1].select("grp", "idx", F.ceil(F.col("n") / PACK).alias("n"), F.col("top").alias("node"))
        ends = ends.union(nodes.filter("n = 1").select("grp", "node", F.lit(done).alias("rounds")))
    return packs, ends


def build(leaves: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf") -> Manifest:
    """The manifest of ``leaves`` (a digest in column ``leaf``; any others are kept).

    Each row is a leaf, repeated rows too. Groups are ordered bytewise, null
    first and a group of its own; leaves by ``order`` (null first), then by
    digest, so ties don't matter. A group of one leaf has it as subroot; one
    group's subroot is the root; no rows have a null root. Other columns may
    have any names: they travel in a struct, ``kept``.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in leaves.columns])
    rows = materialize(leaves.select(kept.alias("kept"), F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("by"), F.col(f"`{leaf}`").alias("leaf")), "leaves")
    placed = global_rank(rows, [F.asc_nulls_first("grp"), F.asc_nulls_first("by"), "leaf"], "place").drop("by")
    groups = placed.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = materialize(global_rank(groups, ["first"], "sid").withColumn("sid", F.col("sid") - 1), "groups")
    most, n_groups = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if not n_groups:
        return Manifest(None, groups.selectExpr("sid", "grp", "n", "'' AS subroot", "0 AS rounds"), placed.selectExpr("0L AS sid", "0L AS rank", "leaf", "kept"), [], [])
    place = small(groups.select(F.col("grp").alias("_g"), "sid", "first", "n"))
    own = placed.join(place, F.col("grp").eqNullSafe(F.col("_g"))).withColumn("rank", F.col("place") - F.col("first"))
    trees, ends = _grow(own.select(F.col("sid").alias("grp"), F.col("rank").alias("idx"), "n", F.col("leaf").alias("node")), most)
    ends = materialize(ends, "subroots")
    tops, root = _grow(ends.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "node"), n_groups)
    groups = groups.join(ends.select(F.col("grp").alias("sid"), F.col("node").alias("subroot"), "rounds"), "sid").select("sid", "grp", "n", "subroot", "rounds")
    return Manifest(root.first()["node"], groups, own.select("sid", "rank", "leaf", "kept"), tops, trees)


def _descend(records: dict[str, list[str]], top: str, levels: int, rank: int) -> tuple[str, list[dict]]:
    """The node at ``rank`` below ``top``, and the segment of the path to it, top first."""
    node, path = top, []
    for level in range(levels - 1, -1, -1):
        digit = rank // FAN ** level % FAN
        children = records[node]
        path.append({"digit": digit, "others": "".join(children[:digit] + children[digit + 1:])})
        node = children[digit]
    return node, path


_PATH = pa.list_(pa.struct([("digit", pa.int32()), ("others", pa.string())]))


def _open(found: DataFrame, packs: DataFrame) -> DataFrame:
    """From packs' tops (grp, idx, node, path) to all their lowest nodes, likewise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, idx, top, path, levels, records = (c[i].as_py() for c in batch.columns)
                by, inner = {r["digest"]: r["children"] for r in records}, {r["digest"] for r in records}
                low = sum(len(r["children"]) for r in records if r["children"][0] not in inner)
                nodes = [_descend(by, top, levels, k) for k in range(low)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * low, pa.int64()), pa.array(range(idx * PACK, idx * PACK + low), pa.int64()),
                     pa.array([n for n, _ in nodes]), pa.array([path + p for _, p in nodes], _PATH)], names=["grp", "idx", "node", "path"])

    held = packs.select(F.col("top").alias("node"), "levels", "records").dropDuplicates(["node"])
    both = found.join(held, "node").select("grp", "idx", "node", "path", "levels", "records")
    return both.mapInArrow(run, f"grp long, idx long, node string, path array<{_STEP}>")


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (sid, rank, and any others; each leaf a bounded number of
    times) that name a leaf, with ``proof``: (digit, others: the other
    children's digests in a row) of each level, from the leaf to the root."""
    spark = requests.sparkSession
    empty_type = DataType.fromDDL(f"array<{_STEP}>")
    empty = F.from_json(F.lit("[]"), empty_type)
    if m.root is None:
        return requests.limit(0).withColumn("proof", empty)
    wanted = lambda found, width: found.join(
        requests.select(F.col("sid").alias("grp"), F.floor(F.col("rank") / width).alias("idx")).distinct(), ["grp", "idx"], "left_semi")
    found = spark.createDataFrame([(0, 0, m.root)], "grp long, idx long, node string").withColumn("path", empty)
    for packs in reversed(m.tops):
        found = _open(found, packs)
    starts = materialize(found.join(m.groups.select(F.col("sid").alias("idx"), "rounds"), "idx")
                         .select(F.col("idx").alias("grp"), F.lit(0).cast("long").alias("idx"), "node", "path", "rounds"), "starts")
    found = starts.filter("false").drop("rounds")
    for k in range(len(m.trees), 0, -1):
        found = wanted(found.union(starts.filter(F.col("rounds") == k).drop("rounds")), PACK ** k)
        if k > 1:
            found = materialize(_open(found, m.trees[k - 1]), "descent")
    asked = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("asked")
    rows = requests.select(F.col("sid").alias("grp"), F.col("rank").alias("_rank"), asked)
    single = rows.filter("_rank = 0").join(starts.filter("rounds = 0").drop("idx", "rounds"), "grp").select("asked", F.reverse("path").alias("proof"))
    if not m.trees:
        return single.select("asked.*", "proof")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ranks, top, path, levels, records = (c[i].as_py() for c in batch.columns[1:])
                by = {r["digest"]: r["children"] for r in records}
                proofs = [(path + _descend(by, top, levels, r % PACK)[1])[::-1] for r in ranks]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(proofs, _PATH)], names=["asked", "proof"])

    low = m.trees[0].select(F.col("top").alias("node"), "levels", "records").dropDuplicates(["node"])
    opened = found.join(low, "node").select("grp", "idx", "node", "path", "levels", "records")
    sizes = m.groups.filter("n > 1").select(F.col("sid").alias("grp"), "n")
    many = (rows.join(small(sizes), "grp").filter("_rank >= 0 AND _rank < n")
            .groupBy("grp", F.floor(F.col("_rank") / PACK).alias("idx")).agg(F.collect_list(F.struct("asked", "_rank")).alias("a")))
    both = many.join(opened, ["grp", "idx"]).select(F.col("a.asked").alias("asked"), F.col("a._rank").alias("ranks"), "node", "path", "levels", "records")
    proved = StructType([rows.schema["asked"], StructField("proof", empty_type)])
    return single.union(both.mapInArrow(run, proved)).select("asked.*", "proof")
