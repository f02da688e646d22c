"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketweave.llm import merkle

SCHEMA = "doc_id long, text string, source string, kept string, proof string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """(root, siblings of each node from the bottom up as (digit, others))."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k:k + 3]
            for d in range(len(run)):
                for i in at[k + d]:
                    paths[i].append((d, "".join(run[:d] + run[d + 1:])))
            up.append(sha("".join(run)))
            held.append([i for x in at[k:k + 3] for i in x])
        nodes, at = up, held
    return nodes[0], paths


def brute(rows):
    """(root, Counter of (doc_id, text, source, subroot, proof))."""
    by = defaultdict(list)
    for d, t, s, *_ in rows:
        by[s].append((d, t, leaf_of(d, s, t)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    subs = {s: tree([r[2] for r in by[s]]) for s in order}
    root, above = tree([subs[s][0] for s in order])
    return root, Counter((d, t, s, subs[s][0], tuple(p + above[k])) for k, s in enumerate(order)
                         for (d, t, _), p in zip(by[s], subs[s][1], strict=True))


def proved(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    m = merkle.build(docs.withColumn("leaf", merkle.digest(F.col("doc_id"), F.col("source"), F.col("text"))))
    out = merkle.prove(m, m.leaves).join(m.groups.select("sid", "subroot"), "sid")
    out = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    return m, out.select("kept.*", "subroot", "folded", F.col("proof").alias("path")).collect()


def odd_rows():
    r = random.Random(5)
    rows = [(i, f"text {i}é\n" * (i % 4), "hot" if i % 3 else r.choice(["a", "é", "z", "Z", ""]), "own", "own") for i in range(900)]
    rows += [(None, None, "hot", None, None), (None, "x", None, None, None), (7, "again", "hot", None, None), (7, "again", "hot", None, None),
             (5, "alone", "single", None, None), (950, "", None, None, None), (951, "long " * 50_000, "a", None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], [(i, "same", "one", None, None) for i in range(10)],
                                  [(3, "copy", "one", None, None)] * 300, [(i, None, f"s{i}", None, None) for i in range(4)]])
def test_proofs_match_a_plain_tree(spark, rows):
    root, want = brute(rows)
    m, out = proved(spark, rows)
    assert m.root == root
    assert all(r.folded == root for r in out)
    assert Counter((r.doc_id, r.text, r.source, r.subroot, tuple((s.digit, s.others) for s in r.path)) for r in out) == want
    assert Counter((r.kept, r.proof) for r in out) == Counter((k, p) for *_, k, p in rows)


def test_three_rounds_of_packs(spark):
    n = merkle.PACK * merkle.PACK + 5
    leaves = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    m = merkle.build(leaves)
    root, paths = tree([sha(str(i)) for i in range(n)])
    assert (m.root, len(m.trees)) == (root, 3)
    asked = m.leaves.filter("rank % 977 = 0").select("sid", "rank")
    got = {r["rank"]: [tuple(s) for s in r["proof"]] for r in merkle.prove(m, asked).collect()}
    assert got == {i: paths[i] for i in range(0, n, 977)}


def test_requests_for_some_leaves_and_none(spark):
    m, _ = proved(spark, odd_rows())
    hot = m.groups.filter("grp = 'hot'").first()["sid"]
    asked = spark.createDataFrame([(0, 0, "a"), (hot, 243, "b"), (hot, 243, "c"), (99, 0, "no such group"), (0, 10**6, "no such rank")], "sid long, rank long, grp string")
    got = merkle.prove(m, asked)
    assert got.columns == ["sid", "rank", "grp", "proof"]
    assert sorted(r.grp for r in got.collect()) == ["a", "b", "c"]


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    leaf = lambda text: merkle.digest(F.col("doc_id"), F.col("source"), text)
    m = merkle.build(docs.withColumns({"leaf": leaf(F.col("text")), "other": leaf(F.replace("text", F.lit("\n"), F.lit("")))}))
    out = merkle.prove(m, m.leaves).select(F.contains("kept.text", F.lit("\n")).alias("cut"), (merkle.fold(F.col("kept.other"), F.col("proof")) == m.root).alias("ok"))
    assert all(r.ok != bool(r.cut) for r in out.collect())


def test_no_rows(spark):
    m = merkle.build(spark.createDataFrame([], "doc_id long, source string, leaf string"))
    assert m.root is None
    assert merkle.prove(m, m.leaves).collect() == [] and m.groups.collect() == []


def test_digest_fields():
    assert leaf_of(12, None, "é\n") == sha("2:12-3:é\n")
