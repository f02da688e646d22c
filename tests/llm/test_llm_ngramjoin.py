"""The n-gram Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import ngramjoin
from marketweave.llm.buckets import Block
from marketweave.llm.neardup import unpacked

SCHEMA = "doc_id long, text string, key string, n string, level string, component string, size string"


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def root(d):
        return d if up[d] == d else root(up[d])

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if a == b or 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return sorted((str(d), len(s), str(d if d is None else root(d))) for d, s in sets)


def rows_of(seed):
    """Clusters of edited copies around the threshold, chains, a passage most texts share, exact copies, odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage, rows = r.choices(vocab, k=60), []
    for g in range(14):
        base = r.choices(vocab, k=r.choice([1, 3, 4, 9, 60, 200, 500]))
        if g % 2:
            base[1:1] = passage
        t = list(base)
        for _ in range(r.choice([1, 2, 6, 30])):
            t = list(t if r.random() < 0.5 else base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((len(rows), " ".join(t) if r.random() < 0.8 else "\n".join(t).upper(), *["own"] * 5))
    rows += [(i, " ".join(passage), *["own"] * 5) for i in range(500, 520)]
    odd = [(1000, None), (1001, ""), (1002, " \t"), (1003, None), (None, rows[5][1]), (None, None), (1004, rows[-1][1]), (1005, "x y z")]
    odd += [(1006, " ".join(r.choices(vocab, k=8000)))]
    return [*rows, *[(d, t, *["own"] * 5) for d, t in odd], rows[7], rows[7]]


@pytest.mark.parametrize("p", [ngramjoin.Params(), ngramjoin.Params(block=Block(8, 4000)), ngramjoin.Params(percent=70, levels=(1,), block=Block(8, 10**6)),
                               ngramjoin.Params(shingle=2, percent=90, levels=(1, 2, 3, 40))])
def test_components_match_all_pairs(spark, p):
    rows = rows_of(p.percent)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = ngramjoin.jaccard_components(docs, p)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(a), b, str(c)) for a, b, c in out.collect()) == brute(rows, p.shingle, p.percent)


def test_crowded_buckets_are_thinned(spark, monkeypatch):
    """A passage that is most of many texts doesn't send each of them to every block."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(80)}" for _ in range(30)])) for i in range(150)]
    rows += [(1000 + i, " ".join([*rows[i][1].split()[:-1], "end"])) for i in range(0, 150, 10)]
    rows += [(2000 + i, " ".join(passage[:69] + [f"x{i % 4}"])) for i in range(4)]
    sent, real = [], ngramjoin.across

    def across(members, *more):
        sent.append(sum(c * max(1, -(-2 * n // 8)) for _, n, c in members.groupBy("key").agg(F.count("*"), F.count(F.when(~F.col("main"), 1))).collect()))
        return real(members, *more)

    monkeypatch.setattr(ngramjoin, "across", across)
    out = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngramjoin.Params(block=Block(8, 10**6)))
    assert sorted((str(a), b, str(c)) for a, b, c in out.collect()) == brute(rows, 4, 85)
    assert sum(sent) < 5 * len(rows)


def test_texts_of_one_id_and_no_rows(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, None), (9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(x), y, str(z)) for x, y, z in ngramjoin.jaccard_components(docs).collect()) == brute(rows, 4, 85)
    assert ngramjoin.jaccard_components(docs.limit(0)).collect() == []


def test_similar_sets_meet_at_the_smaller_level():
    """Any two similar sets look up a common shingle under the smaller of their levels, and pass both tests."""
    r = np.random.default_rng(2)
    p = ngramjoin.Params(levels=(1, 3, 9, 20))
    met = levels = 0
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 48, n).astype(np.uint64))
        keep = r.random(len(a)) > r.uniform(0, 0.12)
        b = np.unique(np.concatenate([a[keep], r.integers(0, 1 << 48, int(r.integers(0, 1 + n // 12))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if not len(b) or 100 * same < p.percent * (len(a) + len(b) - same):
            continue
        df = {int(t): int(r.choice([2, 2, 3, 50, 900])) for t in np.union1d(a, b)}
        looks = []
        for u, other in ((a, b), (b, a)):
            cut = u[:len(u) - ngramjoin._need(len(u), p.percent) + p.levels[-1]]
            # some shingles of the set are shared with third sets only
            held = np.flatnonzero(np.isin(cut, other) | (r.random(len(cut)) < 0.3))
            got = ngramjoin.chosen(len(u), held, np.array([df[int(t)] for t in cut[held]]), cut[held].astype(np.int64), p)
            assert got
            looks.append({m: set(cut[held][i].tolist()) for m, i in got})
        low = min(max(x) for x in looks)
        assert looks[0][low] & looks[1][low]
        ends = [u[:len(u) - ngramjoin._need(len(u), p.percent) + p.levels[-1]] for u in (a, b)]
        one = np.array([0])
        short = [np.frombuffer(ngramjoin._short(u.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()), ">u4").astype(np.uint64) for u in ends]
        assert all((x == u >> np.uint64(16)).all() for x, u in zip(short, ends, strict=True))
        assert ngramjoin._bounded(short, np.array([len(a), len(b)]), one, one + 1, p.percent).all()
        assert ngramjoin._bounded(ends, np.array([len(a), len(b)]), one, one + 1, p.percent).all()
        met, levels = met + 1, levels + (low > 1)
    assert met > 100 and levels > 30


def test_lengthening_drops_nodes_without_partner_and_frequent_shingles():
    p, place = ngramjoin.Params(), np.arange(30)
    few = ngramjoin.chosen(100, place[:10], np.full(10, 5), place[:10], p)
    assert few == []  # 10 shared shingles, 16 wanted of 31
    (low, _), *_, (high, look) = ngramjoin.chosen(100, place, np.where(place < 14, 10_000, 2), place, p)
    assert (low, high) == (1, 16) and min(look) == 14  # the frequent ones need no look
    assert len(ngramjoin.chosen(100, place, np.full(30, 2), place, p)) == 1


def test_postings_are_the_smallest_hashes(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(103)))], "doc_id long, text string")
    p = ngramjoin.Params()
    row = ngramjoin.prefixes(docs, p).first()
    (prefix,) = unpacked([row["prefix"]])
    assert row["n"] == 100 and len(prefix) == 100 - 85 + 16 and (np.diff(prefix.astype(np.int64)) > 0).all()
    nodes = spark.createDataFrame([(1, 2, 100, bytearray(row["prefix"]))], "id long, fa long, n long, prefix binary")
    got = sorted((r.place, r.token) for r in ngramjoin._postings(nodes).collect())
    assert got == list(enumerate(prefix.tolist()))
