"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketweave.llm import spelling, textbytes

SCHEMA = "doc_id long, text string, word string, n string, id string, h string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, p):
    n = Counter()
    for d, t, *_ in rows:
        for run in RUN.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if p.rate and h % p.rate == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= p.least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= p.count}
    other = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            other[a].append(b)
            other[b].append(a)
    form = {}
    for w, o in other.items():
        best = min(o, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= p.lead * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(other[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(seed=3):
    r = random.Random(seed)
    base = ["".join(r.choices("abceéßÀ÷", k=r.randint(6, 11))) for _ in range(40)]

    def edit(w):
        i, c = r.randrange(len(w) + 1), r.choice("abcé")
        return r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])

    rows = []
    for i in range(150):
        text = [w.upper() if r.random() < 0.1 else w if r.random() < 0.8 else edit(w if r.random() < 0.7 else edit(w)) for w in r.choices(base, k=60)]
        rows.append((i, "".join(w + r.choice([" ", "\n", "1", "-", "Ā", "×"]) for w in text), "own", "own", "own", "own"))
    long = "abcé" * 400
    chain = "chainabb " * 400 + "chainaab " * 30 + "chainaaa " * 2
    rows += [(i, chain, None, None, None, None) for i in range(910, 915)]
    return [*rows, rows[3], (None, rows[5][1], None, None, None, None), (900, None, None, None, None, None), (901, "", None, None, None, None),
            (902, f"{long} {long} {long}a {long}a {long[1:]} {long[1:]}", None, None, None, None), (903, ("a" * 9 + " ") * 30 + ("a" * 10 + " ") * 3, None, None, None, None)]


@pytest.mark.parametrize("p", [spelling.Params(), spelling.Params(rate=3, lead=3), spelling.Params(symbols=(2, 2), rate=0), spelling.Params(map_bits=8)])
def test_variants_match_brute_force(spark, p):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spelling.spelling_variants(docs, p)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    want = brute(rows, p)
    assert len(got) == len(want) and set(got) == want
    assert any(f for _, f, *_ in want) and any(f != r for _, f, r, *_ in want if f)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == []
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "y")], "word string, form string")
    assert dict(map(tuple, spelling._roots(forms).collect())) == {**{f"w{i}": "w9" for i in range(9)}, "x": "y"}


def test_crc32_continues_each_prefix():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    a = r.integers(0, 4900, 300)
    b = a + r.integers(0, 90, 300)
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    want = [zlib.crc32(b"%d:" % i + data[x:y].tobytes()) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    assert spelling.crc32_of(data, a, b, before).tolist() == want


def test_a_neighbourhood_is_every_string_one_edit_away_once():
    words, q = ["aabbaé", "abcabcab", "zzzz", "é", "abc"], 3
    (s,) = textbytes.slices(pa.array(words))
    r = spelling._Reduced(s, q)
    got = [[] for _ in words]
    for row, h in r.neighbours(q):
        for i, x in zip(row, h, strict=True):
            got[i].append(int(x))
    for i in range(len(words)):
        x = [int(v) for v in r.symbol[r.off[i]:r.off[i + 1]]]
        want = {tuple(x)}
        for k in range(len(x) + 1):
            want |= {(*x[:k], c, *x[k:]) for c in range(1, q + 1)}
            if k < len(x):
                want |= {(*x[:k], *x[k + 1:])} | {(*x[:k], c, *x[k + 1:]) for c in range(1, q + 1)}
        hashed = [int(textbytes.mix(np.array([sum(v * pow(r.BASE, j, 1 << 64) for j, v in enumerate(t)) % (1 << 64)], np.uint64))[0]) for t in want]
        assert sorted(got[i]) == sorted(hashed)


def test_more_symbols_for_a_crowded_vocabulary(spark):
    r = random.Random(1)
    words = spark.createDataFrame([("".join(r.choices("abcdefghijklmnopqrst", k=7)),) for _ in range(3000)], "word string").distinct()
    words = words.withColumn("id", F.xxhash64("word"))
    few, many = (spelling.alphabet(w, spelling.Params(symbols=(2, 4, 8, 16, 64))) for w in (words.limit(5), words))
    assert few < many < 64
