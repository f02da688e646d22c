"""The operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import buckets, chat, components, knn, linededup, mixing, neardup, packing, pii, quality, substring, textbytes, toxicity
from marketweave.llm.queries import word_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside or add.
CLASH = ["kept", "n", "n_words", "spans", "_row", "_text", "rest", "score", "key", "_k", "_drop", "n_lines", "more", "max_word_length"]


def words(t):
    return WORD.findall(t or "")


def corpus(n=60, seed=1):
    """Rows with nulls, empty and long texts, exact and near copies, repeated passages and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(300)]
    text = lambda k: "".join(w + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in r.choices(vocab, k=k))
    rows, base, shared = [], text(120), text(50)
    for i in range(n):
        kind = i % 10
        t = (text(r.randint(1, 90)) if kind < 4 else base if kind == 4 else base.replace(" ", f" x{i} ", 1) if kind == 5
             else text(10) + shared + text(5) if kind == 6 else (None, "", " \n\t ", "one")[i // 10 % 4] if kind == 7
             else base.upper() if kind == 8 else text(30) + "\nsame line\n" + text(30) + "\nsame line")
        rows.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t or "")))
    return [*rows, rows[4], rows[16], (900, text(9000), "en", "a", 1), (901, "x " * 300, "en", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()
    d.count()
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, d):
    from pyspark.sql import functions as F
    return d.withColumns({c: F.lit(f"own {c}") for c in CLASH})


# textbytes


def test_words_and_windows_match_python():
    import pyarrow as pa
    texts = [t for _, t, *_ in corpus()]
    for size in (1, 200, 1 << 20):
        got, seen = [], {}
        for s in textbytes.slices(pa.array(texts), max_bytes=size):
            raw = s.data.tobytes()
            for i in range(s.rows):
                got.append([raw[a:b].decode() for a, b in zip(s.ws[s.dw[i]:s.dw[i + 1]], s.we[s.dw[i]:s.dw[i + 1]])])
            at, h = s.windows(3)
            for a, x in zip(at, h):
                seq = tuple(raw[s.ws[k]:s.we[k]] for k in range(a, a + 3))
                assert seen.setdefault(int(x), seq) == seq
        assert got == [words(t) for t in texts]
        assert len(set(seen.values())) == len(seen)


# 1 mixing


def _shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        left = sum(w[s] for s in order if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / left for s in order}
        more = {s for s in order if s not in capped and t[s] > most * sizes[s]}
        if not more:
            return t
        capped |= more


@pytest.mark.parametrize("per_bucket", [4000, 7])
def test_mixing_meets_targets_and_repeats_itself(spark, docs, per_bucket):
    p = mixing.Params(block=16, shard=8, per_bucket=per_bucket)
    a = mixing.mix_counts(docs, p).toPandas()
    assert sorted(map(str, a.values.tolist())) == sorted(map(str, mixing.mix_counts(docs.repartition(7), p).toPandas().values.tolist()))
    texts = Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    assert Counter(zip(a.doc_id, a["size"])) == texts
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    target = _shares(sizes)
    for s, g in a.groupby(a.source.fillna("none")):
        s = None if s == "none" else s
        assert g.source_size.iloc[0] == sizes[s] and math.isclose(g.target.iloc[0], target[s])
        assert abs(g.taken.sum() - target[s]) <= 1
    assert (a.taken <= 3 * a["size"]).all()


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 3, "c": 900}, {"a": 10}, {"a": 0, "b": 7}, {"a": 5, "b": 5000, None: 1, "d": 2}])
def test_targets_are_capped_and_reshared(spark, sizes):
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(d).collect()}
    want = _shares(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 3, 17, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != sorted(got)


def test_mixed_documents_hold_what_the_counts_say(spark, docs, empty):
    p = mixing.Params(block=16, shard=8, per_bucket=9)
    d = clashing(spark, docs.dropDuplicates(["doc_id"]))
    out = mixing.mix_documents(d, p)
    assert out.columns == d.columns
    rows = out.collect()
    text = {r.doc_id: r.text for r in d.collect()}
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += len(words(r.text))
        assert r.text == text[r.doc_id] or " ".join(words(r.text)) == r.text
        assert set(words(r.text)) <= set(words(text[r.doc_id])) and r.kept == "own kept" and r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mixing.mix_counts(d, p).collect()}
    assert all(taken[k] == v for k, v in want.items())
    assert mixing.mix_documents(empty).count() == 0 and mixing.mix_counts(empty).count() == 0


# 2 toxicity


def test_gradients_match_differences():
    p = toxicity.Params(hidden=3, word_dim=2, gram_dim=2, attention=2, window=5, grams=16)
    net, r = toxicity.Network(p, 4), np.random.default_rng(0)
    x, mask, y = r.normal(size=(5, 3, 4)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0

    def loss():
        logit = net.logits(net.projection(x), mask)
        return float(np.mean(np.log1p(np.exp(-logit * (2 * y - 1)))))

    grad, d_x = net.gradients(x, mask, y)
    for w, g in [(net.w[k], grad[k]) for k in grad] + [(x, d_x)]:
        for i in np.ndindex(w.shape):
            old = w[i]
            w[i] = old + 1e-5
            a = loss()
            w[i] = old - 1e-5
            b = loss()
            w[i] = old
            assert abs((a - b) / 2e-5 - g[i]) < 1e-6


def test_windows_overlap_and_cover():
    p = toxicity.Params()
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = toxicity._starts(n, p)
        assert set(range(n)) <= {i for s in starts for i in range(s, s + p.window)}
        assert all(b - a < p.window for a, b in zip(starts[:-1], starts[1:]))


def test_toxicity_learns_words_and_stems(spark):
    r = random.Random(2)
    plain = ["".join(r.choices("abcdeo", k=4)) for _ in range(200)]

    def text(bad, n):
        ws = r.choices(plain, k=n)
        for _ in range(3 * bad):
            ws[r.randrange(n)] = r.choice(["nasty", "zzgrub" + r.choice("abcdefgh") * 2])
        return " ".join(ws)

    made = [(text(i % 2, r.randint(30, 150)), i % 2) for i in range(400)]
    model = toxicity.train([t for t, _ in made[:300]], [y for _, y in made[:300]], p=toxicity.Params(epochs=4))
    long_ = text(0, 3000) + " nasty zzgrubqq nasty"
    d = spark.createDataFrame([(t,) for t, _ in made[300:]] + [(None,), ("",), (" .!",), (long_,)], "text string").coalesce(1)
    got = toxicity.score_texts(d, model).collect()
    s = [x.score for x in got]
    assert all(0 <= x <= 1 for x in s) and s[100:103] == [0, 0, 0] and s[103] > 0.5
    assert sum((a >= 0.5) == bool(y) for a, (_, y) in zip(s, made[300:])) >= 95
    again = toxicity.score_texts(clashing(spark, d).repartition(3), model)
    assert sorted(x.score for x in again.collect()) == pytest.approx(sorted(s), abs=1e-5)
    assert toxicity.score_texts(d.limit(0), model).count() == 0
    assert 0 <= toxicity.score_texts(d, toxicity.train([], [])).first().score <= 1


# 3 personal data


def _luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


BASE = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_digits(m)) <= 15)}


def test_personal_data_matches_plain_patterns(spark):
    r = random.Random(4)
    bits = ["a@b.cc", "x.y@z", "@", ".", "_", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", " ", "-", "+", "+1 (23) 456-78-90",
            "0000", "é", "😀", "\n", "12", "+49 30 12345", "a-b.c", "9" * 20, "DE89 3704 0044 0532 0130 00", "123-45-6789", "ssn "]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a.b." * 5000 + "@x.y", "x@" + "a." * 5000, "1." * 5000, "+1" + " " * 5000, "é" * 50_000 + " a@b.cc"]
    d = clashing(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for row in pii.find_personal_data(d).collect():
        want = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, row.text or "") if ok(m.group())]
        assert [(s.kind, s.start, s.end) for s in row.spans if s.kind in BASE] == want, row.text
        assert all(0.5 <= s.score <= 1 for s in row.spans) and row.key == "own key"


def test_long_texts_and_odd_ids_train(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([("a", long), ("b", "short text"), ("b", "another text"), ("c", None), (None, "x"), ("d", "left out")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), ("c", 0), (None, 1), ("d", None), ("e", 1)], "doc_id string, toxic int")
    p = toxicity.Params(sample_pieces=4, piece=100)
    got = {toxicity.labelled_sample(docs.repartition(n), labels, F.lit(True), p)[:2].__repr__() for n in (1, 3)}
    assert len(got) == 1  # whatever the order of the rows
    texts, y, share = toxicity.labelled_sample(docs, labels, F.lit(True), p)
    assert sorted(y) == [0, 1, 1] and len(texts) == 3 and share == 0.75
    (big,) = [t for t in texts if len(t) > 100]
    pieces = [long[k:k + 100] for k in range(0, len(long), 100)]
    assert big in (" ".join(pieces[k] for k in ks) for ks in [[k for k in range(len(pieces)) if pieces[k] in big]]) and len(big) <= 403
    assert not long.startswith(big[:250])  # pieces from all over the text


def test_scores_are_the_highest_of_plain_forward_passes(spark):
    """Each overlapping window on its own through the network's parts, one word at a time."""
    import pyarrow as pa
    r = random.Random(8)
    texts = [" ".join(r.choices(["good", "bad", "Ugly", "x1", "né", "fine"], k=k)) for k in (1, 3, 63, 64, 65, 112, 113, 200, 700)] + ["", " - ", None]
    p = toxicity.Params(epochs=2, hidden=4)
    made = [" ".join(r.choices(["good", "fine", "x1"] + ["bad"] * (i % 2), k=20)) for i in range(60)]
    model = toxicity.train(made, [i % 2 for i in range(60)], p=p)
    got = {x.i: x.score for x in toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, t in enumerate(texts):
        best = 0.0
        for s in textbytes.slices(pa.array([t]), table=toxicity._TABLE):
            n, h = len(s.ws), s.byte_ranges(s.ws, s.we)
            rows = []
            for k in range(n):
                one = np.array([k])
                x = model.network.inputs(model.known(h[one]), *toxicity._grams(s, s.ws[one], s.we[one], p.grams))
                rows.append(model.network.projection(x.astype(np.float32))[0])
            ends = [0] if n <= p.window else [*range(0, n - p.window, p.stride), n - p.window]
            for a in ends if n else []:
                w = rows[a:a + p.window]
                z = model.network.logits(np.array(w, np.float32)[:, None, :], np.ones((len(w), 1), np.float32))
                best = max(best, float(toxicity._sigmoid(z.astype(np.float64))[0]))
        assert abs(got[i] - best) < 1e-4, (i, got[i], best)


def test_context_decides_on_secrets_and_local_phones(spark):
    hexes, mixed, v6 = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "AbCd-1234_efGH+5678/ijKL9012", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"
    texts = [(f'TOKEN = "{hexes.upper()}"!', ["secret"]), (f"api_key={mixed}==", ["secret"]), (f"commit {hexes} of main", []), (f"see {mixed} there", []),
             ("password: " + "a" * 40, []), ("my secret " + "1234567890" * 4, []), ("token " + "-" * 20_000, []), ("token " + "ab1" * 20_000, []),
             ("call (017) 555-7713 now", ["local_phone"]), ("room (017) 555-7713 now", []), ("tel. 0171 555 7713", ["local_phone"]),
             ("call +1 (017) 555-7713 now", []), (f"at {v6} now", ["ipv6"]), (v6 + ":1", []), (f"phone {'0' * 30_000}", [])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(d).collect()}
    for i, (t, want) in enumerate(texts):
        assert [s.kind for s in got[i] if s.kind not in BASE] == want, t
    assert texts[0][0][got[0][0].start:got[0][0].end] == hexes.upper() and texts[1][0][got[1][0].start:got[1][0].end] == mixed + "=="


def test_account_numbers_and_context(spark):
    d = spark.createDataFrame([(1, "to DE89 3704 0044 0532 0130 00 now"), (2, "to DE88 3704 0044 0532 0130 00 now"),
                               (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans if s.kind not in BASE] for r in pii.find_personal_data(d).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["national_id"], 4: []}


def test_account_numbers_end_where_they_pass(spark):
    """Words after a number that look like more of it; other groupings; two in a row."""
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    after = ["", " ", " Bank of X", " Please", " 2024", " IS MINE", " A", " 1", " NOW 12 AB34 CD", ".", "\n2024", " é", "  7"]
    cases = [(f"{b}{n}{a}", [n]) for n in (de, gb, no) for b in ("", "to ", "AB12 ", "Konto: ", "é😀 ") for a in after]
    cases += [(f"{a} {b}", [a, b]) for a in (de, gb, no) for b in (de, gb, no)]
    cases += [(n, [n]) for n in ("DE89 370 400 440 532 013 000", "DE89 3 7 0 4 0 0 4 4 0 5 3 2 0 1 3 0 0 0", "MT84 MALT 0110 0001 2345 MTLC AST0 01S")]
    cases += [(x, []) for x in (f"{de}x", f"x{de}", f"{de}0", "DE88370400440532013000 Bank", "DE89  370400440532013000", "AB12 " * 400)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find_personal_data(d).collect():
        text, want = cases[r.doc_id]
        assert [text[s.start:s.end] for s in r.spans if s.kind == "iban"] == want, text


# 4 near duplicates


def _brute_components(rows, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = words((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


@pytest.mark.parametrize("p", [neardup.Params(), neardup.Params(shingle=3, percent=85), neardup.Params(shingle=3, percent=85, block=8)])
def test_near_duplicates_match_all_pairs(spark, p):
    r = random.Random(7)
    rows, vocab = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 6, 12, 60, 200]))
        for _ in range(r.choice([1, 2, 25])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((len(rows), " ".join(t) if r.random() < 0.8 else "\n".join(t).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, None)]
    d = clashing(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(x) for x in neardup.near_duplicates(d, p).collect())
    assert got == _brute_components(rows, p.shingle, p.percent)


def test_long_texts_split_when_confirmed_still_link(spark):
    """Registers of a bucket fit a block, its shingles don't."""
    r = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{g}_{r.randrange(10**6)}" for _ in range(2500)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-40]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = neardup.Params(shingle=3, percent=85, block_values=4000)
    got = sorted(tuple(x) for x in neardup.near_duplicates(d, p).collect())
    assert got == [(i, len(t.split()) - 2, i - i % 2, i % 2 == 0) for i, t in rows]


def test_members_with_a_likely_partner_are_joined_once(spark, monkeypatch):
    """What is read several times (buckets told apart, blocks dealt) is a written table, no join."""
    r, plans = random.Random(3), []
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base if i == 0 else [w if r.random() > 0.04 else f"x{r.randrange(99)}" for w in base])) for i in range(60)]
    for name in ("once", "inside", "across"):
        def spied(members, *more, real=getattr(neardup, name)):
            plans.append(members._jdf.queryExecution().optimizedPlan().toString())
            return real(members, *more)
        monkeypatch.setattr(neardup, name, spied)
    p = neardup.Params(shingle=3, percent=85, block=8)
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect())
    assert got == _brute_components(rows, 3, 85)
    assert len(plans) == 6 and not any("Join" in x for x in plans)


def test_a_pair_is_confirmed_in_its_first_common_band(spark, monkeypatch):
    r, sent = random.Random(5), []
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"x{i}_{j}" for j, w in enumerate(base))) for i in range(40)]

    def spied(members, *more, real=neardup.inside):
        sent.append(members.count())
        return real(members, *more)

    monkeypatch.setattr(neardup, "inside", spied)
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Params(shingle=3, percent=85)).collect())
    assert got == _brute_components(rows, 3, 85)
    assert len(sent) == 2 and 2 * sent[1] < sent[0]


def test_crowded_buckets_grow_in_proportion(spark, monkeypatch):
    """Texts of one form, too different to link but for a few, share most bands."""
    def dealt(n):
        rows = [(i, " ".join(f"o{i // 2 if i < 8 else i}_{j}" if j % 16 == 0 else f"w{j}" for j in range(200))) for i in range(n)]
        sent = []

        def spied(frame, *more, real=buckets._run):
            sent.append(frame.count())
            return real(frame, *more)

        with monkeypatch.context() as m:
            m.setattr(buckets, "_run", spied)
            d = spark.createDataFrame([(i, t + " end" * (i % 2)) for i, t in rows], "doc_id long, text string")
            got = sorted(tuple(x) for x in neardup.near_duplicates(d, neardup.Params(shingle=3, percent=85, block=8)).collect())
        assert got == _brute_components([(i, t + " end" * (i % 2)) for i, t in rows], 3, 85)
        assert [x[2] for x in got[:8]] == [0, 0, 2, 2, 4, 4, 6, 6]
        return sum(sent)

    assert dealt(80) < 3 * dealt(40)


def test_texts_under_one_id_are_linked(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, ""), (8, c), (11, d), (12, None), (12, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
    of = {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 11: 11, 12: 12}
    assert got == sorted((i, of[i], of[i] == i) for i, _ in rows)


def test_near_duplicates_odd_rows(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(x) for x in neardup.near_duplicates(docs).collect())
    want = {i: c for i, _, c, _ in _brute_components(list(dict(rows).items()), 5, 80)}
    assert len(got) == len(rows) and all(c == want[i] for i, _, c, _ in got)
    assert neardup.near_duplicates(empty).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = neardup.near_duplicates(none).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "None", True)]


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(1)
    p = neardup.Params(registers=1024)
    for j in (0.0, 0.3, 0.8):
        n, out = 4000, []
        both = int(2 * n * j / (1 + j))
        u = np.unique(r.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(u[:n]), np.sort(np.concatenate([u[:both], u[n:2 * n - both]]))
        reg = neardup._registers([a, b], p)
        out = neardup.estimate(reg[:1], reg[1:], np.array([n]), np.array([n]), p)[0, 0]
        assert abs(out - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


# 5 top-k


def test_top_k_matches_brute_force(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, [2.0, 1.0]), (505, []), (10, rows[10][1])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "id", "d")})
    p = knn.Params(pivots=5, rings=3, chunk=40, block=7)
    got = sorted(tuple(x) for x in knn.exact_top_k(d, F.col("vec_id") % 10 == 0, p).collect())
    good = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v)))).astype(int)) for i, v in rows + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in dict(good).items():
        if q % 10 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert knn.exact_top_k(d.limit(0), F.col("vec_id") % 10 == 0, p).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert knn.exact_top_k(few, F.col("vec_id") == 0).count() == 2
    big = spark.createDataFrame([(0, [2.0 ** 20] * 3), (1, [2.0 ** 20, 1.0, -7.0]), (2, [-(2.0 ** 20)] * 3)], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in knn.exact_top_k(big, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 ** 56 + 2 ** 28 * 256 - 7 * 256 * 2 ** 28), (0, 2, 2, -3 * 2 ** 56)]


# 6 packing


def test_packing_ids_and_places(spark, docs, empty):
    from tokenizers import Tokenizer
    p = packing.Params(length=64, group=30, cache=50)
    rows = docs.collect()
    out = packing.pack_documents(docs, word_vocabulary(), p, with_ids=True).toPandas()
    tok = Tokenizer.from_file(word_vocabulary())
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            piece = np.array(ids[k:k + 64], "<u4").tobytes()
            want[r.doc_id, k // 64, k, len(piece) // 4, zlib.crc32(piece), piece] += 1
    assert Counter(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32, map(bytes, out.ids))) == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert out.sequence_id.nunique() <= 1.05 * out.length.sum() / 64 + len(rows) / 30 + 2
    assert packing.pack_documents(empty, word_vocabulary()).count() == 0


def test_words_are_cut_where_tokens_never_span(spark):
    """Odd white space, marks, special strings: as the tokenizer itself encodes them."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    tok, words_ = Tokenizer.from_file(word_vocabulary()), packing._Words(word_vocabulary(), 1, 50)
    r = random.Random(9)
    bits = ["a", "Don't", "we'RE", "'", ".", " ", "\n", "\x1c", "\xa0", "\u2028", "é", "É", "12", "!!", "'s", "ß", "\t", "\x0b", "中文", "\u0301", "\u0338",
            "<", "=", "٣", "…", "İ", "K", "\x00", "²", "e\u0301X", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for most in (len(bits) - 2, len(bits)):
        texts = ["".join(r.choices(bits[:most], k=r.randint(0, 12))) for _ in range(2000)]
        for s in textbytes.slices(pa.array(texts), max_bytes=300):
            ids, n = words_.encode(s)
            ends = np.cumsum(n)
            for t, a, b in zip(texts[s.first:], ends - n, ends):
                assert list(ids[a:b]) == [*tok.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_best_two_replace_the_smallest():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


# 7 repeats


def _brute_repeats(rows, n):
    count = Counter(tuple(w[i:i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k:k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("p", [substring.Params(), substring.Params(window=7, chunk_bytes=3000, range_hashes=500), substring.Params(window=8, bits=33, chunk_bytes=900), substring.Params(chunk_bytes=900, buckets=3)])
def test_repeats_match_brute_force(spark, docs, empty, p):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring.remove_repeats(clashing(spark, docs), p).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == _brute_repeats(rows, p.window)
    for r in got:
        assert sum(b - a for a, b in r.removed) == r.n_removed
    assert substring.remove_repeats(empty, p).count() == 0


# 8 quality


def test_measures_match_brute_force(spark, docs, empty):
    got = Counter()
    for r in quality.measure(docs).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines] += 1
    want = Counter()
    for r in docs.collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        twice = {k for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        want[r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), len(lines)] += 1
    assert got == want
    assert quality.quality_rules(empty).count() == 0


def test_sketches_merge_and_bound_quantiles(spark):
    r = random.Random(5)
    rows = [("x", 100, r.randint(0, 60), 0, 0, 0, 5, 0, 500 + i % 300) for i in range(2000)]
    names = "lang string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, n_stutter long, n_lines long, n_shout long, word_chars long"
    d = spark.createDataFrame(rows, names)
    whole = quality.sketch(d, ["lang"])
    a, b = d.randomSplit([0.3, 0.7], 1)
    merged = quality.sketch(a, ["lang"]).union(quality.sketch(b, ["lang"])).groupBy("lang", "ratio", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert sorted(map(str, whole.select("lang", "ratio", "bucket", "n").collect())) == sorted(map(str, merged.select("lang", "ratio", "bucket", "n").collect()))
    q = {r.ratio: r for r in quality.quantiles(whole, ["lang"]).collect()}
    true = sorted(x[2] / x[8] for x in rows)
    for got, at in ((q["symbol_ratio"].q25, 0.25), (q["symbol_ratio"].q75, 0.75)):
        assert abs(got - true[int(at * 2000)]) <= 0.03 * true[int(at * 2000)] + 1e-9
    assert q["repeat_ratio"].q75 == 0


def test_rules_follow_the_group(spark):
    """The same symbol density passes where it is usual and fails where it isn't."""
    clean = " ".join(f"word{i}" for i in range(40))
    code = " ".join(f"wo#{i}" if i % 2 else f"word{i}" for i in range(40))
    junk = " ".join("##*" for i in range(40))
    rows = [(i, clean, "en", "web") for i in range(200)] + [(1000 + i, code, "xx", "git") for i in range(200)]
    rows += [(5000, code, "en", "web"), (5001, junk, "xx", "git"), (5002, "short", "en", "web"), (5003, None, None, None), (5004, clean, None, "new")]
    d = clashing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    out = quality.quality_rules(d)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200))
    assert [kept[i] for i in range(5000, 5005)] == [False, False, False, False, True]
    assert set(CLASH) <= set(out.columns) and out.filter("key = 'own key' and _row = 'own _row'").count() == len(rows)


# 9 line dedup


def test_a_group_of_any_size_moves_its_fence(spark):
    """The fence goes from the language's to the group's own, more with each row, and never above the language's."""
    r, rules = random.Random(4), quality.Rules(slack=(*[x for x in quality.Rules().slack if x[0] != "word_length"], ("word_length", 0.1)))
    rows = [("en", "big", 100, 100 * 5 + r.randint(0, 100)) for _ in range(3000)]
    rows += [("en", f"own{n}", 100, 100 * 4 + r.randint(0, 20)) for n in (1, 10, 100, 1000) for _ in range(n)] + [("en", "junk", 10, 10 * 40)] * 50
    d = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long")
    d = d.withColumns({m: F.lit(0).cast("long") for m in quality.MEASURES if m not in d.columns})
    got = {x.source: x.max_word_length for x in quality.fences(quality.sketch(d, ["lang", "source"], rules), rules).collect()}
    assert got["own1"] > got["own10"] > got["own100"] > got["own1000"] and got["junk"] == max(got.values())
    wide, own = got["junk"], quality.quantiles(quality.sketch(d.filter("source = 'own100'"), ["lang"], rules), ["lang"], rules).filter("ratio = 'word_length'").first()
    assert abs(got["own100"] - (wide + own.q75 + max(3 * (own.q75 - own.q25), 0.1)) / 2) < 1e-9


def test_boilerplate_goes_by_site(spark):
    rows = [(i, "a", f"menu\n text {i} \n\nfoot ") for i in range(20)] + [(100 + i, "b", f"menu\nline {i}") for i in range(9)]
    rows += [(400 + i, "small", f"only {i}\n© foot" if i < 3 else "other\ntwice") for i in range(4)] + [(410, "pair", "copy"), (411, "pair", "copy")]
    rows += [(200 + i, None, "legal" if i < 3 else f"l{i}") for i in range(12)] + [(300, "a", None), (301, "a", ""), (302, "a", "once\nonce")]
    d = clashing(spark, spark.createDataFrame(rows, "page_id long, site string, body string"))
    out = linededup.drop_site_lines(d, "site", "body")
    got = {r.page_id: (r.body, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got[3] == (" text 3 \n", 3, 2) and got[103] == ("line 3", 2, 1)
    assert got[200] == ("", 1, 1) and got[210] == ("l10", 1, 0)
    assert got[400] == ("only 0", 2, 1) and got[403] == ("other\ntwice", 2, 0) and got[410] == ("copy", 1, 0)
    assert got[300] == (None, 0, 0) and got[301] == ("", 0, 0) and got[302] == ("once\nonce", 2, 0)
    assert out.filter("_drop = 'own _drop'").count() == len(rows)
    assert linededup.drop_site_lines(d.limit(0), "site", "body").count() == 0


def test_pages_without_url_or_html(spark):
    rows = [(1, None, "<p>a</p>"), (2, "no url", None), (3, "HTTP://u@Host.x:80/p", "<script>x<p></script>A<br/>B <!-- c --><b>d</b>")]
    got = {r.page_id: (r.host, r.text) for r in linededup.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, "a"), 2: ("", ""), 3: ("host.x", "A\nB  d")}


# 10 chat


HARD = ["\\", "[INST]", "[/INST]", "</s>", "<s>", " ", "<", "[", "a", "\n", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "é", "😀"]


def test_any_turn_reads_back():
    t, r = chat.Template(), random.Random(6)
    controls = t.controls()
    for _ in range(5000):
        role = r.choice(["user", "assistant", "system", "", "x", "[ROLE]", "tool [/ROLE] "])
        text = "".join(r.choices(HARD, k=r.randint(0, 6)))
        s = "".join(x for x, _ in chat._segments(t, controls, role, text))
        assert chat._read_turn(t, s + "[INST] z [/INST]") == (role, text, len(s))


def test_conversations_read_back_with_their_loss(spark):
    r, rows = random.Random(8), []
    for c in [*range(30), None]:
        for k in range(r.randint(1, 7)):
            rows.append((c, r.choice([k, 1]) if c == 5 else k, r.choice(["user", "assistant", "system", None, "tool"]) if c != 3 else ("user", "assistant")[k % 2],
                         r.choice([None, "", "".join(r.choices(HARD, k=9))])))
    d = clashing(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)
    seg = chat.format_chat(d)
    got = {x.conv_id: x for x in chat.read_back(seg).collect()}
    size = Counter()
    for x in seg.collect():
        size[x.conv_id] += len(x.text)
    for c in {x[0] for x in rows}:
        mine = sorted(((k, role or "", text or "") for i, k, role, text in rows if i == c))
        said = "".join(t for _, role, t in mine if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.loss_chars, x.formatted_chars) == (len(mine), len(said), size[c])
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        state, fine = "", True
        for _, role, _ in mine:
            fine &= role in chat.Template().after.get(state, ())
            state = role
        assert x.valid == fine
    assert chat.read_back(chat.format_chat(d.limit(0))).count() == 0


@pytest.mark.parametrize("bad", [("aXa", "y", True), ("a\\", "b", True), (" ", "b", True)])
def test_templates_that_cannot_be_read_back_are_refused(bad):
    with pytest.raises(ValueError):
        chat.Template(turns={"user": bad})
