"""Toxicity scores from a bidirectional gated recurrent network.

A text's words (letters and digits, A-Z in lower case) are cut into windows
of a fixed length that overlap and together cover the whole text. A word's
input is the embedding of the word, if training met it often enough, beside
the mean embedding of its hashed character n-grams. A gated recurrent layer
runs over the window in each direction, attention pools its states, and a
logistic unit scores the window; a text has its highest window's score.

The network is trained in numpy on a bounded sample of labelled texts: each
text answers for its highest window. First components of the embeddings start
at the log odds of the word or n-gram in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import Slice, mix, slices

# lower-case letters, digits and all bytes of other scripts; the rest separates words
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_TABLE[ord("A"):ord("Z") + 1] += 32


@dataclass(frozen=True)
class Params:
    """``sample``: at most so many texts of each label (toxic, other) train
    the network, a text over ``sample_pieces`` pieces of ``piece`` characters by
    so many pieces, chosen by hash; ``stride`` < ``window``
    is the distance of windows; a small sample is gone over more than
    ``epochs`` times, for ``updates`` steps at least; ``cache``: words a worker
    remembers."""

    sample: tuple[int, int] = (1200, 2400)
    sample_pieces: int = 32
    piece: int = 500
    window: int = 64
    stride: int = 48
    grams: int = 32_768
    word_dim: int = 8
    gram_dim: int = 8
    hidden: int = 12
    attention: int = 8
    min_texts: int = 5
    epochs: int = 4
    updates: int = 200
    batch: int = 64
    rate: float = 0.01
    seed: int = 3
    cache: int = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


def _grams(s: Slice, ws: np.ndarray, we: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-, 4- and 5-byte runs of words, edges marked: (buckets, word of each)."""
    lens = we - ws + 2
    first = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(ws)), lens)
    at = np.arange(int(lens.sum())) - first[of]
    edge = (at == 0) | (at == lens[of] - 1)
    marked = np.where(edge, 1, s.data[np.clip(ws[of] + at - 1, 0, max(len(s.data) - 1, 0))] if len(s.data) else 1).astype(np.uint64)
    found, words = [], []
    for n in (3, 4, 5):
        start = np.flatnonzero(at + n <= lens[of])
        h = np.full(len(start), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + marked[start + k]
        found.append((mix(h) % np.uint64(n_buckets)).astype(np.int64))
        words.append(of[start])
    return np.concatenate(found), np.concatenate(words)


def _starts(n: int, p: Params) -> np.ndarray:
    """First words of the windows over n words: all full, the last one flush with the end."""
    if n <= p.window:
        return np.zeros(1 if n else 0, np.int64)
    return np.minimum(np.arange(0, n - p.window + p.stride, p.stride), n - p.window)


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, (n, width)."""
    return np.stack([np.bincount(index, rows[:, j], n) for j in range(rows.shape[1])], axis=1)


class Network:
    """Parameters ``w`` (a dict of arrays), scoring and one training step."""

    def __init__(self, p: Params, n_words: int):
        r, h, d = np.random.default_rng(p.seed), p.hidden, p.word_dim + p.gram_dim
        small = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = p
        self.w = {"word": r.normal(0, 0.05, (n_words, p.word_dim)), "gram": r.normal(0, 0.05, (p.grams, p.gram_dim)),
                  "att": small(2 * h, p.attention), "att_b": np.zeros(p.attention), "att_v": small(p.attention),
                  "out": small(2 * h), "out_b": np.zeros(1)}
        for way in "fb":
            self.w |= {f"x_{way}": small(d, 3 * h), f"b_{way}": np.zeros(3 * h), f"u_{way}": small(h, 3 * h)}

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, B, H) over projected inputs (T, B, 3H)."""
        h, u = self.p.hidden, self.w[f"u_{way}"]
        out = np.zeros((len(x), x.shape[1], h), x.dtype)
        state = np.zeros_like(out[0])
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            m = state @ u
            zr = _sigmoid(x[t, :, :2 * h] + m[:, :2 * h])
            new = _tanh(x[t, :, 2 * h:] + zr[:, h:] * m[:, 2 * h:])
            if keep is not None:
                keep.append((t, state, zr, m[:, 2 * h:], new))
            state = (new + zr[:, :h] * (state - new)) * mask[t][:, None]
            out[t] = state
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple:
        """Attention: (logits, weights, hidden, pooled) of states (T, B, 2H)."""
        w = self.w
        hidden = _tanh(states @ w["att"] + w["att_b"])
        e = np.where(mask > 0, hidden @ w["att_v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ w["out"] + w["out_b"], a, hidden, pooled

    def logits(self, projected: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Window logits of projected inputs (T, B, 6H)."""
        h3 = 3 * self.p.hidden
        states = np.concatenate([self._run("f", projected[:, :, :h3], mask, None), self._run("b", projected[:, :, h3:], mask, None)], axis=2)
        return self._pool(states, mask)[0]

    def inputs(self, words: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Word inputs: embedding beside mean n-gram embedding (``of``: the word of each n-gram)."""
        n = np.maximum(np.bincount(of, minlength=len(words)), 1)
        return np.concatenate([self.w["word"][words], _sum_by(of, self.w["gram"][grams], len(words)) / n[:, None]], axis=1)

    def projection(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.w["x_f"] + self.w["b_f"], x @ self.w["x_b"] + self.w["b_b"]], axis=-1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss of windows with inputs (T, B, D): by parameter, and of the inputs."""
        w, h, g = self.w, self.p.hidden, {}
        kept = {way: [] for way in "fb"}
        px = {way: x @ w[f"x_{way}"] + w[f"b_{way}"] for way in "fb"}
        states = np.concatenate([self._run(way, px[way], mask, kept[way]) for way in "fb"], axis=2)
        logit, a, hidden, pooled = self._pool(states, mask)
        d = (_sigmoid(logit) - y) / len(y)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * w["out"]
        d_a = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["att_v"] = np.einsum("tb,tba->a", d_e, hidden)
        d_hid = d_e[:, :, None] * w["att_v"] * (1 - hidden ** 2)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", states, d_hid), d_hid.sum(axis=(0, 1))
        d_states = a[:, :, None] * d_pooled + d_hid @ w["att"].T
        d_x = np.zeros_like(x)
        for way, part in (("f", d_states[:, :, :h]), ("b", d_states[:, :, h:])):
            u, back = w[f"u_{way}"], np.zeros_like(part[0])
            d_u, d_p = np.zeros_like(u), np.zeros_like(px[way])
            for t, state, zr, q, new in reversed(kept[way]):
                dh = (part[t] + back) * mask[t][:, None]
                z, r = zr[:, :h], zr[:, h:]
                d_new = dh * (1 - z) * (1 - new ** 2)
                d_z, d_r = dh * (state - new) * z * (1 - z), d_new * q * r * (1 - r)
                d_m = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_p[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u += state.T @ d_m
                back = dh * z + d_m @ u.T
            g[f"u_{way}"], g[f"b_{way}"] = d_u, d_p.sum(axis=(0, 1))
            g[f"x_{way}"] = np.einsum("tbd,tbk->dk", x, d_p)
            d_x += d_p @ w[f"x_{way}"].T
        return g, d_x


def _odds(ones: np.ndarray, every: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 from the numbers of texts that hold a feature."""
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((every - ones + 0.5) / (len(y) - y.sum() + 1))
    return np.clip(odds, -3, 3) * np.minimum(every / 3, 1)


@dataclass
class _Sample:
    """Words of the training texts: ``code`` of each word, first words ``dw`` of
    the texts, and by code its hash and n-grams (``grams[lo:hi]``)."""

    code: np.ndarray
    dw: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def of(cls, texts: list[str], p: Params) -> _Sample:
        known: dict[int, int] = {}
        codes, rows, grams, sizes = [], [], [], []
        for s in slices(pa.array(texts, pa.string()), max_bytes=500_000, table=_TABLE):
            h, first, inverse = np.unique(s.byte_ranges(s.ws, s.we), return_index=True, return_inverse=True)
            keys = h.tolist()
            new = [i for i, k in enumerate(keys) if k not in known]
            if new:
                g, of = _grams(s, s.ws[first[new]], s.we[first[new]], p.grams)
                grams.append(g[np.argsort(of, kind="stable")])
                sizes.append(np.bincount(of, minlength=len(new)))
                known.update(zip([keys[i] for i in new], range(len(known), len(known) + len(new)), strict=True))
            codes.append(np.array([known[k] for k in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64))
            rows.append(np.diff(s.dw))
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hi = np.cumsum(flat(sizes))
        return cls(flat(codes), np.concatenate([[0], np.cumsum(flat(rows))]), np.fromiter(known, np.uint64, len(known)),
                   flat(grams), hi - flat(sizes), hi)

    def counts(self, y: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
        """Texts of label 1, and all texts, that hold each word and each n-gram."""
        out = [np.zeros(n) for n in (len(self.hashes), len(self.hashes), p.grams, p.grams)]
        for t in range(len(y)):
            w = np.unique(self.code[self.dw[t]:self.dw[t + 1]])
            n = self.hi[w] - self.lo[w]
            g = np.unique(self.grams[np.arange(n.sum()) + np.repeat(self.lo[w] - (np.cumsum(n) - n), n)])
            for k, at in ((0, w), (2, g)):
                out[k][at] += y[t]
                out[k + 1][at] += 1
        return tuple(out)


@dataclass
class Model:
    """A trained network and the hashes of its words (sorted)."""

    network: Network
    words: np.ndarray

    def known(self, h: np.ndarray) -> np.ndarray:
        """Embedding rows of word hashes; 0: not met often enough."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0)


def train(texts: list[str], toxic: list[int], share: float | None = None, p: Params = Params()) -> Model:
    """Fits the network; the same texts in the same order give the same model.
    ``share``: how often label 1 occurs outside a sample that holds it more
    often; scores are then set back to that."""
    y, s = np.array(toxic, np.float64), _Sample.of(texts, p)
    if not len(s.code):
        return Model(Network(p, 1), np.zeros(0, np.uint64))
    code, lo, hi, grams = s.code, s.lo, s.hi, s.grams
    ones, seen, gram_ones, gram_seen = s.counts(y, p)
    often = seen >= p.min_texts
    row = np.zeros(len(s.hashes), np.int64)
    row[often] = np.arange(1, often.sum() + 1)
    net = Network(p, int(often.sum()) + 1)
    net.w["word"][1:, 0] = _odds(ones, seen, y)[often]
    net.w["word"][0] = 0
    net.w["gram"][:, 0] = _odds(gram_ones, gram_seen, y)

    texts_with = np.flatnonzero(np.diff(s.dw))
    windows = [s.dw[r] + _starts(int(s.dw[r + 1] - s.dw[r]), p) for r in range(len(y))]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    rng, step = np.random.default_rng(p.seed), 0

    def take(start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = start[None, :] + np.arange(p.window)[:, None]
        mask = (at < s.dw[text + 1][None, :]).astype(np.float64)
        return code[np.minimum(at, len(code) - 1)], mask

    for _ in range(max(p.epochs, -(-p.updates * p.batch // max(len(texts_with), 1)))):
        order = rng.permutation(texts_with)
        for b in range(0, len(order), p.batch):
            batch = order[b:b + p.batch]
            start = np.concatenate([windows[r] for r in batch])
            text = np.repeat(np.arange(len(batch)), [len(windows[r]) for r in batch])
            codes, mask = take(start, batch[text])
            used, local = np.unique(codes, return_inverse=True)
            local = local.reshape(codes.shape)
            n = hi[used] - lo[used]
            g_of = np.repeat(np.arange(len(used)), n)
            g_at = grams[np.arange(n.sum()) + np.repeat(lo[used] - (np.cumsum(n) - n), n)]
            x = net.inputs(row[used], g_at, g_of)
            if len(start) > len(batch):  # each text answers for its highest window
                logit = net.logits(net.projection(x)[local], mask)
                best = np.lexsort((-logit, text))
                best = best[np.append(True, np.diff(text[best]) > 0)]
            else:
                best = np.arange(len(start))
            grad, d_x = net.gradients(x[local[:, best]], mask[:, best], y[batch])
            flat = _sum_by(local[:, best].ravel(), d_x.reshape(-1, d_x.shape[2]), len(used))
            grad["word"] = _sum_by(row[used], flat[:, :p.word_dim], len(net.w["word"]))
            grad["word"][0] = 0
            grad["gram"] = _sum_by(g_at, (flat[:, p.word_dim:] / np.maximum(n, 1)[:, None])[g_of], p.grams)
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                net.w[k] -= p.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if share is not None and 0 < share < 1 and 0 < y.mean() < 1:
        net.w["out_b"] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    net.w = {k: v.astype(np.float32) for k, v in net.w.items()}
    order = np.argsort(s.hashes[often])
    net.w["word"][1:] = net.w["word"][1:][order]
    return Model(net, s.hashes[often][order])


class _Scorer:
    """Scores slices of texts; projected inputs of words are kept by hash."""

    def __init__(self, model: Model):
        self.model, self.p = model, model.network.p
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.zeros((0, 6 * self.p.hidden), np.float32)

    def _codes(self, s: Slice) -> np.ndarray:
        h, first, code = np.unique(s.byte_ranges(s.ws, s.we), return_index=True, return_inverse=True)
        if len(self.at) > self.p.cache:
            self._clear()
        keys, at = h.tolist(), self.at
        new = np.array([k not in at for k in keys], bool)
        if new.any():
            net, a = self.model.network, first[new]
            x = net.inputs(self.model.known(h[new]), *_grams(s, s.ws[a], s.we[a], self.p.grams))
            at.update(zip(h[new].tolist(), range(len(self.rows), len(self.rows) + len(a)), strict=True))
            self.rows = np.concatenate([self.rows, net.projection(x.astype(np.float32)).astype(np.float32)])
        return np.array([at[k] for k in keys], np.int64)[code]

    def scores(self, s: Slice) -> np.ndarray:
        """Score of each row; 0 without words."""
        out, p = np.zeros(s.rows), self.p
        if not len(s.ws):
            return out
        codes, n = self._codes(s), np.diff(s.dw)
        starts = [_starts(int(k), p) for k in n]
        row = np.repeat(np.arange(s.rows), [len(x) for x in starts])
        start = np.concatenate(starts)
        for a in range(0, len(row), 256):
            r = row[a:a + 256]
            at = start[None, a:a + 256] + np.arange(p.window)[:, None]
            mask = at < n[r][None, :]
            x = self.rows[codes[np.minimum(s.dw[r][None, :] + at, len(codes) - 1)]]
            np.maximum.at(out, r, _sigmoid(self.model.network.logits(x, mask.astype(np.float32)).astype(np.float64)))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params(), doc_id: str = "doc_id", text: str = "text",
                    toxic: str = "toxic") -> tuple[list[str], list[int], float | None]:
    """(texts, labels, share of label 1 among all rows that may be learnt): at most ``p.sample`` texts of each label, chosen by a hash of the id
    among label rows where ``learn`` holds; twice as many ids are looked up,
    since some may have no text. Texts of any length train, very long ones by
    pieces of them. Null labels and ids don't count; an id with several labels
    has the highest, one with several texts that of the smallest hash."""
    known = labels.filter(learn & F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(toxic).cast("int").alias("_y"))
    known = known.withColumn("_h", F.xxhash64(doc_id))
    picked = None
    for y, n in ((1, p.sample[0]), (0, p.sample[1])):
        some = known.filter(F.col("_y") == y).orderBy("_h", doc_id).limit(2 * n)
        picked = some if picked is None else picked.union(some)
    at = F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / p.piece).cast("int"))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64("_h", i).alias("h"), i.alias("i")))), 1, p.sample_pieces), lambda x: x["i"]))
    pieces = F.array_join(F.transform(chosen, lambda i: F.substring(F.col("_t"), i * p.piece + 1, F.lit(p.piece))), " ")
    held = docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(picked), doc_id)  # at most 2 * sum(sample) ids
    held = held.withColumn("_t", F.when(F.length("_t") > p.sample_pieces * p.piece, pieces).otherwise(F.col("_t")))
    rows = held.groupBy(doc_id, "_y", "_h").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t")).toPandas().sort_values(["_h", doc_id])
    rows = rows.groupby("_y", group_keys=False)[list(rows.columns)].apply(lambda g: g.head(p.sample[0 if g["_y"].iat[0] else 1])).sort_values(["_h", doc_id])
    share = known.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    return list(rows["_t"]), [int(v) for v in rows["_y"]], share


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` (all columns) with ``score`` (0 to 1) added.

    Whole texts are scored, all windows. Null texts, empty texts and texts
    without a letter or digit score 0; repeated rows score alike; a column
    named ``score`` is replaced; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the network and a sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            parts = [scorer.scores(s) for s in slices(batch.column(text), max_bytes=1_000_000, table=_TABLE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
