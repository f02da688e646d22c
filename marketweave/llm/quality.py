"""Quality rules with adaptive thresholds.

Every text is measured in full (word, symbol, line and repetition counts).
Cut-offs are not fixed: for each (language, source) a mergeable quantile
sketch of each ratio is kept (counts by logarithmic bucket, a relative-error
sketch whose merge is addition, so the order and split of rows don't matter),
its quartiles give an upper fence, and documents beyond a fence are rejected
by joining the fences back. A group's fence lies between its language's and its
own: the more rows the group has, the nearer its own. No group may be looser
than its language: a source that is mostly junk can't lift its own limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import materialize, small
from .textbytes import Slice, cover, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), *range(ord("A"), ord("Z") + 1)]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout", "n_stutter")


@dataclass(frozen=True)
class Rules:
    """``slack`` is the least fence above 0 of each ratio; ``reach`` the number
    of interquartile ranges above the upper quartile; the language's fence
    counts as ``prior`` rows of each (language, source)."""

    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    reach: float = 3.0
    relative_error: float = 0.02
    prior: int = 100
    slack: tuple[tuple[str, float], ...] = (("symbol_ratio", 0.06), ("dup_line_ratio", 0.4),
                                            ("repeat_ratio", 0.3), ("stutter_ratio", 0.2), ("shout_ratio", 0.3), ("word_length", 6.0))


def _measure(s: Slice, window: int) -> dict[str, np.ndarray]:
    rows = s.rows
    out = {"n_words": np.diff(s.dw).astype(np.int64)}
    out["word_chars"] = s.per_row(s.nonspace & ((s.data & 0xC0) != 0x80))
    out["n_symbols"] = s.per_row(_SYMBOL[s.data])
    out["n_shout"] = s.per_row(_SHOUT[s.data])
    # lines: from a row's start or a newline to the next newline or the row's end
    nl = np.flatnonzero(s.data == 10)
    a = np.sort(np.concatenate([s.off[:-1], nl + 1]), kind="stable")
    b = np.sort(np.concatenate([nl, s.off[1:]]), kind="stable")
    with_word = np.searchsorted(s.ws, b) > np.searchsorted(s.ws, a)
    a, b = a[with_word], b[with_word]
    row = np.searchsorted(s.off, a, side="right") - 1
    out["n_lines"] = np.bincount(row, minlength=rows).astype(np.int64)
    salt = (np.arange(rows, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(s.byte_ranges(a, b) ^ salt[row], return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=rows)
    # words equal to the one before
    word = s.byte_ranges(s.ws, s.we)
    again = (word[1:] == word[:-1]) & (s.word_row[1:] == s.word_row[:-1])
    out["n_stutter"] = np.bincount(s.word_row[1:][again], minlength=rows).astype(np.int64)
    # words in windows that the same row holds twice
    at, h = s.windows(window)
    h = h ^ salt[s.word_row[at]]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = cover(at[twice], window, len(s.ws)) if len(s.ws) else np.zeros(0, bool)
    out["n_repeat_words"] = np.bincount(s.word_row[covered], minlength=rows).astype(np.int64)
    return out


def measure(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with the counts of MEASURES (long) of each whole text added.

    Null and empty texts count 0 everywhere; repeated rows stay; columns of
    ``docs`` with a measure's name are replaced.
    """
    docs = docs.drop(*MEASURES)
    schema = StructType([*docs.schema.fields, *[StructField(m, LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(s, window) for s in slices(batch.column(text), max_bytes=500_000)]
            arrays = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *MEASURES])

    return docs.mapInArrow(run, schema)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
          "repeat_ratio": ("n_repeat_words", "n_words"), "stutter_ratio": ("n_stutter", "n_words"),
          "shout_ratio": ("n_shout", "word_chars"),
          "word_length": ("word_chars", "n_words")}


def sketch(measured: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """Quantile sketches: rows (keys, ratio, bucket, n). Two sketches merge by
    adding n; bucket b > -1000 holds values in (g**(b-1), g**b], -1000 holds 0."""
    growth = float(np.log((1 + rules.relative_error) / (1 - rules.relative_error)))
    bucket = [F.struct(F.lit(k).alias("ratio"),
                       F.when(_ratio(a, b) > 0, F.ceil(F.log(_ratio(a, b)) / growth).cast("int"))
                       .otherwise(-1000).alias("bucket")) for k, (a, b) in RATIOS.items()]
    return (measured.filter("n_words > 0").select(*keys, F.explode(F.array(*bucket)).alias("e"))
            .groupBy(*keys, "e.ratio", "e.bucket").agg(F.count("*").alias("n")))


def quantiles(sketched: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """Quartiles of each (keys, ratio) from its sketch: rows = groups x ratios."""
    growth = float(np.log((1 + rules.relative_error) / (1 - rules.relative_error)))
    by = W.partitionBy(*keys, "ratio")
    upto = by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("bucket") > -1000, F.exp((F.col("bucket") - 0.5) * growth)).otherwise(0.0)
    at = sketched.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(upto), "value": value})
    return at.groupBy(*keys, "ratio").agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value"))).alias(name)
                                         for name, q in (("q25", 0.25), ("q75", 0.75))])


def fences(sketched: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source): the upper fence of each ratio (null keys are groups)."""
    slack = F.create_map(*[x for k, v in rules.slack for x in (F.lit(k), F.lit(v))])
    limit = lambda q: (q.withColumn("fence", F.col("q75") + F.greatest(
        rules.reach * (F.col("q75") - F.col("q25")), slack[F.col("ratio")])))
    by_lang = limit(quantiles(sketched.groupBy(lang, "ratio", "bucket").agg(F.sum("n").alias("n")), [lang], rules))
    by_both = limit(quantiles(sketched, [lang, source], rules))
    l, b = by_lang.select(F.col(lang).alias("_l"), F.col("ratio").alias("_r"), F.col("fence").alias("wide")), by_both
    joined = b.join(l, b[lang].eqNullSafe(l["_l"]) & (b["ratio"] == l["_r"]))
    own = F.col("total") / (F.col("total") + rules.prior)
    fence = F.least(F.col("wide"), F.col("wide") + own * (F.col("fence") - F.col("wide")))
    return joined.groupBy(lang, source).agg(*[F.max(F.when(F.col("ratio") == k, fence)).alias(f"max_{k}") for k in RATIOS])


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang",
                  source: str = "source", store=None) -> DataFrame:
    """``docs`` (all columns) plus the measures, ``base_failed`` and ``kept``.

    ``store`` writes the measured table once (text left out by the caller if
    it isn't wanted, then it is missing here too), so that the texts are
    scanned once for sketch and verdict. Null lang or source is a group of its
    own; texts without words fail; repeated rows count and are judged each;
    an empty table gives an empty result; columns of ``docs`` named like an
    added one are replaced, other names don't matter.
    """
    added = [*MEASURES, "base_failed", "kept"]
    names = [c for c in docs.columns if c not in added]
    named = {text: "text", lang: "lang", source: "source"}
    rest = [c for c in names if c not in named]
    narrow = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in named.items()], *[F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] * bool(rest))
    measured = measure(narrow, "text", rules.window)
    measured = store(measured) if store else measured
    limits = materialize(fences(sketch(measured, ["lang", "source"], rules), rules), "fences")
    limits = small(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))
    beyond = F.lit(False)
    for k, (a, b) in RATIOS.items():
        beyond = beyond | F.coalesce(_ratio(a, b) > F.col(f"max_{k}"), F.lit(False))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = joined.withColumns({"base_failed": failed, "kept": ~failed & ~beyond})
    kept = [c for c in names if named.get(c, "rest") in measured.columns]
    return out.select(*[F.col(named[c]).alias(c) if c in named else F.col("rest").getField(c).alias(c) for c in kept], *added)
