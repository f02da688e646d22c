"""Mixing sources to target weights.

Each source is a stream of words in a hashed order of its documents, cut into
blocks of a fixed number of words. The mix has as many slots as the targets
have blocks; a pseudorandom permutation deals all slots to output shards of
equal size, so a shard's source counts are a multinomial draw conditioned on
the sources' exact totals. The k-th slot of a source, counted over the shards'
draws, maps through a permutation of the source's block numbers (another one
in each pass over the source), and blocks are joined by number. All of it is
DataFrame functions; rows are documents, blocks and slots, never words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, materialize, n_words


@dataclass(frozen=True)
class Params:
    """``weights`` go to the sources in code point order (null last), repeating;
    no target exceeds ``most`` times its source. ``per_bucket``: documents in
    one sorted run of a stream."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block: int = 512
    shard: int = 4096
    seed: int = 17
    per_bucket: int = 4_000


_ROUNDS = 24


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A keyed pseudorandom permutation of 0 .. n-1 at x, for any n (the
    swap-or-not shuffle of Hoang, Morris and Rogaway)."""

    def step(y: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - y, n)
        return F.when(F.xxhash64(r, *key, F.greatest(y, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x.cast("long"), step)


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """(source, source_size) with sid, weight, target (double): all sizes
    shared by weight, targets above ``most`` times their size held there and
    the excess shared again among the rest. One row per source, so the sort
    in one task holds as many rows as there are sources."""
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.col("sid") % len(p.weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight.cast("double"))
    out = out.withColumns({"cap": (p.most * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(every)})
    rising = every.orderBy(F.col("cap") / F.col("weight"), "sid")
    out = out.withColumns({"held": F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                           "left": F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))})
    out = out.withColumn("rate", (F.col("total") - F.col("held")) / F.col("left"))
    free = F.when(F.col("cap") >= F.col("rate") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sid", "rate"))
    out = out.withColumn("free_rate", F.min(free).over(every)["rate"])
    target = F.least("cap", F.coalesce(F.col("free_rate") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", "sid", "weight", target.alias("target"))


def draw(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text",
         source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: (streams) one row per document with its place
    in its source's stream, (sources) the targets, (slots) one row per slot:
    sid, block, pass, shard, take (words taken from the block's start; only
    a source's last slot is short, which makes its total exact)."""
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                    n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("h"),
                                    F.xxhash64(doc_id, text).alias("k")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sizes = materialize(sizes, "sizes")
    rows = sizes.agg(F.sum("_n")).first()[0] or 0
    block = F.lit(p.block).cast("long")
    words = F.least(F.round("target").cast("long"), p.most * F.col("source_size"))
    sources = targets(sizes.drop("_n"), p).withColumn("words", words)
    some = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumns({"blocks": F.ceil(F.col("source_size") / block), "passes": F.floor(F.col("words") / some),
                                   "rest": F.col("words") % some})
    sources = sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    one = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("slots").over(one.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sources = materialize(sources.withColumns({"first_slot": before, "all_slots": F.sum("slots").over(one)}), "sources")

    # streams: prefix sums within (source, bucket), buckets offset by their totals
    bucket = F.pmod(F.xxhash64("doc_id", "h", F.lit(p.seed)), F.lit(int(rows // p.per_bucket) + 1))
    keyed = (sized.join(sources.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(sources["source"]))
             .drop(sources["source"]).withColumn("bucket", bucket))
    totals = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    base = F.sum("s").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select("sid", "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    order = W.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    streams = (keyed.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(totals, ["sid", "bucket"])
               .withColumn("start", F.col("base") + F.col("within"))
               .select("doc_id", "source", "sid", "source_size", "target", "size", "h", "k", "start"))

    # slots -> shards: the multinomial counts. The rows before each explode are few and
    # would share a task, so they are dealt to a number of tasks that follows the slots
    run = 65_536
    all_slots, some_tasks = sources.agg(F.max("all_slots")).first()[0] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-all_slots // run), min(some_tasks, -(-all_slots // p.shard)))
    runs = (sources.filter("slots > 0").select("sid", "first_slot", "slots", "all_slots",
                                               F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / run))).alias("run"))
            .repartition(tasks, "sid", "run"))
    upto = F.least(F.col("slots") - 1, (F.col("run") + 1) * run - 1)
    dealt = (runs.select("sid", "first_slot", "all_slots", F.explode(F.sequence((F.col("run") * run).cast("long"), upto.cast("long"))).alias("i"))
             .select("sid", F.floor(permuted(F.col("first_slot") + F.col("i"), F.col("all_slots"), F.lit(p.seed)) / p.shard).alias("shard")))
    counts = dealt.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("from", F.coalesce(earlier, F.lit(0)))

    # the source's k-th slot -> block number
    by = ["sid", "source_size", "blocks", "passes", "rest"]
    k = (counts.join(sources.select(*by), "sid").repartition(tasks, "sid", "shard")
         .select(*by, "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("k")))
    k = k.withColumns({"pass": F.floor(F.col("k") / F.col("blocks")), "r": F.col("k") % F.col("blocks")})
    full = F.floor(F.col("source_size") / block)  # the short last block ends each pass
    number = F.when(F.col("r") < full, permuted(F.col("r"), F.greatest(full, F.lit(1)), F.col("sid"), F.col("pass"), F.lit(p.seed))).otherwise(F.col("r"))
    length = F.least(block, F.col("source_size") - F.col("b") * block)
    slots = (k.withColumn("b", number)
             .select("sid", F.col("b").alias("block"), "pass", "shard",
                     F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(block, F.col("rest") - F.col("r") * block)).alias("take")))
    return streams, sources, slots


def _pieces(streams: DataFrame, p: Params) -> DataFrame:
    """The blocks of each document that has words, as word ranges of the stream."""
    last = F.col("start") + F.col("size")
    return (streams.filter("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / p.block), F.floor((last - 1) / p.block))))
            .withColumns({"lo": F.greatest(F.col("start"), F.col("block") * p.block),
                          "hi": F.least(last, (F.col("block") + 1) * p.block)}))


def mix_counts(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    taken (words the mix takes of it, repeats counted).

    Null or empty texts have size 0 and are never taken; a null source is a
    source; repeated rows are separate documents with equal results in some
    order; null ids are fine; other columns are not read; an empty table
    gives no rows.
    """
    streams, _, slots = draw(docs, p, doc_id, text, source)
    streams = materialize(streams, "streams")
    times = slots.groupBy("sid", "block", "take").agg(F.count("*").alias("times"))
    part = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("block") * p.block + F.col("take")) - F.col("lo"))
    cols = ["doc_id", "source", "sid", "start", "size", "source_size", "target"]
    taken = (_pieces(streams, p).join(times, ["sid", "block"], "left")
             .groupBy(*cols).agg(F.coalesce(F.sum(part * F.col("times")), F.lit(0)).alias("taken")))
    none = streams.filter("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))
    return taken.union(none).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: rows of ``docs`` (same columns), one for each pass
    in which a document is taken, with the whole text where all of it is
    taken, else the taken words in order, joined by one space.

    Documents without words are never taken; identical rows are pooled (their
    passes come from one of them). An n_chars column follows the text.
    """
    streams, _, slots = draw(docs, p, doc_id, text, source)
    streams = materialize(streams, "streams")
    cut = F.least(F.col("hi"), F.col("block") * p.block + F.col("take"))
    spans = (_pieces(streams, p).join(slots.select("sid", "block", "pass", "take"), ["sid", "block"])
             .filter(cut > F.col("lo"))
             .groupBy("sid", "start", "pass", F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("size").alias("_size"))
             .agg(F.sort_array(F.collect_list(F.struct((F.col("lo") - F.col("start")).alias("lo"), (cut - F.col("lo")).alias("n")))).alias("_spans"),
                  F.sum(cut - F.col("lo")).alias("_n"))
             .select("_k", "_h", "_size", "_spans", "_n"))
    others = [c for c in docs.columns if c != text]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").alias("_text"),
                        F.xxhash64(doc_id, text).alias("_k"), F.xxhash64(text).alias("_h"))
    if not streams.groupBy("k", "h").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["_k", "_h"])
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["lo"] + 1).cast("int"), s["n"].cast("int")))), " ")
    out = keyed.join(spans, ["_k", "_h"]).withColumn("_text", F.when(F.col("_n") == F.col("_size"), F.col("_text")).otherwise(some))
    of = {text: F.col("_text")}
    if "n_chars" in others:
        of["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[of.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
