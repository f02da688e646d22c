"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. Null texts and empty tables
pass through every stage; what each does with nulls, ties and repeated rows is
said in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm import linededup, mixing, neardup, packing, quality
from marketweave.llm.queries import word_vocabulary
from marketweave.llm.shared import materialize, read, small
from marketweave.operators.rank import global_rank

#: No SQL: tokens and packing. tests/llm holds the stages to brute force.
ORACLE_SQL = None


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _core(docs: DataFrame) -> DataFrame:
    """The columns of documents; any others in one struct, so that no name can clash."""
    more = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*[c for c in docs.columns if c in COLUMNS], *[F.struct(*[F.col(f"`{c}`") for c in more]).alias("more")] * bool(more))


def _whole(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c) if c in COLUMNS else F.col("more").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _whole(quality.quality_rules(_core(docs)).filter("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    out = linededup.drop_site_lines(_core(docs), "source", "text")
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _whole(out.withColumn("n_chars", n), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate group stays (five-word shingles, 0.8):
    that of the smallest doc_id, one row of it. Different texts under one
    doc_id count as documents of their own. Rows without a doc_id stay."""
    twice = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        found = materialize(neardup.near_duplicates(docs).select("doc_id", "kept"), "near")
        return docs.join(small(materialize(found.filter("not kept").select("doc_id"), "copies")), "doc_id", "left_anti").select(*docs.columns)
    # a number for each (doc_id, text), in the order of doc_id
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    keys = global_rank(rows.filter("doc_id is not null").select("doc_id", "_hash").distinct(), ["doc_id", "_hash"], "_key")
    rows = materialize(rows.join(materialize(keys, "keys"), ["doc_id", "_hash"], "left").select("_row", "text", "_key"), "keyed")
    found = materialize(neardup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text")).select("doc_id", "kept"), "near")
    own = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("_key")).distinct()
    one = rows.join(own, "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row")).select("_row")
    return one.union(rows.filter("_key is null").select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each pass over a document."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of 4096 tokens."""
    return packing.pack_documents(docs, word_vocabulary())


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_dedup_stage),
          ("mix sources", mixing_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every step but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
