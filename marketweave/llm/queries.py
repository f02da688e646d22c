"""One whole-table query per operator: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, knn, linededup, merkle, mixing, neardup, ngramjoin, packing, pii, quality, spelling, substring, toxicity
from .oracle import ORACLE_SQL
from .shared import materialize, read, small


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = toxicity.train(*toxicity.labelled_sample(docs, read(spark, sf_dir, "labels"), fold != 0))
    scored = toxicity.score_texts(docs, model).drop("text")
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(joined(of(*pii.BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, neardup.Params(shingle=3, percent=85))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.exact_top_k(vectors, F.col("vec_id") % 50 == 0)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, word_vocabulary())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.quality_rules(docs, store=lambda m: materialize(m.drop("text"), "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = linededup.clean_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "host", "n_lines", "n_dropped", "text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat.read_back(chat.format_chat(rows.union(more)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    leaf = lambda text: merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    cut = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(cut, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    m = merkle.build(leaves)
    proofs = merkle.prove(m, m.leaves).join(small(m.groups.select("sid", "subroot")), "sid")
    root, claimed = F.lit(m.root).cast("string"), F.coalesce("kept.changed", "leaf")
    out = proofs.select("kept.doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.array_join("proof.others", ""), 256).alias("proof_sha256"),
                        merkle.fold(claimed, F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
