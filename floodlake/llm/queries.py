"""The thin queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, curves, decontam, divergence, gru, html_tree, lines, mixing, ngram_join, substrings, toxicity, wavelet
from .frames import fold, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_documents(table(spark, sf_dir, "documents"))


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract_pages(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return curves.nearest(vectors, F.col("vec_id") % 50 == 0)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score_texts(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_tokens(spark, wavelet.write_tokens(table(spark, sf_dir, "documents")), digests=True)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_extract_html": op2_extract_html,
    "op3_line_dedup": op3_line_dedup,
    "op4_nearest": op4_nearest,
    "op5_chat": op5_chat,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_token_files": op11_token_files,
    "op12_divergence": op12_divergence,
    "op13_align_tokens": op13_align_tokens,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE,
    "op5_chat": chat.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op8_decontaminate": decontam.ORACLE,
    "op9_substring_dedup": substrings.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
