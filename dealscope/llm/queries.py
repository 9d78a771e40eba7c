"""The registered queries of this folder; each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm import (
    decontamination, filter_audit, license_scan, line_dedup, ngram_join, pii, quality_rules, secret_scan,
    sentencepiece_codec, substring_dedup, token_counts, url_filter, whitening,
)
from dealscope.llm.common import table
from dealscope.llm.oracles import SQL

#: vocabularies, and the token limit that a text may reach
PIECES, BYTE_PAIRS = "piece_bpe_32k.model", "byte_bpe_50k.json"
TOKEN_LIMIT = 1024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in QUERIES if name in SQL}


@query
def op1_decontamination(spark, sf_dir):
    judged = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "value", "score", "secret")


@query
def op4_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"),
    )


@query
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op6_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.encode(docs, vocabulary(PIECES), decoded=True)
    return both.select(
        "doc_id", "n_tokens", "token_ids", F.col("decoded").eqNullSafe(F.translate("text", "\u2581", " ")).alias("round_trip")
    )


@query
def op7_pii(spark, sf_dir):
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
        F.array_max(F.transform(F.concat("base", "added"), lambda s: s["score"])).alias("top_score"),
    )


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("llm_lines").alias("n_lines"), F.col("llm_removed").alias("n_removed")
    )


@query
def op9_ngram_join(spark, sf_dir):
    return ngram_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links")


@query
def op10_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, vocabulary(BYTE_PAIRS))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op11_license_scan(spark, sf_dir):
    return license_scan.licenses(table(spark, sf_dir, "documents")).drop("spans")


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
