"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.llm import (
    decontaminate, mixing, pack, parity_join, pii, qda, resample, revisits, secret_scan, spelling, token_count, url_filter, weak_rules,
)
from seqmodel.llm.url_filter import Rule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key="pii-surrogates-1", count_col="n_replaced")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisits.resolve_revisits(revisits.captures_of(_table(spark, sf_dir, "pages")))
    return rows.select("record_id", "canonical_url", "ts", "response_id", "status", revisits.header_text(F.col("merged")).alias("merged"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# The rules every url is held against.
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is that of the label row of its number: bad if of low quality or toxic."""
    outcomes = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    rows = url_filter.filter_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is mixed are the parts of a source by language: the sources alone have nearly equal shares here."""
    part = F.to_json(F.struct("source", "lang"))
    docs = _table(spark, sf_dir, "documents").withColumn("part", part)
    return mixing.mixed(docs, source_col="part").select("doc_id", "source", "lang", "epoch", "block_order", "doc_order")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weak_rules.judged(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = parity_join.Similarity(size=3, num=90, den=100, slack=0)
    return parity_join.linked_groups(_table(spark, sf_dir, "documents"), how)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, sf_dir, "documents"), spelling.Variants(dropped=97))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_source_mixing": op6_source_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_packing": op12_packing,
    "op13_target_resampling": op13_target_resampling,
}

ORACLES: dict[str, str] = {
    "op3_revisit_resolution": revisits.sql(),
    "op4_benchmark_decontamination": decontaminate.sql(),
    "op5_url_filter": url_filter.sql(URL_RULES),
}
