"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kdsearch, licenses, linededup, mixing, quality, sharding, simhash, tokenfiles, urlfilter
from .common import spread, table, tokenizer_path


def op1_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kdsearch.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *quality.FEATURES[:5], "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = urlfilter.bad_pages(pages)
    return urlfilter.judge_urls(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("spans")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.5, growth=1.0, seed=17)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return classes.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.coded_digests(docs, tokenizer_path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.new_path(spark)
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return tokenfiles.token_digests(tokenfiles.read_tokens(spark, path))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_lines(docs, linededup.line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_top_k,
        op2_quality_rules,
        op3_url_filter,
        op4_license_scan,
        op5_mix_sources,
        op6_simhash_near_dedup,
        op7_bpe_round_trip,
        op8_token_files,
        op9_byte_shards,
        op10_line_dedup,
    )
}

SQL: dict[str, str] = {
    "op1_kd_top_k": kdsearch.SQL,
    "op2_quality_rules": quality.SQL,
    "op3_url_filter": urlfilter.SQL,
    "op5_mix_sources": mixing.SQL,
    "op10_line_dedup": linededup.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
