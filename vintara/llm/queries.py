"""The queries of this subpackage, each one operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, mixing, phrases, pieces, quality, resampling, simhash, suffix_dedup, token_counts, token_files, url_filter, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that stands in for a block list here: the URLs of all pages of some stated sites."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, pages.where(url_filter.host_of(F.col("url")).rlike(url_filter.LISTED_SITES)).select("url"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_round_trip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_source_mixing,
        op3_suffix_dedup,
        op4_exact_dedup,
        op5_warc_round_trip,
        op6_language_id,
        op7_url_filter,
        op8_token_counts,
        op9_sentencepiece,
        op10_simhash,
        op11_phrase_mining,
        op12_token_files,
        op13_importance_resampling,
    )
}
SQL: dict[str, str] = {
    "op2_source_mixing": mixing.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_warc_round_trip": warc.SQL,
    "op7_url_filter": url_filter.SQL,
    "op11_phrase_mining": phrases.SQL,
    "op13_importance_resampling": resampling.SQL,
}
