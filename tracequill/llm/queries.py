"""The registered queries of this subpackage; each is thin over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, fill_middle, filter_audit, language_id, media, mixing, near_dups, pieces, quality_rules, repeats, sql, surrogates, token_counts, token_files
from .common import remainder, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.round_trip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = classifier.train(docs, table(spark, sf_dir, "labels"))
    rows = classifier.score(docs.select("doc_id", "text"), weights)
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"))
    mark = lambda m: F.concat_ws(":", *[m[k].cast("string") for k in ("t", "f1", "f2", "dt")])
    feature = F.array_join(F.transform("landmarks", mark), " ")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_entities", "text")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language_id, op3_token_files, op4_quality_rules, op5_near_dups, op6_pieces, op7_token_counts, op8_quality_classifier, op9_media, op10_surrogates, op11_fill_middle, op12_filter_audit, op13_repeats)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
