"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lang_spans, length_buckets, media_chunks, order_minhash, quality_net, spelling_forms, suffix_dedup, tag_paths, template_leaks, token_files, two_fit, url_lists
from .common import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(table(spark, sf_dir, "documents"), _tokenizer())


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_rows(table(spark, sf_dir, "documents"))


def op2_lang_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_spans.language_rows(table(spark, sf_dir, "documents"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.packed(table(spark, sf_dir, "documents"), _tokenizer())


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.verdicts(table(spark, sf_dir, "pages"))


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages"))


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_rows(table(spark, sf_dir, "documents"))


def op11_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit.packed_rows(table(spark, sf_dir, "documents"), _tokenizer())


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms.forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lang_spans": op2_lang_spans,
    "op3_length_buckets": op3_length_buckets,
    "op4_order_minhash": op4_order_minhash,
    "op5_url_lists": op5_url_lists,
    "op6_template_leaks": op6_template_leaks,
    "op7_tag_paths": op7_tag_paths,
    "op8_quality_net": op8_quality_net,
    "op9_media_chunks": op9_media_chunks,
    "op10_token_files": op10_token_files,
    "op11_two_fit": op11_two_fit,
    "op12_spelling_forms": op12_spelling_forms,
}

ORACLES: dict[str, str] = {
    "op5_url_lists": url_lists.ORACLE,
    "op6_template_leaks": template_leaks.ORACLE,
    "op12_spelling_forms": spelling_forms.ORACLE,
}
