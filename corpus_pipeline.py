"""From raw documents to packed batches: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of `documents`.  No stage can be told in SQL as a whole (a trained network,
sketches, suffix order), so ORACLE_SQL is None; `tests/llm` compares the pipeline with a brute-force version.

Cases.  Every stage takes the five columns of `documents` and leaves others behind, whatever their names.  A null text counts as empty where it is
judged, and stays null; nulls in other columns pass through, and rows without doc_id are kept as documents of their own.  Long texts are taken whole.
Repeated rows are told apart by no stage but `near_copies`.  An empty table of documents gives no rows; without labels or benchmark items the stage
that needs them rejects nothing, or by the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import length_buckets, order_minhash, quality_net, queries, suffix_dedup, template_leaks
from strandline.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts get the score of the zero vector; equal texts get equal scores, so ties and repeated rows
    stay or go together.  Without labels all scores are 0.5, and every document stays."""
    return quality_net.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, with all rows that bear it.  Null, empty and blank texts are near to none and
    stay, and so do rows without doc_id."""
    return order_minhash.kept(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 200-byte strings that come elsewhere too are cut out of the texts; every document stays, and a character that loses a byte goes whole.  Both of two
    equal passages go, those of repeated rows too.  Null texts stay null, with null n_chars."""
    rows = suffix_dedup.dedup(docs.select(*COLUMNS), ["lang", "source"])
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers and names, go.  Null and empty texts hold none and stay; rows with equal doc_id and text go
    together.  Items without text, or with fewer than three ordinary words, match nothing."""
    return template_leaks.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document that is left, repeated rows each in a place of their own.  Null and empty texts have the end id alone."""
    return length_buckets.packed(docs, queries._tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
