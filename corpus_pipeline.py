"""Cleaning a corpus: five stages over `documents`, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next.
All but the last return the columns that they were given, whatever extra columns there are. An empty table passes
through every stage, with the stage's columns and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, pieces, rules, substrings
from tessera.llm.common import made, release, small_batches, staged, table
from tessera.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those that fail the base rules (null, empty and wordless texts too) and the outliers
    of their language and source. Equal rows stay or go together; a null language or source is a group of its own."""
    return rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Null and wordless texts are one group; of rows that repeat an id one stays; a null id stays only where no other does.
    """
    small_batches(spark)
    return neardup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that occur elsewhere too are removed from the texts, and n_chars follows.

    A null text stays null; a text of which nothing is left stays as an empty one; repeats inside one text count.
    """
    small_batches(spark)
    return substrings.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of eight words of any benchmark item (a shorter item: all its words) go.

    Null and empty texts hold none and stay; equal rows stay or go together.
    """
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), at_least=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the text that they decode to; null ids and text for a null text, every row answered."""
    small_batches(spark)
    return pieces.transduce(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL has no expression for most stages; tests/llm holds each stage and the whole against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves in the shared folder goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
        release(spark, before, keep=docs)
    return docs
