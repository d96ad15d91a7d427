"""From documents to packed sequences: quality rules, line dedup, near-duplicate removal, substring dedup, packing.

Every stage takes whole texts, one row for each row of its input that it keeps, and returns all columns of its input but for the last one.
Rows that repeat id and text are judged alike.  Columns other than doc_id, text and lang are carried as they are, whatever their names.
An empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import jaccard_join, line_dedup, packing, quality_rules, substring_dedup
from quire.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, texts unchanged.  Null, empty and blank texts and those of fewer than ten words go; null languages are a stratum of their own."""
    return quality_rules.filter_docs(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; multi-line chunks that stand elsewhere under a smaller id, or earlier in the text, are cut out of the texts.  Null texts stay null."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id (all its rows); rows with a null id and texts without words stay."""
    return jaccard_join.drop_near(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; runs of repeated chunks of 80 bytes or more are cut out of the texts but for one place each.  Null texts stay null."""
    return substring_dedup.dedup_substrings(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in the document and in a sequence of at most 2048 tokens.  Null and empty texts are one token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next.  An empty table gives no pieces."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out if k == 0 else written(out), sf_dir)
    return out


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
