"""A corpus pipeline of five stages over the table documents. Every stage works on all that the one before it kept.

Defined results: null texts and those without words are rejected by the first stage, however many; null ids are kept as
rows of their own unless their text repeats; repeated rows and near copies leave one row; texts of any length are worked
on whole; stages but the last keep the columns of documents, n_chars following the text; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenry.llm import ngram_join, packing, quality, secrets, substrings
from lumenry.llm.common import documents, stored

#: Near duplicates among documents: five-word shingles, a similarity of 0.8 or more.
NEAR = ngram_join.Join(n=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the least doc_id stays."""
    return ngram_join.keep_one(docs, NEAR)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand at two places or more go from all texts."""
    return substrings.remove_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dealt into batches of a token budget."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: The stages' networks, suffix arrays and dynamic programs aren't SQL; tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every other stage is written as Parquet in the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
