"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import decontaminate, near_copies, packing, pii, quality_rules, simhash
from skarn.llm.common import drop_since, mark, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that SimHashes at op10's two bits link."""
    return simhash.deduplicate(docs)


def near_copy_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that these links or five-word shingles with a similarity of 0.8 join."""
    return near_copies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_copy_classes), ("decontamination", decontamination), ("privacy", privacy), ("packing", packed)]

#: SimHash and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each over all that its predecessor kept.

    Null and empty texts are rejected by the first stage, which asks for fifty
    words; of repeated rows the second keeps one; null ids pass every stage and
    stay null; an empty table gives no rows; columns beside doc_id and text are
    carried along up to the last stage, whatever their names.  What a stage
    stashed is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        point = mark()
        docs = stash(stage(spark, docs, sf_dir))
        drop_since(spark, point, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)
