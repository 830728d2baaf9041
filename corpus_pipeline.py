"""The corpus pipeline: quality, near duplicates, personal data, mixing, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all that
its predecessor kept and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.

Defined results. Null and empty texts are judged by the quality classifier like any other; those
that it keeps are near copies of each other, so one stays. Repeated rows, and all but one of a group
of near copies, go. Null ids and sources are values like any other; a null id comes last where the
smallest of a group stays. Extra columns are passed on up to the packing, whatever their names. An
empty table gives an empty result. Personal data become their kind in angle brackets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import mixing, packing, pii, quality, simhash
from lamina.llm.common import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies stays."""
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data become their kind in angle brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of full windows, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # trained models, fingerprints and a tokenizer are beyond SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage passes on lies in the shared checkpoint folder until the next has been written; the
    last one's result is read from there, so it goes when the interpreter ends.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
