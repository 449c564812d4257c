"""A training-corpus pipeline: quality filter, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written
as Parquet and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import mixing, packing, quality, simhash
from spindrift.llm.common import materialize, table
from spindrift.llm.queries import PACK_TOKENIZER


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are read to tempered weights; a document is there once for each time it is read."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and dealt into token sequences."""
    return packing.pack(docs, PACK_TOKENIZER())


STAGES = [
    ("quality classifier", filter_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the SimHash search and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
