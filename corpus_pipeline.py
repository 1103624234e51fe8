"""A training corpus from ``documents``: identified languages, no site boilerplate, no near copies,
mixed sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agendaflow.llm import language, lines, mixing, neardup, packing
from agendaflow.llm.shared import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # copies are still there: they must not make their own lines common
    return lines.clean_documents(docs, least_texts=lines.LEAST_TEXTS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language model, the register hashes and the block draws have no SQL form; tests compare the
#: rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole of ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.clear(keep=1)  # the stages before have been read
    return STAGES[-1][1](spark, docs, sf_dir)
