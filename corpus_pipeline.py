"""The corpus pipeline: documents to packed sequences, each stage written and read again.

A filtering stage drops only what its own decision rejects; a stage on an empty table gives an empty table; nulls are
handled as each operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import langid, mixing, packing, pii, simhash
from quillon.llm.queries import tokenizer_files
from quillon.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; ``lang`` becomes the predicted one."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return simhash.keep_first(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced in the text."""
    return pii.sanitize(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled into the mix."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [("language", language), ("near_copies", near_copies), ("privacy", privacy), ("mix", mix), ("pack", pack)]

#: No SQL expresses the language model, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces packed from the documents under ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
