"""A training-data pipeline over ``documents``: five stages, each an operator
of ``quorum.llm``, each written and read again before the next.

quality rules -> line dedup -> SimHash near-dedup -> benchmark
decontamination -> byte-level BPE.  All stages but the last return the
columns of ``documents`` (``n_chars`` follows the text).

Defined results: null and empty texts fail the quality rules and go; repeated
rows are copies, of which one stays; an empty table gives an empty result;
columns beside those of ``documents`` pass through all stages but the last,
whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm import bpe, decontaminate, quality, simhash, templates
from quorum.llm.common import read, saved

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, frequent lines are removed."""
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go."""
    return _counted(templates.drop_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly such."""
    return _counted(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and digests of the encoded texts."""
    texts = docs.select("doc_id", "lang", "source", "text")      # other columns may have the new ones' names
    return bpe.encode(texts, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digests=True,
                      max_pieces=200_000, max_states=80_000).select(
        "doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("tokens", tokens)]

#: hashes, components and the merge rule have no SQL form; tests/llm holds the operators to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
