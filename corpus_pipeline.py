"""A training corpus from raw documents: language ID, SimHash near-dedup, suffix-array dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``docs``. Between stages the rows are written as Parquet and read again, so a
lost executor costs one stage's work at most; a stage's copy goes once the next stage's is written.

Defined cases, of every stage: an empty table gives an empty table; other columns, whatever their names,
come through all stages but the last. Texts that are null, empty or without letters go in the first
stage, as do texts that no language is sure of. Rows that repeat an id and a text are one document,
and one stays; two texts under one id are two documents; null ids come last in their group. Very
long texts are read whole. Ties (documents of one age) fall to the smaller hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import language, packing, secrets, simhash, suffixes
from quarrylake.llm.common import materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters and unsure ones go."""
    return language.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; documents with nothing left go."""
    return _counted(suffixes.cut_texts(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: The stages learn models and run a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
