"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; its rows are written as Parquet
and read again as the next stage's documents. All but the last keep the columns of
``documents``. Nulls, empty and very long texts, repeated rows, empty tables and
extra columns are treated as the stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vectab.llm.langid import fit_model, keep_known
from vectab.llm.minhash import keep_one
from vectab.llm.packing import pack_documents
from vectab.llm.pii import pseudonymise
from vectab.llm.quality import keep_good
from vectab.plans.scaling import cut_lineage

ORACLE_SQL = None  # tokenization and the trained model have no SQL form


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the quality rules."""
    return keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language is rejected, by a model of the stage's own labelled rows."""
    return keep_known(docs, fit_model(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms in place."""
    return pseudonymise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
