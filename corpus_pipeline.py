"""The corpus pipeline: documents to packed sequences.

Toxic documents go, one document of each group of near copies stays, personal data is replaced, sources
are mixed to their target weights, and what is left is packed. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of documents. ``run`` writes every stage as
Parquet to the shared folder and hands the next stage what it reads back, so a lost executor costs the
stage at hand at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import materialise
from folioflow.llm.mixing import apply_mix
from folioflow.llm.ngram_join import keep_one
from folioflow.llm.packing import pack_documents
from folioflow.llm.pii import sanitise
from folioflow.llm.queries import vocabulary
from folioflow.llm.toxicity import keep_clean


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return keep_clean(docs, labels)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five words, a similarity of 0.8 or more."""
    return keep_one(docs, words=5, units=(80, 100))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    return sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return pack_documents(docs, vocabulary(), end_id=1, length=2048)


STAGES = [("toxicity", clean), ("near copies", unlike), ("personal data", private), ("mix", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the random mix; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
