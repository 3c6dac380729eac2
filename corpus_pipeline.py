"""From raw documents to packed training sequences, in stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. `run` writes every stage's result to the shared folder as
Parquet and reads it again for the next. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, language, neardup, packing, secrets
from granary.llm.common import stored
from granary.llm.queries import table, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no language (no text, or no letter in it).

    `lang` becomes the predicted language. Profiles are learnt from the labelled
    part of these documents.
    """
    profiles = language.language_profiles(docs.where(~language.is_held_out(F.col("doc_id"))))
    found = language.identify(docs, profiles).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one of least id.

    Rows of one id are one document: all its different texts stay together, and only
    rows that repeat both id and text are dropped.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; drop documents that are mostly such."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found, in place; no document is dropped."""
    return secrets.redact_secrets(docs, secrets.trained(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left into windows."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Trained profiles, signatures and token ids are beyond SQL; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
