"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All stages but the last keep the columns of documents, those with the name of an operator's result too.  Rows of the last may repeat: mixing emits documents several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, simhash, toxicity
from quarry.llm.common import Own, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored at or above the threshold go."""
    own = Own(docs)
    scored = toxicity.score(own.rows, table(spark, sf_dir, "labels"), own.name("text"), own.name("doc_id"), label_id="doc_id")
    return own.restored(scored.where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one row of each component stays, also where rows share a doc_id or have none."""
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as often as the mix takes it."""
    own = Own(docs)
    mixed = mixing.mix(own.rows, own.name("text"), own.name("source"), own.name("doc_id")).where("copies > 0")
    return own.restored(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids of every emitted document, by count and digest as in op1."""
    return bpe.encode_decode(docs, keep=["doc_id", "source"], digests=True)


STAGES = [("toxicity", reject_toxic), ("simhash_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Neither the classifier nor XXH64 fingerprints are expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for nr, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nr < len(STAGES) - 1:
            docs, _ = written(docs)
    return docs
