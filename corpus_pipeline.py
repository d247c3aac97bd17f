"""The corpus pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept with the columns of documents (the last: packed
pieces), written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import Scratch
from affinis.llm.minhash import near_duplicates
from affinis.llm.packing import pack_documents
from affinis.llm.pii import redact
from affinis.llm.suffixdedup import remove_repeats
from affinis.llm.toxicity import fit_toxicity, held_out, score_toxicity, without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of 0.5 or more; learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return without_toxic(docs, fit_toxicity(docs, labels)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, 0.8)."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a smaller document has, in whole characters."""
    return remove_repeats(docs, whole_chars=True, carry=["lang", "source"]).withColumn("text", F.decode("kept", "UTF-8")).transform(lambda d: _counted(d.withColumn("n_chars", F.lit(0))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of every document that is left."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_dedup), ("repeated passages", suffix_dedup), ("personal data", personal_data), ("packing", packing)]

#: Learned scores, hashing and tokenisation are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
