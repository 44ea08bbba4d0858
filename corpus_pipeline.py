"""The corpus pipeline: five of the subpackage's operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result to the shared folder, so a lost
executor never costs more than one stage.  The mix of the last stage comes back sorted by training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality
from snpweave.llm.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), threshold=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that 3 documents hold stay in the largest doc_id only; n_chars follows."""
    out = line_dedup.line_dedup(docs, min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group at 0.8 on sets of 5-word shingles stays."""
    return minhash_dedup.keep_one(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak items of the benchmark go."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("source_mixing", mixed),
]

#: the trained network and the verified seeds are beyond SQL; stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
