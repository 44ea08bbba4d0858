"""Strata: reading, cleaning, relabelling, joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def clean_strata(s: DataFrame, levels: list[str] | None = None, labels: list[str] | None = None, select: list[str] | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Distinct cleaned samples and strata, relabelled, selected, without blacklisted ids."""
    if "POP_ID" in s.columns:
        s = s.withColumnRenamed("POP_ID", "STRATA")
    s = s.withColumn("INDIVIDUALS", names.clean_ind_names(F.col("INDIVIDUALS"))).withColumn("STRATA", names.clean_pop_names(F.col("STRATA"))).distinct()
    if select is not None:
        s = s.filter(F.col("STRATA").isin(select))
    if labels is not None:
        s = change_pop_names(s, levels or [], labels)
    if blacklist is not None:
        s = s.join(blacklist.select(names.clean_ind_names(F.col("INDIVIDUALS")).alias("INDIVIDUALS")).distinct(), "INDIVIDUALS", "left_anti")
    return s


def read_strata(spark: SparkSession, path: str, **options) -> DataFrame:
    return clean_strata(spark.read.csv(path, sep="\t", header=True), **options)


def check_pop_levels(levels: list[str] | None, labels: list[str] | None) -> None:
    if labels is not None and (levels is None or len(levels) != len(labels)):
        raise ValueError("labels need as many levels")


def change_pop_names(s: DataFrame, levels: list[str], labels: list[str]) -> DataFrame:
    check_pop_levels(levels, labels)
    out = F.col("STRATA")
    for a, b in zip(levels, labels, strict=True):
        out = F.when(F.col("STRATA") == a, b).otherwise(out)
    return s.withColumn("STRATA", out)


def join_strata(g: DataFrame, s: DataFrame) -> DataFrame:
    """Samples in both; the strata's column replaces the table's."""
    return g.drop("STRATA").join(s.select("INDIVIDUALS", "STRATA"), "INDIVIDUALS")


def generate_strata(g: DataFrame) -> DataFrame:
    return g.select("STRATA", "INDIVIDUALS").distinct()


def individuals2strata(i: DataFrame, start: int, end: int) -> DataFrame:
    return i.select("INDIVIDUALS", F.substring("INDIVIDUALS", start, end - start + 1).alias("STRATA"))


def summary_strata(s: DataFrame) -> DataFrame:
    return s.groupBy("STRATA").agg(F.count(F.lit(1)).alias("N"))


def duplicate_ids(s: DataFrame) -> DataFrame:
    return s.groupBy("INDIVIDUALS").agg(F.count(F.lit(1)).alias("N")).filter("N > 1")


def check_targets(strata: DataFrame, targets: DataFrame) -> DataFrame:
    """TARGET_ID of one side only, and which side."""
    a, b = strata.select("TARGET_ID").distinct(), targets.select("TARGET_ID").distinct()
    return a.join(b, "TARGET_ID", "left_anti").withColumn("ONLY_IN", F.lit("strata")).unionByName(b.join(a, "TARGET_ID", "left_anti").withColumn("ONLY_IN", F.lit("data")))


def strata_haplo(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a haplotype file's header; the stratum is the id up to the first ``-`` or ``_``."""
    head = spark.read.text(path).limit(1).select(F.posexplode(F.split("value", "\t")).alias("p", "INDIVIDUALS")).filter("p > 1")
    return head.select("INDIVIDUALS", F.regexp_extract("INDIVIDUALS", r"^([^-_]+)", 1).alias("STRATA"))
