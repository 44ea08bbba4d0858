"""Marker counts kept up to date from a stream of genotype files.

The library's statistics are functions of additive sums (copies and missing by marker), so a stream of new samples
keeps them by a streaming aggregate; ``stats`` formulas apply to its output unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import stats

SCHEMA = "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int"


def genotype_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def marker_counts(stream: DataFrame) -> DataFrame:
    """N0, N1, N2, N and TOTAL by marker; write with output mode ``complete`` or ``update``."""
    return stats.genotype_counts(stream, "MARKERS")
