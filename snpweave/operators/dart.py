"""Genotypes from presence and count tables with one or two rows for each marker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from ..functions.names import clean_markers_names


def one_row(long: DataFrame) -> DataFrame:
    """Codes 0 (reference only), 1 (alternate only), 2 (both) as counts of presence; others are missing."""
    c = F.col("VALUE").cast("string")
    return long.withColumn("REF_COUNT", F.when(c.isin("0", "2"), 1).when(c == "1", 0)).withColumn("ALT_COUNT", F.when(c.isin("1", "2"), 1).when(c == "0", 0)).drop("VALUE")


def two_rows(long: DataFrame, counts: bool = False) -> DataFrame:
    """Rows 1 (reference) and 2 (alternate) of a marker side by side; ``ROW`` orders them, counts become presence unless wanted."""
    v = F.expr("try_cast(VALUE as long)")
    if not counts:
        v = (v > 0).cast("long")
    side = F.row_number().over(Window.partitionBy("VARIANT_ID", "TARGET_ID").orderBy("ROW"))
    return long.withColumn("s", side).groupBy("VARIANT_ID", "TARGET_ID").agg(F.max(F.when(F.col("s") == 1, v)).alias("REF_COUNT"), F.max(F.when(F.col("s") == 2, v)).alias("ALT_COUNT"))


def genotyper(x: DataFrame, counts: bool = True) -> DataFrame:
    """GT_BIN from both counts, with depths for count data; zeros of missing genotypes are missing."""
    r, a = F.col("REF_COUNT"), F.col("ALT_COUNT")
    if not counts:
        return x.withColumn("GT_BIN", gt.gt_bin_from_presence(r, a))
    g = gt.gt_bin_from_depth(r, a)
    none = lambda c: F.when(g.isNull() & (c == 0), None).otherwise(c)
    return x.select("*", g.alias("GT_BIN"), none(r + a).alias("READ_DEPTH"), none(r).alias("ALLELE_REF_DEPTH"), none(a).alias("ALLELE_ALT_DEPTH"))


def markers_metadata(m: DataFrame) -> DataFrame:
    """CHROM, LOCUS, POS, REF, ALT and MARKERS from (ALLELE_ID, SNP, SNP_POSITION): LOCUS before ``|``, REF and ALT the first and last capital of SNP."""
    locus = F.split_part("ALLELE_ID", F.lit("|"), F.lit(1))
    pos = F.coalesce(F.col("SNP_POSITION").cast("string"), F.lit("1"))
    m = m.withColumn("CHROM", F.lit("CHROM_1")).withColumn("LOCUS", clean_markers_names(locus)).withColumn("POS", pos)
    m = m.withColumn("REF", F.regexp_extract("SNP", r"([A-Z])", 1)).withColumn("ALT", F.regexp_extract("SNP", r"([A-Z])[^A-Z]*$", 1))
    return m.withColumn("MARKERS", F.concat_ws("__", "CHROM", "LOCUS", "POS"))


def tidy_metadata(m: DataFrame) -> DataFrame:
    """Distinct markers with REF and ALT after the colon of SNP, split by ``>``."""
    alleles = F.split_part("SNP", F.lit(":"), F.lit(2))
    part = lambda k: F.split_part(alleles, F.lit(">"), F.lit(k))
    locus = F.split_part("LOCUS", F.lit("|"), F.lit(1))
    m = m.dropDuplicates(["LOCUS", "SNP", "POS", "CALL_RATE"])
    return m.select(F.concat_ws("__", F.lit("CHROM_1"), locus, F.col("POS").cast("string")).alias("MARKERS"), F.lit("CHROM_1").alias("CHROM"), locus.alias("LOCUS"), F.col("POS").cast("string").alias("POS"), part(1).alias("REF"), part(2).alias("ALT")).distinct()


def too_many_rows(m: DataFrame) -> DataFrame:
    """Markers with more than two rows: the file is broken."""
    return m.groupBy("MARKERS").agg(F.count(F.lit(1)).alias("N")).filter("N > 2")


def calibrate(x: DataFrame, flagged: DataFrame) -> DataFrame:
    """Swap both counts of the flagged markers."""
    f = flagged.select("MARKERS").distinct().withColumn("__f", F.lit(True))
    j = x.join(f, "MARKERS", "left")
    swap = {"REF_COUNT": "ALT_COUNT", "ALT_COUNT": "REF_COUNT"}
    return j.select(*[F.when(F.col("__f"), F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in x.columns])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two long tables on their common columns; markers with more than two alleles go; REP_AVG and CALL_RATE become the marker's mean (rounded to 6)."""
    common = [c for c in a.columns if c in b.columns]
    u = a.select(*common).unionByName(b.select(*common))
    al = u.select("MARKERS", F.explode(F.array("REF", "ALT")).alias("x")).groupBy("MARKERS").agg(F.count_distinct("x").alias("n")).filter("n > 2")
    u = u.join(al, "MARKERS", "left_anti")
    w = Window.partitionBy("MARKERS")
    for c in ("CALL_RATE", "REP_AVG", "AVG_COUNT_REF", "AVG_COUNT_ALT"):
        if c in common:
            u = u.withColumn(c, F.round(F.avg(c).over(w), 6))
    return u


def switch_allele_count(code, ref: bool = True):
    """The reference (or alternate) presence of a one-row code."""
    return F.when(code == 2, 1).when(code == (0 if ref else 1), 1).when(code.isNotNull(), 0)


def genotyping_strategy(n_markers: int) -> list[str]:
    """Extra encodings worth building at this number of markers."""
    return ["GT_VCF", "GT_VCF_NUC", "GT"] if n_markers < 5000 else ["GT_VCF"] if n_markers < 30000 else []
