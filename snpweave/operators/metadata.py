"""Marker, sample and genotype metadata and their filter status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_markers_names
from ..model import WHITELIST
from .order import numbered, tile


def extract(dim: DataFrame, whitelist: bool = False, blacklist: bool = False) -> DataFrame:
    """Rows of a dimension by status; without a FILTERS column all are whitelisted.  CHROM, LOCUS and POS are strings."""
    if "FILTERS" not in dim.columns:
        dim = dim.withColumn("FILTERS", F.lit(WHITELIST))
    if whitelist:
        dim = dim.filter(F.col("FILTERS") == WHITELIST).drop("FILTERS")
    elif blacklist:
        dim = dim.filter(F.col("FILTERS") != WHITELIST)
    return dim.select(*[F.col(c).cast("string").alias(c) if c in ("CHROM", "LOCUS", "POS") else F.col(c) for c in dim.columns])


def live_genotypes(g: DataFrame, markers: DataFrame, individuals: DataFrame) -> DataFrame:
    return g.join(extract(markers, whitelist=True).select("MARKERS"), "MARKERS", "left_semi").join(extract(individuals, whitelist=True).select("INDIVIDUALS"), "INDIVIDUALS", "left_semi")


def list_filters(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("FILTERS") != WHITELIST).groupBy("FILTERS").agg(F.count(F.lit(1)).alias("N"))


def reset_filters(dim: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The chosen tags (all by default) become whitelist again."""
    hit = F.lit(True) if names is None else F.col("FILTERS").isin(names)
    return dim.withColumn("FILTERS", F.when(hit, WHITELIST).otherwise(F.col("FILTERS")))


def update_blacklist(log: DataFrame | None, bad: DataFrame, name: str, key: str = "MARKERS") -> DataFrame:
    new = bad.select(key, F.lit(name).alias("FILTER"))
    return new if log is None else log.unionByName(new)


def name_vcf_markers(m: DataFrame, source: str = "unknown", reference: bool = True) -> DataFrame:
    """CHROM, LOCUS, POS and COL by caller, and MARKERS; repeats keep one name.  A projection."""
    m = m.withColumn("CHROM", F.col("CHROM").cast("string") if reference else F.lit("1")).withColumn("POS", F.col("POS").cast("string"))
    locus = F.col("LOCUS").cast("string")
    empty = locus.isNull() | locus.isin("", ".")
    if source == "stacks" and not reference:
        m = m.withColumn("LOCUS", F.when(empty, F.col("VARIANT_ID").cast("string")).otherwise(F.split_part(locus, F.lit(":"), F.lit(1)))).withColumn("COL", (F.col("POS").cast("int") - 1))
    else:
        plain = F.regexp_replace(locus, "^locus_", "") if source == "ipyrad" else locus
        m = m.withColumn("LOCUS", F.when(empty, F.col("VARIANT_ID").cast("string")).otherwise(plain))
    for c in ("CHROM", "LOCUS", "POS"):
        m = m.withColumn(c, clean_markers_names(F.col(c)))
    return m.withColumn("MARKERS", F.concat_ws("__", "CHROM", "LOCUS", "POS"))


def repeats(m: DataFrame) -> DataFrame:
    """(VARIANT_ID, i): the place of each marker among those of its name, for names that stand more than once."""
    k = m.select("MARKERS", "VARIANT_ID")
    many = k.groupBy("MARKERS").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("MARKERS")
    return k.join(many, "MARKERS", "left_semi").select("VARIANT_ID", F.row_number().over(Window.partitionBy("MARKERS").orderBy("VARIANT_ID")).alias("i"))


def suffixed(m: DataFrame, again: DataFrame) -> DataFrame:
    j = m.join(again.withColumnRenamed("i", "__i"), "VARIANT_ID", "left")
    return j.withColumn("MARKERS", F.when(F.col("__i").isNotNull(), F.concat_ws("_", "MARKERS", F.col("__i").cast("string"))).otherwise(F.col("MARKERS"))).drop("__i")


def clean_vcf_markers(m: DataFrame, source: str = "unknown", reference: bool = True) -> DataFrame:
    """A marker table with names, ``_n`` on repeats, and M_SEQ in the order of VARIANT_ID."""
    m = name_vcf_markers(m, source, reference)
    return numbered(suffixed(m, repeats(m)), "M_SEQ", "VARIANT_ID")


def classify_selection(b: DataFrame) -> DataFrame:
    """BayeScan rows (BAYESCAN_MARKERS, POST_PROB, LOG10_PO, Q_VALUE, ALPHA, FST): selection type, evidence group, and FST quintile."""
    kind = F.when((F.col("ALPHA") >= 0) & (F.col("Q_VALUE") <= 0.05), "diversifying").when((F.col("ALPHA") >= 0) & (F.col("Q_VALUE") > 0.05), "neutral").otherwise("balancing")
    po = F.col("LOG10_PO")
    grp = F.when(po < 0.5, "no evidence").when(po < 1, "substantial").when(po < 1.5, "strong").when(po < 2, "very strong").otherwise("decisive")
    b = numbered(b.withColumn("SELECTION", kind).withColumn("PO_GROUP", grp), "__i", "FST", "BAYESCAN_MARKERS")
    return b.withColumn("FST_GROUP", tile(F.col("__i"), b.count(), 5)).drop("__i")


def stable_selection(runs: DataFrame) -> DataFrame:
    """Markers with one selection type in every iteration."""
    n = runs.agg(F.count_distinct("ITERATION").alias("k"))
    a = runs.groupBy("BAYESCAN_MARKERS").agg(F.count_distinct("SELECTION").alias("s"), F.count_distinct("ITERATION").alias("i"), F.min("SELECTION").alias("SELECTION"))
    return a.crossJoin(F.broadcast(n)).filter("s = 1 and i = k").select("BAYESCAN_MARKERS", "SELECTION")
