"""Exact Hardy-Weinberg test with mid p-values, without a UDF.

For given allele counts the probability of h heterozygotes follows from that of h - 2 by a factor; the logarithms
of the factors are summed by a window over h, for each distinct triple of genotype counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import genotype_counts

LEVELS = (0.05, 0.01, 0.001, 0.0001, 0.00001)


def mid_p(triples: DataFrame) -> DataFrame:
    """(AA, AB, BB) -> MID_P_VALUE: all tables at most as likely as the observed one, which itself counts half."""
    t = triples.select("AA", "AB", "BB").distinct()
    n = F.col("AA") + F.col("AB") + F.col("BB")
    rare = F.least(2 * F.col("AA") + F.col("AB"), 2 * F.col("BB") + F.col("AB"))
    t = t.withColumn("n", n).withColumn("rare", rare).withColumn("h", F.explode(F.sequence(F.col("rare") % 2, F.col("rare"), F.lit(2).cast("long"))))
    h = F.col("h")
    before = (F.col("rare") - h + 2) / 2
    factor = 4 * before * (F.col("n") - (h - 2) - before) / (h * (h - 1))
    first = h == F.col("rare") % 2
    w = Window.partitionBy("AA", "AB", "BB")
    t = t.withColumn("ll", F.sum(F.when(first, 0.0).otherwise(F.ln(F.when(first, F.lit(1.0)).otherwise(factor)))).over(w.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("rel", F.exp(F.col("ll") - F.max("ll").over(w))).withColumn("mine", F.max(F.when(h == F.col("AB"), F.col("rel"))).over(w))
    a = t.groupBy("AA", "AB", "BB").agg(F.sum(F.when(F.col("rel") <= F.col("mine") * 1.0000001, F.col("rel")).otherwise(0.0)).alias("low"), F.sum("rel").alias("all"), F.first("mine").alias("mine"))
    return a.select("AA", "AB", "BB", F.round((F.col("low") - F.col("mine") / 2) / F.col("all"), 9).alias("MID_P_VALUE"))


def hwe(g: DataFrame, overall: bool = False, smallest: int = 10) -> DataFrame:
    """Test of each marker and stratum; strata of fewer than ``smallest`` samples are set aside."""
    c = genotype_counts(g, "MARKERS", "STRATA")
    big = g.select("STRATA", "INDIVIDUALS").distinct().groupBy("STRATA").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= smallest).select("STRATA")
    c = c.join(big, "STRATA", "left_semi")
    if overall:
        c = c.unionByName(genotype_counts(g, "MARKERS").withColumn("STRATA", F.lit("OVERALL")).select(c.columns))
    c = c.select("MARKERS", "STRATA", F.col("N0").alias("AA"), F.col("N1").alias("AB"), F.col("N2").alias("BB")).filter("AA + AB + BB > 0")
    mono = ((F.col("AA") == 0).cast("int") + (F.col("AB") == 0).cast("int") + (F.col("BB") == 0).cast("int")) >= 2
    j = c.join(mid_p(c), ["AA", "AB", "BB"]).withColumn("MONO", mono)
    p = F.col("MID_P_VALUE")
    stars = F.lit("hwe")
    for i, level in enumerate(LEVELS):
        stars = F.when(p <= level, "*" * (i + 1)).otherwise(stars)
    return j.select("MARKERS", "STRATA", "AA", "AB", "BB", "MONO", "MID_P_VALUE", (p >= 0.05).alias("HWE"), stars.alias("SIGNIFICANCE"))


def blacklist(tests: DataFrame, n_strata: int | None = None, level: int = 4) -> DataFrame:
    """Markers out of equilibrium at ``level`` stars in exactly ``n_strata`` real strata (default: all tested)."""
    real = tests.filter("STRATA <> 'OVERALL'")
    if n_strata is None:
        n_strata = real.select("STRATA").distinct().count()
    bad = real.withColumn("x", (F.col("SIGNIFICANCE") != "hwe") & (F.length("SIGNIFICANCE") >= level)).groupBy("MARKERS").agg(F.count_if("x").alias("N_HWD"))
    return bad.filter(F.col("N_HWD") == n_strata)
