"""Heterozygosity of markers, or of the SNPs of a locus (a read, a haplotype): summaries, threshold tables, blacklists.

Threshold tables say how many units (markers or loci) would stay at every threshold.  Units are put in bins of the thresholds
once; units with the same bins in the same number of strata are one pattern, and the table is made from the patterns: a sum
along each axis, in place of a filter for each threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

#: fixed values: thresholds of heterozygosity, and of its difference within a locus
LEVELS, STEPS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
OVERALL = "OVERALL"


def _unit(approach: str) -> str:
    if approach not in ("haplotype", "SNP"):
        raise ValueError(f"no such approach: {approach}")
    return "LOCUS" if approach == "haplotype" else "MARKERS"


def summary(g: DataFrame, approach: str = "haplotype") -> DataFrame:
    """(unit, STRATA, HET_MEAN, HET_MIN, HET_MAX, HET_DIF, MISSING_PROP) by stratum and OVERALL.

    A unit is a locus (``haplotype``: over its SNPs) or a marker (``SNP``: all alike, no difference).  Heterozygosity is that of called
    genotypes; a sample without a call at any SNP of the unit is missing.  Strata where nobody is called have no row.
    """
    unit = _unit(approach)
    keys = ["CHROM", "LOCUS"] if unit == "LOCUS" else ["MARKERS"]
    both = g.withColumn("STRATA", F.explode(F.array(F.col("STRATA"), F.lit(OVERALL))))
    o = both.groupBy(*dict.fromkeys([*keys, "MARKERS", "STRATA"])).agg(F.avg((F.col("GT_BIN") == 1).cast("int")).alias("h")).filter("h is not null")
    h = o.groupBy(*keys, "STRATA").agg(F.avg("h").alias("HET_MEAN"), F.min("h").alias("HET_MIN"), F.max("h").alias("HET_MAX")).withColumn("HET_DIF", F.col("HET_MAX") - F.col("HET_MIN"))
    seen = both.groupBy(*keys, "STRATA", "INDIVIDUALS").agg(F.count("GT_BIN").alias("n"))
    m = seen.groupBy(*keys, "STRATA").agg(F.avg((F.col("n") == 0).cast("int")).alias("MISSING_PROP"))
    r = lambda c: F.round(c, 9).alias(c)
    return h.join(m, [*keys, "STRATA"]).select(*keys, "STRATA", r("HET_MEAN"), r("HET_MIN"), r("HET_MAX"), r("HET_DIF"), r("MISSING_PROP"))


def _bin(c: str, levels: tuple[float, ...]) -> Column:
    """How many thresholds are under the value: it is within those from there on."""
    return sum((F.col(c) > x).cast("int") for x in levels)


def threshold_table(s: DataFrame, strata: int) -> DataFrame:
    """(SCOPE, HET_THRESHOLD, DIF_THRESHOLD, OUTLIERS, WHITELIST, BLACKLIST) of a ``summary`` over ``strata`` strata.

    With at most OUTLIERS strata beyond the thresholds (a stratum where the unit is not called is beyond), WHITELIST units stay.
    A null threshold is not applied.  SCOPE OVERALL looks at all samples together.
    """
    keys = [c for c in s.columns if c in ("CHROM", "LOCUS", "MARKERS")]
    value = "HET_MAX" if "LOCUS" in keys else "HET_MEAN"
    b = s.select(*keys, F.when(F.col("STRATA") == OVERALL, OVERALL).otherwise("STRATA").alias("SCOPE"), _bin(value, LEVELS).alias("h"), _bin("HET_DIF", STEPS).alias("d"))
    cells = b.groupBy(*keys, "SCOPE", "h", "d").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pattern = cells.groupBy(*keys, "SCOPE").agg(F.array_sort(F.collect_list(F.struct("h", "d", "n"))).alias("p")).groupBy("SCOPE", "p").agg(F.count(F.lit(1)).alias("units"))
    level = [F.struct(F.lit(i).alias("i"), F.lit(x).alias("HET_THRESHOLD")) for i, x in enumerate(LEVELS)]
    step = [F.struct(F.lit(i).alias("j"), F.lit(x).alias("DIF_THRESHOLD")) for i, x in enumerate(STEPS)] if "LOCUS" in keys else []
    free = F.struct(F.lit(len(LEVELS)).alias("i"), F.lit(None).cast("double").alias("HET_THRESHOLD"))
    loose = F.struct(F.lit(len(STEPS)).alias("j"), F.lit(None).cast("double").alias("DIF_THRESHOLD"))
    x = pattern.select("*", F.explode(F.array(*level, free)).alias("a")).select("*", F.explode(F.array(*step, loose)).alias("b")).filter("a.HET_THRESHOLD is not null or b.DIF_THRESHOLD is not null")
    within = F.aggregate(F.filter("p", lambda c: (c["h"] <= F.col("a.i")) & (c["d"] <= F.col("b.j"))), F.lit(0), lambda acc, c: acc + c["n"])
    all_ = F.when(F.col("SCOPE") == OVERALL, 1).otherwise(strata)
    x = x.select("SCOPE", "a.HET_THRESHOLD", "b.DIF_THRESHOLD", (all_ - within).alias("o"), all_.alias("most"), "units")
    at = ["SCOPE", "HET_THRESHOLD", "DIF_THRESHOLD"]
    # the table itself is small: thresholds x strata
    t = x.select(*at, "units", F.explode(F.sequence("o", "most")).alias("OUTLIERS")).groupBy(*at, "OUTLIERS").agg(F.sum("units").alias("WHITELIST"))
    total = pattern.groupBy("SCOPE").agg(F.sum("units").alias("total"), F.max(all_).alias("most"))
    grid = x.select(*at).distinct().join(total, "SCOPE").select("*", F.explode(F.sequence(F.lit(0), "most")).alias("OUTLIERS"))
    same = [grid[c].eqNullSafe(t[c]) for c in (*at, "OUTLIERS")]
    out = grid.join(t, same, "left").select(*[grid[c] for c in (*at, "OUTLIERS")], F.coalesce(t["WHITELIST"], F.lit(0)).cast("long").alias("WHITELIST"), grid["total"])
    return out.withColumn("BLACKLIST", F.col("total") - F.col("WHITELIST")).drop("total").filter((F.col("SCOPE") != OVERALL) | (F.col("OUTLIERS") == 0))


def blacklist(g: DataFrame, approach: str = "haplotype", scope: str = "pop", threshold: float = 1.0, dif: float = 1.0, outliers: int = 1) -> DataFrame:
    """MARKERS of units over the thresholds: OVERALL, or in more than ``outliers`` strata (``scope="pop"``).

    ``dif`` is for loci only.  Each marker comes with its unit's number of strata beyond the thresholds.
    """
    unit = _unit(approach)
    keys = ["CHROM", "LOCUS"] if unit == "LOCUS" else ["MARKERS"]
    s = summary(g, approach).filter(F.col("STRATA") == OVERALL if scope == "overall" else F.col("STRATA") != OVERALL)
    over = (F.col("HET_MAX") > threshold) | (F.col("HET_DIF") > dif) if unit == "LOCUS" else F.col("HET_MEAN") > threshold
    bad = s.groupBy(*keys).agg(F.count_if(over).alias("OUTLIERS")).filter(F.col("OUTLIERS") > (0 if scope == "overall" else outliers))
    return g.select(*dict.fromkeys([*keys, "MARKERS"])).distinct().join(bad, keys).select("MARKERS", "OUTLIERS")


def individuals(g: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Samples whose mean observed heterozygosity is under ``low`` or over ``high``."""
    return stats.individual_stats(g).filter((F.col("HETEROZYGOSITY") < low) | (F.col("HETEROZYGOSITY") > high)).select("INDIVIDUALS")


def individual_summary(g: DataFrame) -> DataFrame:
    """Mean, median, deviation and range of samples' heterozygosity by stratum and OVERALL, rounded to 6."""
    s = stats.individual_stats(g).withColumn("STRATA", F.explode(F.array(F.col("STRATA"), F.lit(OVERALL))))
    r = lambda c, n: F.round(c, 6).alias(n)
    h = F.col("HETEROZYGOSITY")
    return s.groupBy("STRATA").agg(r(F.avg(h), "HET_MEAN"), r(F.percentile(h, F.lit(0.5)), "HET_MEDIAN"), r(F.stddev_samp(h), "HET_SD"), r(F.min(h), "HET_MIN"), r(F.max(h), "HET_MAX"))
