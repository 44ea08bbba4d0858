"""Filters as predicates: each returns the rows to blacklist, so a dataset can tag them and stay lazy.

A threshold is a number, or ``"outliers"`` for the bounds of the five-number summary.  An outlier bound that equals
the extreme is compared strictly, others inclusively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def bounds(df: DataFrame, value: str) -> DataFrame:
    """One row: lo, hi (extremes), q1, q3, low and high (outlier bounds, not beyond the extremes)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    a = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), q.alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return a.select("lo", "hi", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), F.greatest(F.col("q")[0] - 1.5 * iqr, "lo").alias("low"), F.least(F.col("q")[1] + 1.5 * iqr, "hi").alias("high"))


def beyond(df: DataFrame, value: str, low=None, high=None) -> DataFrame:
    """Rows of ``df`` outside the bounds; ``"outliers"`` takes them from the data (one broadcast row)."""
    v = F.col(value)
    if "outliers" in (low, high):
        j = df.crossJoin(F.broadcast(bounds(df, value)))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.when(F.col("low") == F.col("lo"), v < F.col("low")).otherwise(v <= F.col("low")) if low == "outliers" else v < low)
        if high is not None:
            bad = bad | (F.when(F.col("high") == F.col("hi"), v > F.col("high")).otherwise(v >= F.col("high")) if high == "outliers" else v > high)
        return j.filter(bad).select(df.columns)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    return df.filter(bad)


def genotyping(m: DataFrame, threshold=0.2) -> DataFrame:
    """Markers with more missing than ``threshold``."""
    return beyond(m, "MISSING_PROP", high=threshold).select("MARKERS")


def minor_allele(m: DataFrame, stat: str = "mac", threshold: float = 4) -> DataFrame:
    """Markers whose minor allele count, frequency or depth is below the threshold."""
    c = {"mac": "MAC_GLOBAL_CORR", "maf": "MAF_GLOBAL_COUNT_CORR", "mad": "MAD_GLOBAL_CORR"}[stat]
    return m.filter(F.col(c) < threshold).select("MARKERS")


def coverage(m: DataFrame, low=None, high=None) -> DataFrame:
    """Markers whose mean coverage lies outside; outlier bounds are floored to 3 decimals and compared strictly."""
    v = F.col("COVERAGE_MEAN")
    if "outliers" in (low, high):
        b = bounds(m, "COVERAGE_MEAN").select((F.floor(F.col("low") * 1000) / 1000).alias("low"), (F.floor(F.col("high") * 1000) / 1000).alias("high"))
        j = m.crossJoin(F.broadcast(b))
        return j.filter((v < (F.col("low") if low == "outliers" else F.lit(low))) | (v > (F.col("high") if high == "outliers" else F.lit(high)))).select("MARKERS")
    return beyond(m, "COVERAGE_MEAN", low, high).select("MARKERS")


def snp_position(m: DataFrame, rule) -> DataFrame:
    """Markers whose place on the read is outside: ``outliers`` (over the high bound), ``q75``, ``iqr``, or (min, max)."""
    if not isinstance(rule, str):
        return m.filter((F.col("COL") < rule[0]) | (F.col("COL") > rule[1])).select("MARKERS")
    j = m.crossJoin(F.broadcast(bounds(m, "COL")))
    c = F.col("COL")
    keep = {"outliers": c <= F.col("high"), "q75": c <= F.col("q3"), "iqr": (c >= F.col("q1")) & (c <= F.col("q3"))}[rule]
    return j.filter(~keep).select("MARKERS")


def snp_number(m: DataFrame, threshold) -> DataFrame:
    """Markers of loci with more SNPs than the threshold."""
    per = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("CHROM", "LOCUS")))
    if threshold == "outliers":
        loci = m.groupBy("CHROM", "LOCUS").agg(F.count(F.lit(1)).alias("n"))
        return per.crossJoin(F.broadcast(bounds(loci, "n"))).filter("n > high").select("MARKERS")
    return per.filter(F.col("n") > threshold).select("MARKERS")


def short_ld(m: DataFrame, rule: str = "mac") -> DataFrame:
    """All but one SNP of each locus: by ``mac`` (largest, ties by position), ``first``, ``middle``, ``last``, or ``random`` (a hash)."""
    pos = F.col("POS").cast("long")
    w = Window.partitionBy("CHROM", "LOCUS")
    if rule == "middle":
        n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(pos, "MARKERS"))
        return m.withColumn("bad", i != F.floor((n + 1) / 2)).filter("bad").select("MARKERS")
    order = {"mac": [F.desc("MAC_GLOBAL"), pos], "first": [pos], "last": [pos.desc()], "random": [F.xxhash64("MARKERS")]}[rule]
    return m.withColumn("i", F.row_number().over(w.orderBy(*order, "MARKERS"))).filter("i > 1").select("MARKERS")


def individuals(s: DataFrame, missing=None, heterozygosity=None, total=None, median=None, iqr=None) -> DataFrame:
    """Samples outside the bounds, with the first filter that takes them; bounds are (low, high) or ``"outliers"``."""
    out = None
    for name, value, rule in (("missing", "MISSING_PROP", missing), ("heterozygosity", "HETEROZYGOSITY", heterozygosity), ("coverage total", "COVERAGE_TOTAL", total), ("coverage median", "COVERAGE_MEDIAN", median), ("coverage iqr", "COVERAGE_IQR", iqr)):
        if rule is None:
            continue
        low, high = ((None, "outliers") if name == "missing" else ("outliers", "outliers")) if rule == "outliers" else rule if isinstance(rule, tuple) else (None, rule)
        bad = beyond(s, value, low, high).select("INDIVIDUALS", F.lit(name).alias("FILTER"))
        out = bad if out is None else out.unionByName(bad.join(out.select("INDIVIDUALS"), "INDIVIDUALS", "left_anti"))
    return out


def fis(table: DataFrame, lowest: float, highest: float, diff: float, pops: float, percent: bool = False, keys=("LOCUS",)) -> DataFrame:
    """Loci that pass in enough strata: FIS between the bounds, and max - min at most ``diff``; ``pops`` counts or is a share."""
    s = table.groupBy(*keys, "POP_ID").agg(F.min("FIS").alias("lo"), F.max("FIS").alias("hi"))
    n = table.select("POP_ID").distinct()
    ok = s.filter((F.col("lo") >= lowest) & (F.col("hi") <= highest) & (F.col("hi") - F.col("lo") <= diff)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if percent or pops < 1:
        share = pops / 100 if percent else pops
        total = n.agg(F.count(F.lit(1)).alias("k"))
        return ok.crossJoin(F.broadcast(total)).filter(F.col("n") / F.col("k") >= share).select(*keys)
    return ok.filter(F.col("n") >= pops).select(*keys)


def het_markers(g: DataFrame, threshold: float, dif: float, outlier_pops: int) -> DataFrame:
    """Markers over the heterozygosity threshold, or whose locus spreads more than ``dif``, in more than ``outlier_pops`` strata."""
    h = stats.genotype_counts(g, "CHROM", "LOCUS", "MARKERS", "STRATA").filter("N > 0").withColumn("h", F.col("N1") / F.col("N"))
    w = Window.partitionBy("CHROM", "LOCUS", "STRATA")
    out = (F.max("h").over(w) > threshold) | (F.max("h").over(w) - F.min("h").over(w) > dif)
    return h.withColumn("out", out).groupBy("MARKERS").agg(F.count_if("out").alias("OUTLIERS")).filter(F.col("OUTLIERS") > outlier_pops)


def erase_genotypes(t: DataFrame, read_depth: int, allele_depth: int, imbalance: float) -> DataFrame:
    """Heterozygotes of exactly ``read_depth`` reads with an allele under ``allele_depth`` and |ratio| over ``imbalance``: (MARKERS, INDIVIDUALS)."""
    r, a = F.coalesce("ALLELE_REF_DEPTH", F.lit(0)), F.coalesce("ALLELE_ALT_DEPTH", F.lit(0))
    ratio = F.abs((a - r) / (a + r))
    return t.filter((F.col("GT_BIN") == 1) & (F.col("READ_DEPTH") == read_depth) & ((r < allele_depth) | (a < allele_depth))).filter(ratio > imbalance).select("MARKERS", "INDIVIDUALS")


def blank(g: DataFrame, bad: DataFrame, columns=("GT_BIN",)) -> DataFrame:
    """``g`` with the genotypes of ``bad`` (MARKERS, INDIVIDUALS) missing."""
    hit = bad.select("MARKERS", "INDIVIDUALS").distinct().withColumn("__bad", F.lit(True))
    j = g.join(hit, ["MARKERS", "INDIVIDUALS"], "left")
    return j.select(*[F.when(F.col("__bad"), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in g.columns])


def whitelist(g: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``g`` whose shared columns stand in ``keep``."""
    return g.join(keep.distinct(), [c for c in keep.columns if c in g.columns], "left_semi")


def common_markers(g: DataFrame) -> DataFrame:
    """Genotypes of markers that every stratum has."""
    return g.join(stats.not_common_markers(g), "MARKERS", "left_anti")


def vcf_filter_column(markers: DataFrame) -> DataFrame:
    """Markers that do not pass, if FILTER has several values."""
    n = markers.agg(F.count_distinct("FILTER").alias("k"))
    return markers.crossJoin(F.broadcast(n)).filter("k > 1 and FILTER <> 'PASS'").select("MARKERS")


def duplicated_strands(markers: DataFrame, rule: str = "best.stats") -> DataFrame:
    """Markers at one CHROM and POS: ``keep.both`` none, ``blacklist`` all, ``best.stats`` all but the best genotyped."""
    w = Window.partitionBy("CHROM", "POS")
    if rule == "keep.both":
        return markers.limit(0).select("MARKERS")
    m = markers.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("MISSING_PROP", "MARKERS"))).filter("n > 1")
    return (m if rule == "blacklist" else m.filter("i > 1")).select("MARKERS")


def haplotype_format(markers: DataFrame) -> DataFrame:
    """Markers that are no SNPs."""
    return markers.filter((F.length("REF") != 1) | (F.length("ALT") != 1) | F.contains("ALT", F.lit(","))).select("MARKERS")


def site_filter(m: DataFrame, mac: int | None = None, monomorphic: bool = False, missing: float | None = None) -> DataFrame:
    """Markers that a VCF site filter keeps: AC >= mac, 0 < AC < AN, F_MISSING <= missing; ``m`` has (AC, AN, F_MISSING)."""
    keep: Column = F.lit(True)
    if mac is not None:
        keep = keep & (F.col("AC") >= mac)
    if monomorphic:
        keep = keep & (F.col("AC") > 0) & (F.col("AC") < F.col("AN"))
    if missing is not None:
        keep = keep & (F.col("F_MISSING") <= missing)
    return m.filter(keep)


def site_info(g: DataFrame) -> DataFrame:
    """AC, AN, NS and F_MISSING of each marker."""
    c = stats.genotype_counts(g, "MARKERS")
    return c.select("MARKERS", (2 * F.col("N2") + F.col("N1")).alias("AC"), (2 * F.col("N")).alias("AN"), F.col("N").alias("NS"), ((F.col("TOTAL") - F.col("N")) / F.col("TOTAL")).alias("F_MISSING"))
