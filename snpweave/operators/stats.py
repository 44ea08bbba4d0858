"""Statistics of markers, samples and strata: one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, tile
def _counts() -> list[Column]:
    return [F.count_if(F.col("GT_BIN") == 0).alias("N0"), F.count_if(F.col("GT_BIN") == 1).alias("N1"), F.count_if(F.col("GT_BIN") == 2).alias("N2"), F.count(F.col("GT_BIN")).alias("N"), F.count(F.lit(1)).alias("TOTAL")]


def genotype_counts(g: DataFrame, *keys: str) -> DataFrame:
    """N0, N1, N2, N (genotyped), TOTAL (cells) by ``keys``; every frequency statistic follows from these sums."""
    return g.groupBy(*keys).agg(*_counts())


def het(g: DataFrame, key: str) -> DataFrame:
    """Heterozygotes over genotyped, by sample or marker; null where nothing is genotyped."""
    return genotype_counts(g, key).select(key, F.try_divide("N1", "N").alias("HET_OBS"))


def fis_columns() -> list[Column]:
    p = F.try_divide(2 * F.col("N0") + F.col("N1"), 2 * F.col("N"))
    exp = 2 * p * (1 - p) * F.col("N")
    return [exp.alias("HET_EXP"), (1 - F.try_divide(F.col("N1"), exp)).alias("FIS")]


def markers_fis(g: DataFrame) -> DataFrame:
    """REF, HET, ALT, N, expected heterozygotes 2p(1-p)N, and FIS = 1 - HET / HET_EXP."""
    return genotype_counts(g, "MARKERS").select("MARKERS", F.col("N0").alias("REF"), F.col("N1").alias("HET"), F.col("N2").alias("ALT"), "N", *fis_columns())


#: columns that a source may lack; statistics read them as missing
OPTIONAL = {"COL": "int", "READ_DEPTH": "long", "ALLELE_REF_DEPTH": "long", "ALLELE_ALT_DEPTH": "long"}


def with_optional(g: DataFrame) -> DataFrame:
    return g.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in g.columns})


_DEPTHS = {"COVERAGE_TOTAL": "READ_DEPTH", "REF_DEPTH_TOTAL": "ALLELE_REF_DEPTH", "ALT_DEPTH_TOTAL": "ALLELE_ALT_DEPTH"}


def marker_stats(g: DataFrame) -> DataFrame:
    """All marker statistics in one pass over the genotypes, plus the SNP number of the marker's locus."""
    depth = [F.sum(c).alias(n) for n, c in _DEPTHS.items()]
    return marker_columns(with_optional(g).groupBy("MARKERS", "CHROM", "LOCUS", "POS", "COL").agg(*_counts(), *depth, F.avg("READ_DEPTH").alias("COVERAGE_MEAN")))


def marker_sums(g: DataFrame) -> DataFrame:
    """What every filter of markers asks, by marker, from one pass: counts, depths, the smallest number genotyped in a stratum.

    A marker's row does not depend on other markers, so it holds as long as no sample goes.
    """
    own = [F.lit(None).cast("string").alias(c) if c not in g.columns else F.col(c) for c in ("CHROM", "LOCUS", "POS")]
    more = [F.first(c).alias(c) for c in ("REF", "ALT", "FILTER", "REP_AVG") if c in g.columns]
    c = with_optional(g).groupBy("MARKERS", *own, "COL", "STRATA").agg(*_counts(), *[F.sum(x).alias(n) for n, x in _DEPTHS.items()], F.count("READ_DEPTH").alias("COVERED"), *more)
    total = [F.sum(x).alias(x) for x in ("N0", "N1", "N2", "N", "TOTAL", *_DEPTHS, "COVERED")]
    m = c.groupBy("MARKERS", "CHROM", "LOCUS", "POS", "COL").agg(*total, F.min("N").alias("LEAST"), *[F.first(x).alias(x) for x in ("REF", "ALT", "FILTER", "REP_AVG") if x in g.columns])
    return m.withColumn("COVERAGE_MEAN", F.try_divide("COVERAGE_TOTAL", "COVERED"))


def marker_columns(m: DataFrame) -> DataFrame:
    """Statistics from the sums of markers."""
    ref, alt = 2 * F.col("N0") + F.col("N1"), 2 * F.col("N2") + F.col("N1")
    top, total = F.greatest(ref, alt), 2 * F.col("N")
    return m.select(
        "MARKERS", "CHROM", "LOCUS", "POS", "COL", F.count(F.lit(1)).over(Window.partitionBy("CHROM", "LOCUS")).alias("SNP_PER_LOCUS"),
        ((F.col("TOTAL") - F.col("N")) / F.col("TOTAL")).alias("MISSING_PROP"), F.try_divide("N1", "N").alias("HET_OBS"), fis_columns()[1], ((ref > 0).cast("int") + (alt > 0).cast("int")).alias("N_ALLELES"),
        top.alias("REF_COUNT"), (total - top).alias("MAC_GLOBAL"), F.try_divide(total - top, total).alias("MAF_GLOBAL"), (alt > ref).alias("ALT_CHECK"),
        "COVERAGE_TOTAL", "COVERAGE_MEAN", "REF_DEPTH_TOTAL", "ALT_DEPTH_TOTAL",
    )


def individual_stats(g: DataFrame) -> DataFrame:
    """MISSING_PROP, HETEROZYGOSITY (0 where nothing is genotyped) and coverage of each sample."""
    g = with_optional(g)
    depth = [F.sum("READ_DEPTH").alias("COVERAGE_TOTAL"), F.avg("READ_DEPTH").alias("COVERAGE_MEAN"), *five("READ_DEPTH", "COVERAGE_")]
    s = g.groupBy("INDIVIDUALS", "STRATA").agg(*_counts(), *depth)
    return s.select("INDIVIDUALS", "STRATA", ((F.col("TOTAL") - F.col("N")) / F.col("TOTAL")).alias("MISSING_PROP"), F.coalesce(F.try_divide("N1", "N"), F.lit(0.0)).alias("HETEROZYGOSITY"),
                    "COVERAGE_TOTAL", "COVERAGE_MEAN", "COVERAGE_MEDIAN", "COVERAGE_IQR")


def five(value: str, prefix: str = "") -> list[Column]:
    """Median and inter-quartile range (exact, linear interpolation)."""
    q = lambda x: F.percentile(value, F.lit(x))
    return [q(0.5).alias(f"{prefix}MEDIAN"), (q(0.75) - q(0.25)).alias(f"{prefix}IQR")]


def tibble_stats(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Five numbers, mean, IQR and outlier bounds (quartile -/+ 1.5 IQR, not beyond the extremes), rounded to 6."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = df.groupBy(*by).agg(F.min(value).alias("lo"), q.alias("q"), F.avg(value).alias("MEAN"), F.max(value).alias("hi"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    r = lambda c, n: F.round(c.cast("double"), 6).alias(n)
    return a.select(*by, F.lit(group).alias("GROUP"), r(F.col("lo"), "MIN"), r(q1, "Q25"), r(F.col("MEAN"), "MEAN"), r(q2, "MEDIAN"), r(q3, "Q75"), r(F.col("hi"), "MAX"), r(q3 - q1, "IQR"),
                    r(F.greatest(q1 - 1.5 * (q3 - q1), F.col("lo").cast("double")), "OUTLIERS_LOW"), r(F.least(q3 + 1.5 * (q3 - q1), F.col("hi").cast("double")), "OUTLIERS_HIGH"))


def coverage(g: DataFrame, key: str) -> DataFrame:
    """Sum, mean, median and IQR of total, reference and alternate depth by ``key``, rounded half to even."""
    out = []
    for c, p in (("READ_DEPTH", "COVERAGE"), ("ALLELE_REF_DEPTH", "REF_DEPTH"), ("ALLELE_ALT_DEPTH", "ALT_DEPTH")):
        whole = lambda x, n: F.rint(x).cast("long").alias(n)
        q = lambda x, c=c: F.percentile(c, F.lit(x))
        out += [F.sum(c).alias(f"{p}_TOTAL"), whole(F.avg(c), f"{p}_MEAN"), whole(q(0.5), f"{p}_MEDIAN"), whole(q(0.75) - q(0.25), f"{p}_IQR")]
    return g.groupBy(key).agg(*out)


def missing_per_pop(g: DataFrame) -> DataFrame:
    """Per stratum and threshold 0.1 .. 1: markers with at most that share missing, and the others."""
    m = genotype_counts(g, "STRATA", "MARKERS").select("STRATA", ((F.col("TOTAL") - F.col("N")) / F.col("TOTAL")).alias("x"))
    return at_thresholds(m, "x", [i / 10 for i in range(1, 11)], "STRATA")


def at_thresholds(df: DataFrame, value: str, grid: list[float], *by: str, passes=lambda v, t: v <= t) -> DataFrame:
    """WHITELISTED and BLACKLISTED rows at each threshold: one aggregate, no join with the grid."""
    ok = [F.count_if(passes(F.col(value), F.lit(t))).alias(f"w{i}") for i, t in enumerate(grid)]
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *ok)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("THRESHOLD"), F.col(f"w{i}").alias("WHITELISTED_MARKERS"), (F.col("n") - F.col(f"w{i}")).alias("BLACKLISTED_MARKERS")) for i, t in enumerate(grid)]))
    return a.select(*by, rows.alias("r")).select(*by, "r.*")


def total_reads(g: DataFrame) -> DataFrame:
    """Five numbers of the samples' total depth, by stratum and overall."""
    t = g.groupBy("INDIVIDUALS", "STRATA").agg(F.sum("READ_DEPTH").alias("v"))
    return tibble_stats(t, "v", "total reads", "STRATA").unionByName(tibble_stats(t.withColumn("STRATA", F.lit("OVERALL")), "v", "total reads", "STRATA"))


def markers_genotyped(g: DataFrame) -> DataFrame:
    """Markers whose missing percent is at most 0, 10, .. 100: overall, by stratum, and the strata's mean."""
    grid = [float(x) for x in range(0, 101, 10)]
    pct = (100 * (F.col("TOTAL") - F.col("N")) / F.col("TOTAL")).alias("x")
    pop = at_thresholds(genotype_counts(g, "STRATA", "MARKERS").select("STRATA", pct), "x", grid, "STRATA")
    all_ = at_thresholds(genotype_counts(g, "MARKERS").select(F.lit("OVERALL").alias("STRATA"), pct), "x", grid, "STRATA")
    mean = pop.groupBy("THRESHOLD").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("WHITELISTED_MARKERS", "BLACKLISTED_MARKERS")]).withColumn("STRATA", F.lit("MEAN"))
    d = lambda x: x.select("STRATA", "THRESHOLD", F.col("WHITELISTED_MARKERS").cast("double"), F.col("BLACKLISTED_MARKERS").cast("double"))
    return d(pop).unionByName(d(all_)).unionByName(d(mean))


def summarise_genotypes(g: DataFrame) -> DataFrame:
    """Counts, frequencies and z-scores of observed against expected genotypes, by marker x stratum and overall."""
    c = genotype_counts(g, "MARKERS", "STRATA")
    every = c.groupBy("MARKERS").agg(*[F.sum(x).alias(x) for x in ("N0", "N1", "N2", "N", "TOTAL")]).withColumn("STRATA", F.lit("OVERALL"))
    c = c.unionByName(every.select(c.columns))
    n = F.col("N")
    p = F.try_divide(2 * F.col("N0") + F.col("N1"), 2 * n)
    q = 1 - p
    exp = {"HOM_REF": p * p, "HET": 2 * p * q, "HOM_ALT": q * q}
    obs = {"HOM_REF": "N0", "HET": "N1", "HOM_ALT": "N2"}
    z = [F.round(F.try_divide(F.col(obs[k]) - n * e, F.sqrt(n * e * (1 - e))), 6).alias(f"Z_{k}") for k, e in exp.items()]
    return c.select("MARKERS", "STRATA", F.col("N0").alias("HOM_REF"), F.col("N1").alias("HET"), F.col("N2").alias("HOM_ALT"), (F.col("TOTAL") - n).alias("MISSING"), "N",
                    p.alias("FREQ_REF"), q.alias("FREQ_ALT"), F.try_divide(F.col("N1"), 2 * n).alias("FREQ_HET"), *z)


def allele_summary(g: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """FREQ_REF, MAF, HET_O, HET_E and FIS (1 where HET_O is 0) by ``keys``."""
    c = genotype_counts(g, *keys).filter("N > 0")
    p = (2 * F.col("N0") + F.col("N1")) / (2 * F.col("N"))
    o, e = F.col("N1") / F.col("N"), 2 * p * (1 - p)
    return c.select(*keys, "N", p.alias("FREQ_REF"), (1 - p).alias("MAF"), o.alias("HET_O"), e.alias("HET_E"), F.when(o == 0, 1.0).otherwise(F.round(F.try_divide(e - o, e), digits)).alias("FIS"))


def summary_by_pop(g: DataFrame) -> DataFrame:
    """Means over markers of the marker x stratum summary, rounded to 9."""
    return allele_summary(g, "MARKERS", "STRATA").groupBy("STRATA").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("FREQ_REF", "MAF", "HET_O", "HET_E", "FIS")])


def maf(g: DataFrame) -> DataFrame:
    """MAF_LOCAL and MAF_GLOBAL: the minor allele is the globally rarer one (the reference if rarer, else the alternate)."""
    c = genotype_counts(g, "MARKERS", "STRATA").filter("N > 0")
    w = Window.partitionBy("MARKERS")
    pp, qq, n = 2 * F.col("N0") + F.col("N1"), 2 * F.col("N2") + F.col("N1"), F.col("N")
    gp, gq = F.sum(pp).over(w), F.sum(qq).over(w)
    return c.select("MARKERS", "STRATA", "N", (F.when(gp < gq, pp).otherwise(qq) / (2 * n)).alias("MAF_LOCAL"), (F.least(gp, gq) / (gp + gq)).alias("MAF_GLOBAL"))


def minor_alleles(g: DataFrame) -> DataFrame:
    """MAC, MAF by count, MAD and MAF by depth, of each marker; multi-pass calibration is not needed for biallelic data."""
    return minor_columns(with_optional(g).groupBy("MARKERS").agg(*_counts(), F.sum("ALLELE_REF_DEPTH").alias("REF_DEPTH_TOTAL"), F.sum("ALLELE_ALT_DEPTH").alias("ALT_DEPTH_TOTAL")))


def minor_columns(m: DataFrame) -> DataFrame:
    """Minor allele statistics from the sums of markers."""
    ref, alt = 2 * F.col("N0") + F.col("N1"), 2 * F.col("N2") + F.col("N1")
    rd, ad = (F.coalesce(F.col(c), F.lit(0)) for c in ("REF_DEPTH_TOTAL", "ALT_DEPTH_TOTAL"))
    low = F.least(rd, ad)
    return m.select("MARKERS", ref.alias("REF_COUNT"), alt.alias("ALT_COUNT"), F.least(ref, alt).alias("MAC_GLOBAL_CORR"), F.try_divide(F.least(ref, alt), ref + alt).alias("MAF_GLOBAL_COUNT_CORR"),
                    low.alias("MAD_GLOBAL_CORR"), F.try_divide(low, rd + ad).alias("MAF_GLOBAL_DEPTH_CORR"), (ref == 0).alias("REF_ABSENT"))


def maf_by_rank(g: DataFrame, ranks: int) -> DataFrame:
    """Mean local and global MAF of ``ranks`` groups of marker x stratum rows ordered by global MAF."""
    m = numbered(maf(g), "__i", "MAF_GLOBAL", "MARKERS", "STRATA")
    m = m.withColumn("RANK", tile(F.col("__i"), m.count(), ranks))
    return m.groupBy("RANK").agg(F.round(F.avg("MAF_LOCAL"), 6).alias("MAF_LOCAL"), F.round(F.avg("MAF_GLOBAL"), 6).alias("MAF_GLOBAL"), F.count(F.lit(1)).alias("N"))


def betas(g: DataFrame) -> DataFrame:
    """Population-specific beta = 1 - sum HW / sum HB over markers genotyped in at least two strata, rounded to 6.

    HW = 2N/(2N-1) (1 - sum p^2); HB = 1 - mean over pairs of strata of sum over alleles p_i p_j.  Pair sums come
    from ((sum p)^2 - sum p^2) / 2, so strata are never joined with strata.
    """
    c = genotype_counts(g, "MARKERS", "STRATA").filter("N > 0")
    p = (2 * F.col("N0") + F.col("N1")) / (2 * F.col("N"))
    c = c.select("MARKERS", "STRATA", "N", p.alias("p"), (1 - p).alias("q"))
    hw = 2 * F.col("N") / (2 * F.col("N") - 1) * (1 - F.col("p") * F.col("p") - F.col("q") * F.col("q"))
    k = F.count(F.lit(1))
    both = lambda x: (F.sum(x) * F.sum(x) - F.sum(F.col(x) * F.col(x)))
    hb = c.groupBy("MARKERS").agg(k.alias("k"), F.when(k > 1, 1 - (both("p") + both("q")) / (k * (k - 1))).alias("HB")).filter("k > 1")
    j = c.withColumn("HW", hw).join(hb, "MARKERS")
    return j.groupBy("STRATA").agg(F.round(1 - F.sum("HW") / F.sum("HB"), 6).alias("BETAI"), F.count(F.lit(1)).alias("N_MARKERS"))


def fh(g: DataFrame) -> DataFrame:
    """HOM_O (share of homozygotes), HOM_E (mean expected homozygosity of the stratum's markers), and FH = (HOM_O - HOM_E) / (N - HOM_E), rounded to 6."""
    c = allele_summary(g, "MARKERS", "STRATA").select("MARKERS", "STRATA", (1 - F.col("HET_E")).alias("e"))
    j = g.filter(F.col("GT_BIN").isNotNull()).join(c, ["MARKERS", "STRATA"])
    s = j.groupBy("INDIVIDUALS", "STRATA").agg(F.count(F.lit(1)).alias("N"), (F.count_if(F.col("GT_BIN") != 1) / F.count(F.lit(1))).alias("HOM_O"), F.avg("e").alias("HOM_E"))
    return s.select("INDIVIDUALS", "STRATA", "N", F.round("HOM_O", 6).alias("HOM_O"), F.round("HOM_E", 6).alias("HOM_E"), F.round((F.col("HOM_O") - F.col("HOM_E")) / (F.col("N") - F.col("HOM_E")), 6).alias("FH"))


def fh_by_pop(g: DataFrame) -> DataFrame:
    """Mean FH by stratum; OVERALL is the mean of the strata's means."""
    s = fh(g).groupBy("STRATA").agg(F.avg("FH").alias("x"))
    return s.select("STRATA", F.round("x", 6).alias("FH")).unionByName(s.agg(F.round(F.avg("x"), 6).alias("FH")).select(F.lit("OVERALL").alias("STRATA"), "FH"))


def pi_individuals(g: DataFrame, read_length: int) -> DataFrame:
    """Mean over markers of heterozygosity per site of a read."""
    return g.groupBy("INDIVIDUALS", "STRATA").agg((F.count_if(F.col("GT_BIN") == 1) / F.count(F.col("GT_BIN")) / read_length).alias("PI"))


def pi_markers(g: DataFrame, read_length: int, *keys: str) -> DataFrame:
    """Sum over allele pairs of f_i f_j differences / length: f_ref f_alt / length for one SNP."""
    c = genotype_counts(g, "MARKERS", *keys).filter("N > 0")
    p = (2 * F.col("N0") + F.col("N1")) / (2 * F.col("N"))
    return c.select("MARKERS", *keys, (p * (1 - p) / read_length).alias("PI"))


def pi_pop(g: DataFrame, read_length: int) -> DataFrame:
    """Mean of markers' pi by stratum and overall, rounded to 9."""
    a = pi_markers(g, read_length, "STRATA").groupBy("STRATA").agg(F.round(F.avg("PI"), 9).alias("PI"))
    return a.unionByName(pi_markers(g, read_length).agg(F.round(F.avg("PI"), 9).alias("PI")).select(F.lit("OVERALL").alias("STRATA"), "PI"))


def alleles(g: DataFrame) -> DataFrame:
    """(MARKERS, STRATA, ALLELES) of every allele copy class that occurs."""
    both = F.array(F.when(F.col("GT_BIN") < 2, F.col("REF")), F.when(F.col("GT_BIN") > 0, F.col("ALT")))
    return g.filter(F.col("GT_BIN").isNotNull()).select("MARKERS", "STRATA", F.explode(F.array_compact(both)).alias("ALLELES")).distinct()


def private_alleles(a: DataFrame) -> DataFrame:
    """Alleles (of ``alleles`` or haplotypes) that occur in exactly one stratum."""
    return a.select("MARKERS", "STRATA", "ALLELES").distinct().groupBy("MARKERS", "ALLELES").agg(F.count(F.lit(1)).alias("n"), F.min("STRATA").alias("STRATA")).filter("n = 1").select("STRATA", "MARKERS", "ALLELES")


def private_summary(a: DataFrame) -> DataFrame:
    """Private alleles by stratum, and OVERALL their sum."""
    p = private_alleles(a).groupBy("STRATA").agg(F.count(F.lit(1)).alias("PRIVATE_ALLELES"))
    return p.unionByName(p.agg(F.coalesce(F.sum("PRIVATE_ALLELES"), F.lit(0)).alias("PRIVATE_ALLELES")).select(F.lit("OVERALL").alias("STRATA"), "PRIVATE_ALLELES"))


def not_common_markers(g: DataFrame) -> DataFrame:
    """Markers without any genotype in some stratum."""
    return genotype_counts(g, "MARKERS", "STRATA").filter("N = 0").select("MARKERS").distinct()


def monomorphic(g: DataFrame) -> DataFrame:
    """Markers with one distinct dosage; all heterozygotes count as one."""
    return g.groupBy("MARKERS").agg(F.count_distinct("GT_BIN").alias("n")).filter("n = 1").select("MARKERS")


def monomorphic_alleles(g: DataFrame) -> DataFrame:
    """Markers with one distinct allele."""
    c = genotype_counts(g, "MARKERS")
    return c.filter("N > 0 and N1 = 0 and (N0 = 0 or N2 = 0)").select("MARKERS")


def data_info(g: DataFrame) -> DataFrame:
    """Distinct strata, samples, SNPs, loci and chromosomes; null where the column is absent."""
    have = set(g.columns)
    pick = {"N_POP": "STRATA", "N_IND": "INDIVIDUALS", "N_SNP": "MARKERS", "N_LOCUS": "LOCUS", "N_CHROM": "CHROM"}
    return g.agg(*[(F.count_distinct(c) if c in have else F.lit(None).cast("long")).alias(n) for n, c in pick.items()])


def id_qc(g: DataFrame) -> DataFrame:
    """Traffic lights of each sample for coverage, missingness and heterozygosity, and strata that are mostly bad.

    BAD: coverage under its lower outlier bound or missing over its upper one; MIX_RISK: heterozygosity over its
    upper bound; a stratum with more than half bad samples is a BAD_BATCH.
    """
    s = individual_stats(g)
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    cut = s.agg(*[q(c).alias(f"q_{c}") for c in ("COVERAGE_TOTAL", "MISSING_PROP", "HETEROZYGOSITY")])
    j = s.crossJoin(F.broadcast(cut))  # one row
    lo = lambda c: F.col(f"q_{c}")[0] - 1.5 * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0])
    hi = lambda c: F.col(f"q_{c}")[1] + 1.5 * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0])
    light = lambda c, bad, warn: F.when(bad, "red").when(warn, "orange").otherwise("green")
    cov, mis, het_ = F.col("COVERAGE_TOTAL"), F.col("MISSING_PROP"), F.col("HETEROZYGOSITY")
    j = j.select("INDIVIDUALS", "STRATA", light("c", cov < lo("COVERAGE_TOTAL"), cov < F.col("q_COVERAGE_TOTAL")[0]).alias("QC_COVERAGE"), light("m", mis > hi("MISSING_PROP"), mis > F.col("q_MISSING_PROP")[1]).alias("QC_MISSING"),
                 light("h", het_ > hi("HETEROZYGOSITY"), het_ > F.col("q_HETEROZYGOSITY")[1]).alias("QC_HET"))
    bad = (F.col("QC_COVERAGE") == "red") | (F.col("QC_MISSING") == "red")
    j = j.withColumn("BAD", bad).withColumn("MIX_RISK", F.col("QC_HET") == "red")
    share = F.avg(F.col("BAD").cast("int")).over(Window.partitionBy("STRATA"))
    return j.withColumn("BAD_BATCH", share > 0.5)
