"""Detectors: problems, mixtures, paralogs, sex-linked markers, repeats."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .filters import beyond


def all_missing(g: DataFrame) -> DataFrame:
    return stats.genotype_counts(g, "MARKERS").filter("N = 0").select("MARKERS")


def biallelic(g: DataFrame) -> DataFrame:
    """Whether no marker has more than two alleles (all markers are looked at)."""
    return allele_numbers(g).agg(F.coalesce(F.max("N_ALLELES"), F.lit(0)).alias("m")).select((F.col("m") <= 2).alias("BIALLELIC"))


def allele_numbers(g: DataFrame) -> DataFrame:
    """Distinct alleles of each marker; a column GT_VCF_NUC takes precedence over the dosage."""
    if "GT_VCF_NUC" in g.columns:
        a = g.filter("GT_VCF_NUC <> './.'").select("MARKERS", F.explode(F.split("GT_VCF_NUC", "/")).alias("ALLELES"))
    else:
        a = stats.alleles(g)
    return a.groupBy("MARKERS").agg(F.count_distinct("ALLELES").alias("N_ALLELES"))


def biallelic_problems(g: DataFrame) -> DataFrame:
    return allele_numbers(g).filter("N_ALLELES > 2")


def allele_problems(g: DataFrame, threshold: int = 3) -> DataFrame:
    """Markers with at most ``threshold`` copies of the alternate allele, and their alternate depth."""
    m = stats.minor_alleles(g).select("MARKERS", "ALT_COUNT")
    d = g.groupBy("MARKERS").agg(F.coalesce(F.sum("ALLELE_ALT_DEPTH"), F.lit(0)).alias("ALT_DEPTH"))
    return m.filter(F.col("ALT_COUNT") <= threshold).join(d, "MARKERS")


def allele_problem_table(g: DataFrame, threshold: int = 3) -> DataFrame:
    """Of the problem genotypes with the alternate allele, how many have an alternate depth of at most 1 .. 10."""
    bad = allele_problems(g, threshold).select("MARKERS")
    x = g.filter("ALLELE_ALT_DEPTH is not null").join(bad, "MARKERS", "left_semi")
    return stats.at_thresholds(x, "ALLELE_ALT_DEPTH", [float(i) for i in range(1, 11)]).select(F.col("THRESHOLD").cast("int").alias("ALT_DEPTH"), F.col("WHITELISTED_MARKERS").alias("N"))


def mixed_genomes(g: DataFrame, low="outliers", high="outliers", by_strata: bool = False) -> DataFrame:
    """Samples whose heterozygosity is outside the bounds, globally or within their stratum."""
    s = stats.individual_stats(g).select("INDIVIDUALS", "STRATA", F.col("HETEROZYGOSITY").alias("HET_PROP"))
    if not by_strata:
        return beyond(s, "HET_PROP", low, high)
    q = s.groupBy("STRATA").agg(F.min("HET_PROP").alias("lo"), F.max("HET_PROP").alias("hi"), F.percentile("HET_PROP", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    q = q.select("STRATA", F.greatest(F.col("q")[0] - 1.5 * iqr, "lo").alias("low"), F.least(F.col("q")[1] + 1.5 * iqr, "hi").alias("high"))
    return s.join(q, "STRATA").filter("HET_PROP < low or HET_PROP > high").select("INDIVIDUALS", "STRATA", "HET_PROP")


def het_long(g: DataFrame) -> DataFrame:
    """Observed and expected genotype frequencies of each marker, long; the table behind the outlier plot."""
    s = stats.summarise_genotypes(g).filter("STRATA <> 'OVERALL' and N > 0")
    p, n = F.col("FREQ_REF"), F.col("N")
    s = s.select("MARKERS", "STRATA", F.array(
        F.struct(F.lit("HOM_REF").alias("GENOTYPES"), (F.col("HOM_REF") / n).alias("OBSERVED"), (p * p).alias("EXPECTED")),
        F.struct(F.lit("HET").alias("GENOTYPES"), (F.col("HET") / n).alias("OBSERVED"), (2 * p * (1 - p)).alias("EXPECTED")),
        F.struct(F.lit("HOM_ALT").alias("GENOTYPES"), (F.col("HOM_ALT") / n).alias("OBSERVED"), ((1 - p) * (1 - p)).alias("EXPECTED"))).alias("x"))
    return s.select("MARKERS", "STRATA", F.explode("x").alias("x")).select("MARKERS", "STRATA", "x.*")


def boundaries() -> list[tuple[float, float, float]]:
    """(allele frequency, least and largest heterozygote frequency) on a grid of 0.005."""
    return [(i / 200, 0.0, 2 * min(i / 200, 1 - i / 200)) for i in range(201)]


def genotype_boundaries(spark) -> DataFrame:
    p = F.col("id") / 200
    return spark.range(201).select(p.alias("P"), F.greatest(F.lit(0.0), 2 * p - 1).alias("HOM_REF_MIN"), p.alias("HOM_REF_MAX"), F.lit(0.0).alias("HET_MIN"), (2 * F.least(p, 1 - p)).alias("HET_MAX"))


def paralogs(g: DataFrame) -> DataFrame:
    """HET_PROP (missing cells count), allele ratio and z of reference against alternate reads in heterozygotes, rounded to 6."""
    h = g.groupBy("MARKERS").agg((F.count_if(F.col("GT_BIN") == 1) / F.count(F.lit(1))).alias("HET_PROP"), F.sum(F.when(F.col("GT_BIN") == 1, F.col("ALLELE_REF_DEPTH"))).alias("R"), F.sum(F.when(F.col("GT_BIN") == 1, F.col("ALLELE_ALT_DEPTH"))).alias("A"))
    t = F.col("R") + F.col("A")
    return h.select("MARKERS", "HET_PROP", F.try_divide("R", t).alias("RATIO"), F.round(-(t / 2 - F.col("R")) / F.sqrt(t / 4), 6).alias("Z_SCORE"))


def missingness(g: DataFrame, marker_max: int | None = None) -> DataFrame:
    """Presence matrix, long, of all markers or, if asked for, of the ``marker_max`` best genotyped ones."""
    if marker_max is None:
        return g.select("INDIVIDUALS", "STRATA", "MARKERS", F.col("GT_BIN").isNotNull().cast("int").alias("GENOTYPED"))
    top = stats.genotype_counts(g, "MARKERS").orderBy(F.desc("N"), "MARKERS").limit(marker_max).select("MARKERS")
    return g.join(top, "MARKERS", "left_semi").select("INDIVIDUALS", "STRATA", "MARKERS", F.col("GT_BIN").isNotNull().cast("int").alias("GENOTYPED"))


def reference_genome(markers: DataFrame, header: str | None = None) -> DataFrame:
    """Whether positions are on a reference: the header says so, or chromosomes are several or named like scaffolds."""
    if header is not None and ("##reference" in header or "##contig" in header):
        return markers.sparkSession.range(1).select(F.lit(True).alias("REF_GENOME"))
    named = F.max(F.lower("CHROM").rlike("chr|scaffold|contig|^nc_|^nw_|^lg"))
    return markers.agg((F.coalesce(named, F.lit(False)) | (F.count_distinct("CHROM") > 1)).alias("REF_GENOME"))


def microsatellites(sequences: DataFrame, unit: int = 6, repeats: int = 4) -> DataFrame:
    """Markers whose SEQUENCE holds a unit of 2 to ``unit`` bases at least ``repeats`` times in a row."""
    return sequences.select("MARKERS", F.upper("SEQUENCE").rlike(rf"([ACGT]{{2,{unit}}}?)\1{{{repeats - 1},}}").alias("SSR"))


def _runs(unit: int, repeats: int):
    """Maximal stretches of SEQUENCE that repeat after ``unit`` bases at least ``repeats`` times: an array of (START, LENGTH)."""
    base = F.split(F.upper("SEQUENCE"), "")
    same = F.zip_with(base, F.slice(base, unit + 1, F.greatest(F.size(base) - unit, F.lit(0))), lambda x, y: F.when((x == y) & x.isin("A", "C", "G", "T"), "1").otherwise("0"))
    kind = "struct<at:int,found:array<struct<START:int,LENGTH:int>>>"
    # stretches of matches stand between mismatches; only long ones are kept
    step = lambda a, r: F.struct(
        (a["at"] + F.length(r) + 1).alias("at"),
        F.when(F.length(r) >= unit * (repeats - 1), F.array_append(a["found"], F.struct((a["at"] + 1).alias("START"), (F.length(r) + unit).alias("LENGTH")))).otherwise(a["found"]).alias("found"),
    ).cast(kind)
    return F.aggregate(F.split(F.array_join(same, ""), "0"), F.expr("named_struct('at', 0, 'found', array())").cast(kind), step, lambda a: a["found"])


def canonical_motif(motif: Column, unit: int) -> Column:
    """The smallest of a motif's rotations and those of its reverse complement."""
    turns = lambda m: [F.concat(F.substring(m, i + 1, unit - i), F.substring(m, 1, i)) for i in range(unit)]
    return F.array_min(F.array(*turns(motif), *turns(F.reverse(F.translate(motif, "ACGT", "TGCA")))))


def tandem_repeats(sequences: DataFrame, units: tuple[int, int] = (2, 6), repeats: int = 5) -> DataFrame:
    """Simple sequence repeats: a row for each maximal run of a motif of ``units`` bases that stands ``repeats`` times or more.

    START and END (from 1) hold whole copies, LENGTH also the part of a copy at the end.  A motif is no repeat of a shorter one.
    CANONICAL is equal for motifs that are the same one read from another base or on the other strand.  Letters other than A, C, G and T
    end a run; a null SEQUENCE has none.
    """
    out = []
    for unit in range(units[0], units[1] + 1):
        x = sequences.select("MARKERS", "SEQUENCE", F.explode(_runs(unit, repeats)).alias("r")).select("MARKERS", F.length("SEQUENCE").alias("SEQUENCE_LENGTH"), "r.*", F.upper(F.expr(f"substring(SEQUENCE, r.START, {unit})")).alias("MOTIF"))
        for d in range(1, unit):
            if unit % d == 0:
                x = x.filter(F.repeat(F.substring("MOTIF", 1, d), F.lit(unit // d)) != F.col("MOTIF"))
        n = F.floor(F.col("LENGTH") / unit).cast("int")
        out.append(x.select("MARKERS", "SEQUENCE_LENGTH", "START", (F.col("START") + n * unit - 1).alias("END"), "LENGTH", n.alias("REPETITIONS"), "MOTIF", canonical_motif(F.col("MOTIF"), unit).alias("CANONICAL")))
    return functools.reduce(DataFrame.unionByName, out)


def microsatellite_lists(sequences: DataFrame, units: tuple[int, int] = (2, 6), repeats: int = 5) -> DataFrame:
    """Each marker with its number of repeats' runs and the most copies in one; LIST is ``blacklist`` where it has any."""
    t = tandem_repeats(sequences, units, repeats).groupBy("MARKERS").agg(F.count(F.lit(1)).alias("N_RUNS"), F.max("REPETITIONS").alias("REPETITIONS_MAX"))
    x = sequences.select("MARKERS").distinct().join(t, "MARKERS", "left")
    return x.select("MARKERS", F.coalesce("N_RUNS", F.lit(0)).cast("long").alias("N_RUNS"), "REPETITIONS_MAX", F.when(F.col("N_RUNS").isNotNull(), "blacklist").otherwise("whitelist").alias("LIST"))


def calibration_problem(g: DataFrame, by: str = "count") -> DataFrame:
    """Markers whose reference allele is rarer than the alternate, by genotype counts or depth."""
    m = stats.minor_alleles(g).select("MARKERS", "REF_COUNT", "ALT_COUNT")
    if by == "depth":
        m = g.groupBy("MARKERS").agg(F.coalesce(F.sum("ALLELE_REF_DEPTH"), F.lit(0)).alias("REF_COUNT"), F.coalesce(F.sum("ALLELE_ALT_DEPTH"), F.lit(0)).alias("ALT_COUNT"))
    return m.filter("REF_COUNT < ALT_COUNT").select("MARKERS")


def summarize_sex(g: DataFrame, depth: int = 1) -> DataFrame:
    """By marker: absence, heterozygosity and depth of females and males (STRATA F and M), their mean, difference M - F and ratio F / M, rounded to 6."""
    gone = F.col("READ_DEPTH").isNull() | (F.col("READ_DEPTH") < depth)
    a = []
    for s in ("F", "M"):
        own = F.col("STRATA") == s
        a += [F.avg(F.when(own, gone.cast("int"))).alias(f"ABSENT_{s}"), F.avg(F.when(own, (F.col("GT_BIN") == 1).cast("int"))).alias(f"HET_{s}"), F.avg(F.when(own, F.coalesce("READ_DEPTH", F.lit(0)))).alias(f"DEPTH_{s}")]
    w = g.filter(F.col("STRATA").isin("F", "M")).groupBy("MARKERS").agg(*a)
    out = []
    for c in ("ABSENT", "HET", "DEPTH"):
        f, m = F.col(f"{c}_F"), F.col(f"{c}_M")
        r = lambda x, n: F.round(x, 6).alias(n)
        out += [r(f, f"{c}_F"), r(m, f"{c}_M"), r((f + m) / 2, f"{c}_MEAN"), r(m - f, f"{c}_DIFF"), r(F.try_divide(f, m), f"{c}_RATIO")]
    return w.select("MARKERS", *out)


def sexy_markers(s: DataFrame, y: float, ratio: float, het_diff: float) -> DataFrame:
    """Sex-linked markers of ``summarize_sex``: Y or W by absence, X or Z by heterozygosity or depth, with the method."""
    y_hit = F.col("ABSENT_DIFF") < y if y < 0 else F.col("ABSENT_DIFF") > y
    d_hit = F.col("DEPTH_RATIO") > ratio if ratio > 1 else F.col("DEPTH_RATIO") < ratio
    h_hit = F.col("HET_DIFF") < het_diff if het_diff < 0 else F.col("HET_DIFF") > het_diff
    x = F.array(F.when(y_hit, "presence/absence"), F.when(h_hit & ~F.coalesce(y_hit, F.lit(False)), "heterozygosity"), F.when(d_hit & ~F.coalesce(y_hit, F.lit(False)), "coverage"))
    return s.select("MARKERS", F.explode(F.array_compact(x)).alias("METHOD"))


def genetic_sex(g: DataFrame, y_markers: DataFrame, threshold: float = 1) -> DataFrame:
    """F where the mean depth over the Y markers is missing or at most the threshold, else M."""
    d = g.join(y_markers, "MARKERS", "left_semi").groupBy("INDIVIDUALS").agg(F.avg("READ_DEPTH").alias("d"))
    return d.select("INDIVIDUALS", F.when(F.col("d").isNull() | (F.col("d") <= threshold), "F").otherwise("M").alias("GENETIC_SEX"))


def windows_het(g: DataFrame, size: int = 100) -> DataFrame:
    """Windows of a fixed number of SNPs along a chromosome: heterozygosity and missingness of each, rounded to 6."""
    place = F.row_number().over(Window.partitionBy("CHROM").orderBy(F.col("POS").cast("long"), "MARKERS"))
    w = g.select("MARKERS", "CHROM", "POS").distinct().withColumn("WINDOW", F.floor((place - 1) / size).cast("long")).select("MARKERS", "WINDOW")
    j = g.join(w, "MARKERS").groupBy("CHROM", "WINDOW").agg(F.count_distinct("MARKERS").alias("N_SNP"), F.round(F.count_if(F.col("GT_BIN") == 1) / F.count("GT_BIN"), 6).alias("HET"), F.round(1 - F.count("GT_BIN") / F.count(F.lit(1)), 6).alias("MISSING"))
    return j
