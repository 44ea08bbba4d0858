"""The filter cascade with its before and after ledger.

A step takes a ``Dataset`` and returns one with more rows tagged.  Thresholds are arguments; nothing is mutated.  Filters of
markers read one table of sums by marker (``stats.marker_sums``), which is made by one pass over the live genotypes and holds
until samples go; filters of samples and of pairs read the live genotypes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..model import WHITELIST, Dataset
from ..operators import detect, filters, hwe, ld, pairs, stats

LEDGER = "FILTERS string, PARAMETERS string, VALUES string, BEFORE string, AFTER string, BLACKLIST string, UNITS string, COMMENTS string"
UNITS = "individual / strata / chrom / locus / SNP"


def numbers(ds: Dataset, known: tuple[int, ...] | None = None, changed: str = "") -> tuple[int, ...]:
    """Live samples, strata, chromosomes, loci and markers, from the dimensions alone; of ``known`` numbers only those of the ``changed`` dimension are counted again."""
    if known is None or changed != "MARKERS":
        s = tuple(ds.individuals.filter(F.col("FILTERS") == WHITELIST).agg(F.count_distinct("INDIVIDUALS"), F.count_distinct("STRATA")).first())
    else:
        s = known[:2]
    if known is not None and changed == "INDIVIDUALS":
        return (*s, *known[2:])
    have = ds.markers.columns
    m = ds.markers.filter(F.col("FILTERS") == WHITELIST).agg(*[F.count_distinct(c) if c in have else F.lit(0) for c in ("CHROM", "LOCUS", "MARKERS")]).first()
    return (*s, *m)


@dataclass(frozen=True)
class Step:
    name: str
    parameter: str
    value: str
    bad: Callable[[DataFrame], DataFrame]
    on: str = "MARKERS"
    sums: bool = False


def _long_ld(g: DataFrame, threshold: float, method: str, window: int | None) -> DataFrame:
    """Of each group of linked markers the best genotyped one stays; with a window, markers are pruned along it instead."""
    if window is not None:
        return ld.sliding_window(g, threshold, window, method)
    return pairs.ld_pruning(pairs.linkage(g, least=threshold, method=method), stats.marker_stats(g), threshold)


def steps(strands=None, vcf_filter=False, haplotype_format=False, reproducibility=None, monomorphic=True, common=True, whitelist=None, blacklist_id=None, missing=None, heterozygosity=None, coverage_total=None, ma=None, ma_stat="mac", coverage=None, genotyping=None, position=None, snp_number=None, short_ld=None, long_ld=None,
          mixed=None, duplicates=None, hwe_level=None, ld_method="r2", ld_window=None) -> list[Step]:
    """The cascade's steps in their order; an argument left out leaves its step out.

    ``whitelist`` and ``blacklist_id`` are tables (MARKERS; INDIVIDUALS); ``strands`` is the rule for markers at one place,
    ``long_ld`` the largest linkage (by ``ld_method``; within ``ld_window`` bases, if given) between markers of a chromosome that
    both stay, ``duplicates`` the relative distance
    under which two samples are one genome.
    """
    out = []
    add = lambda *x: out.append(Step(*x))
    by_sums = lambda name, parameter, value, f: add(name, parameter, str(value), f, "MARKERS", True)
    if strands is not None:
        by_sums("filter.duplicated.markers.strands", "rule", strands, lambda m: filters.duplicated_strands(stats.marker_columns(m), strands))
    if vcf_filter:
        by_sums("filter.vcf.filter.column", "PASS", "TRUE", filters.vcf_filter_column)
    if haplotype_format:
        by_sums("filter.haplotype.format", "filter.haplotype.format", "TRUE", filters.haplotype_format)
    if reproducibility is not None:
        by_sums("filter.reproducibility", "REP_AVG", reproducibility, lambda m: filters.beyond(m, "REP_AVG", low=reproducibility))
    if monomorphic:
        by_sums("filter.monomorphic", "filter.monomorphic", "TRUE", lambda m: m.filter("int(N0 > 0) + int(N1 > 0) + int(N2 > 0) = 1"))
    if common:
        by_sums("filter.common.markers", "filter.common.markers", "TRUE", lambda m: m.filter("LEAST = 0"))
    if whitelist is not None:
        by_sums("filter.whitelist", "whitelist.markers", "table", lambda m: m.join(whitelist.select("MARKERS").distinct(), "MARKERS", "left_anti"))
    if blacklist_id is not None:
        add("filter.blacklist.id", "blacklist.id", "table", lambda g: blacklist_id, "INDIVIDUALS")
    if missing is not None or heterozygosity is not None or coverage_total is not None:
        add("filter.individuals", "missing, heterozygosity, coverage", f"{missing}, {heterozygosity}, {coverage_total}", lambda g: filters.individuals(stats.individual_stats(g), missing, heterozygosity, coverage_total), "INDIVIDUALS")
    if ma is not None:
        by_sums("filter.ma", ma_stat, ma, lambda m: filters.minor_allele(stats.minor_columns(m), ma_stat, ma))
    if coverage is not None:
        by_sums("filter.coverage", "mean", coverage, lambda m: filters.coverage(stats.marker_columns(m), *coverage))
    if genotyping is not None:
        by_sums("filter.genotyping", "missing", genotyping, lambda m: filters.genotyping(stats.marker_columns(m), genotyping))
    if position is not None:
        by_sums("filter.snp.position.read", "rule", position, lambda m: filters.snp_position(stats.marker_columns(m), position))
    if snp_number is not None:
        by_sums("filter.snp.number", "snp per locus", snp_number, lambda m: filters.snp_number(stats.marker_columns(m), snp_number))
    if short_ld is not None:
        by_sums("filter.short.ld", "rule", short_ld, lambda m: filters.short_ld(stats.marker_columns(m), short_ld))
    if long_ld is not None:
        add("filter.long.ld", "threshold", str(long_ld), lambda g: _long_ld(g, long_ld, ld_method, ld_window).filter("not KEEP").select("MARKERS"))
    if mixed is not None:
        add("detect.mixed.genomes", "heterozygosity", str(mixed), lambda g: detect.mixed_genomes(g, *mixed), "INDIVIDUALS")
    if duplicates is not None:
        add("detect.duplicate.genomes", "distance", str(duplicates), lambda g: pairs.remove_duplicates(pairs.near_samples(g, duplicates), stats.individual_stats(g)).filter("not KEEP").select("INDIVIDUALS"), "INDIVIDUALS")
    if hwe_level is not None:
        add("filter.hwe", "midp level", str(hwe_level), lambda g: hwe.blacklist(hwe.hwe(g), level=hwe_level))
    return out


def run(ds: Dataset, todo: list[Step]) -> Dataset:
    """Apply the steps; each adds a ledger row."""
    before, sums = numbers(ds), None
    show = lambda n: " / ".join(map(str, n))
    for s in todo:
        if s.sums:
            sums = pairs.checkpointed(stats.marker_sums(ds.live())) if sums is None else sums
            bad = s.bad(sums)
        else:
            bad = s.bad(ds.live())
        bad = pairs.checkpointed(bad.select(s.on).distinct())  # the tag is read again by every later step
        if s.on == "MARKERS":
            ds = ds.blacklist_markers(bad, s.name)
            sums = sums.join(bad, "MARKERS", "left_anti") if sums is not None else None
        else:
            ds, sums = ds.blacklist_individuals(bad, s.name), None
        after = numbers(ds, before, s.on)
        row = {"FILTERS": s.name, "PARAMETERS": s.parameter, "VALUES": s.value, "BEFORE": show(before), "AFTER": show(after), "BLACKLIST": show([a - b for a, b in zip(before, after, strict=True)]), "UNITS": UNITS, "COMMENTS": ""}
        ds = replace(ds, ledger=(*ds.ledger, row))
        before = after
    return ds


def import_vcf(spark: SparkSession, path: str, strata: DataFrame | None = None, **options) -> Dataset:
    """A VCF as a dataset after the import cascade: samples without a stratum are tagged, then the steps of ``options``.

    By default: FILTER column, SNPs only, monomorphic and common markers; ``READ_OPTIONS`` has the names.
    """
    from ..sources import readers

    opt = READ_OPTIONS.resolve(options)
    g = readers.read_vcf(spark, path).drop("STRATA")
    known = strata if strata is not None else g.select("INDIVIDUALS").distinct().withColumn("STRATA", F.lit("pop"))
    known = known.select(names.clean_ind_names(F.col("INDIVIDUALS")).alias("INDIVIDUALS"), "STRATA").distinct()
    ds = Dataset.from_tidy(g.join(known, "INDIVIDUALS", "left"), source=readers.vcf_header(spark, path)["source"])
    ds = ds.blacklist_individuals(ds.individuals.filter("STRATA is null").select("INDIVIDUALS"), "filter.strata")
    todo = steps(strands=opt["filter_strands"], vcf_filter=opt["vcf_filter"], haplotype_format=opt["haplotype_format"], monomorphic=opt["filter_monomorphic"], common=opt["filter_common_markers"], whitelist=opt["whitelist_markers"], blacklist_id=opt["blacklist_id"], missing=opt["missing"], heterozygosity=opt["heterozygosity"],
                 **{k: opt[k] for k in ("ma", "coverage", "genotyping", "position", "snp_number", "short_ld", "long_ld")})
    return run(ds, todo)


def ledger(spark: SparkSession, ds: Dataset) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in ds.ledger], LEDGER)


@dataclass
class Options:
    """Named options with defaults; unknown and retired names are told apart."""

    defaults: dict
    retired: set = field(default_factory=set)

    def resolve(self, given: dict) -> dict:
        if bad := sorted(set(given) & self.retired):
            raise ValueError(f"retired options: {', '.join(bad)}")
        if bad := sorted(set(given) - set(self.defaults)):
            raise ValueError(f"unknown options: {', '.join(bad)}")
        return {**self.defaults, **given}


READ_OPTIONS = Options({"filter_strands": None, "vcf_filter": True, "haplotype_format": True, "filter_monomorphic": True, "filter_common_markers": True, "whitelist_markers": None, "blacklist_id": None, "missing": None, "heterozygosity": None, "ma": None, "coverage": None, "genotyping": None, "position": None, "snp_number": None, "short_ld": None, "long_ld": None}, {"maf_thresholds", "imputation_method"})


def choose_markers_subsample(n_markers: int, n_ind: int, max_gb: float = 10, bytes_per_cell: int = 4, n_matrices: int = 1, small: int = 200_000, cap: float = 0.3, margin: float = 0.9) -> float:
    """The largest allowed share of markers whose matrices fit in memory; 1 for few markers."""
    if n_markers < small:
        return 1.0
    for share in (0.3, 0.2, 0.1, 0.05, 0.02, 0.01):
        cells = n_markers * share * n_ind
        if share <= cap and cells < 2**31 and cells * bytes_per_cell * n_matrices <= max_gb * 1e9 * margin:
            return share
    return 0.01
