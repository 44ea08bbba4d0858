"""Output formats as whole text files.

A file is a *document*: a DataFrame of lines with the keys (SEC, BLOCK, ORD, KEY) that put them in order.  Sections are
headers, name lists, bodies and ends; blocks are strata or chromosomes.  Wide lines (a sample's markers, a marker's
samples) are built by one aggregate each, never by a wide DataFrame, and ``write_document`` sorts and writes in parallel.
Alleles are the codes 1 to 4 of A, C, G and T where a format wants numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from ..operators import pairs, recode, stats
from ..operators.order import numbered

DOC = "SEC int, BLOCK string, ORD long, KEY string, LINE string"
TITLE = "genotypes written by snpweave"


def _joined(cell: Column, by: str, sep: str) -> Column:
    x = F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), cell.alias("v"))))
    return F.array_join(F.transform(x, lambda s: s["v"]), sep)


def sample_lines(g: DataFrame, cell: Column, sep: str = "\t") -> DataFrame:
    """(INDIVIDUALS, STRATA, BODY): the cells of a sample by marker."""
    return g.groupBy("INDIVIDUALS", "STRATA").agg(_joined(cell.cast("string"), "MARKERS", sep).alias("BODY"))


def marker_lines(g: DataFrame, cell: Column, sep: str = "\t", keys=("MARKERS",)) -> DataFrame:
    """(MARKERS, .., NS, BODY): the cells of a marker by sample."""
    return g.groupBy(*keys).agg(F.count("GT_BIN").alias("NS"), _joined(cell.cast("string"), "INDIVIDUALS", sep).alias("BODY"))


def pop_number(g: DataFrame) -> DataFrame:
    """Strata numbered by name."""
    s = g.select("STRATA").distinct()
    return s.withColumn("POP", F.row_number().over(Window.orderBy("STRATA")))


# ---- documents ----------------------------------------------------------------------------------------------------


def part(df: DataFrame, sec: int, line: Column, block="", order=0, key="") -> DataFrame:
    """The rows of ``df`` as lines of a section."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(sec).alias("SEC"), as_column(block).alias("BLOCK"), as_column(order).cast("long").alias("ORD"), as_column(key).alias("KEY"), line.alias("LINE"))


def fixed(g: DataFrame, sec: int, lines: list[str]) -> DataFrame:
    return g.sparkSession.createDataFrame([(sec, "", i, "", x) for i, x in enumerate(lines)], DOC)


def document(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def named(g: DataFrame, sec: int, sep: str, line: Callable[[Column], Column], by: str = "MARKERS", order: int = 0) -> DataFrame:
    """One line made of the sorted names of all markers (or samples): the format wants it whole."""
    names = F.array_sort(F.collect_set(by))
    return part(g.agg(names.alias("n")), sec, line(F.array_join(F.col("n"), sep) if sep is not None else F.col("n")), order=order)


def samples_body(s: DataFrame, sec: int, line: Column, order=1) -> DataFrame:
    return part(s, sec, line, F.col("STRATA"), order, F.col("INDIVIDUALS"))


def _b() -> Column:
    return F.col("GT_BIN")


def _two(hom_ref, het, hom_alt, missing: str) -> Column:
    return F.when(_b() == 0, hom_ref).when(_b() == 1, het).when(_b() == 2, hom_alt).otherwise(missing)


def number(allele: str) -> Column:
    """1 to 4 for A, C, G, T; 0 for others."""
    return gt.code(F.col(allele)).cast("int").cast("string")


def pair(missing: str, sep: str) -> Column:
    """Two columns for a genotype, in allele codes."""
    r, a = number("REF"), number("ALT")
    return _two(F.concat_ws(sep, r, r), F.concat_ws(sep, r, a), F.concat_ws(sep, a, a), f"{missing}{sep}{missing}")


def copy(k: int, missing: str, of: Callable[[str], Column]) -> Column:
    """The first (0) or second (1) allele of a genotype."""
    return F.when(_b() > 1 - k, of("ALT")).when(_b() <= 1 - k, of("REF")).otherwise(missing)


def _tabbed(*cells) -> Column:
    return F.concat_ws("\t", *cells)


def vcf(g: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """VCF 4.3; ``fields`` (columns of ``g``) follow the genotype of each sample."""
    call = F.concat_ws(":", gt.vcf_from_bin(_b()), *[F.coalesce(F.col(f).cast("string"), F.lit(".")) for f in fields])
    m = marker_lines(g, call, "\t", ("CHROM", "POS", "MARKERS", "REF", "ALT"))
    line = _tabbed("CHROM", "POS", "MARKERS", "REF", "ALT", F.lit("."), F.lit("PASS"), F.concat(F.lit("NS="), F.col("NS").cast("string")), F.lit(":".join(["GT", *fields])), "BODY")
    lead = F.lit("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]))
    return document(fixed(g, 0, vcf_header(fields)), named(g, 1, "\t", lambda n: _tabbed(lead, n), "INDIVIDUALS"), part(m, 2, line, F.col("CHROM"), F.col("POS").cast("long"), F.col("MARKERS")))


def vcf_header(fields: tuple[str, ...] = ()) -> list[str]:
    own = [f'##FORMAT=<ID={f},Number=1,Type=String,Description="{f.capitalize()}">' for f in fields]
    return ["##fileformat=VCFv4.3", '##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *own]


def tped(g: DataFrame) -> DataFrame:
    two = _two(F.concat_ws(" ", "REF", "REF"), F.concat_ws(" ", "REF", "ALT"), F.concat_ws(" ", "ALT", "ALT"), "0 0")
    m = marker_lines(g, two, " ", ("CHROM", "POS", "MARKERS"))
    return part(m, 0, F.concat_ws(" ", "CHROM", "MARKERS", F.lit("0"), "POS", "BODY"), F.col("CHROM"), F.col("POS").cast("long"), F.col("MARKERS"))


def tfam(g: DataFrame) -> DataFrame:
    return part(g.select("INDIVIDUALS", "STRATA").distinct(), 0, F.concat_ws(" ", "STRATA", "INDIVIDUALS", F.lit("0 0 0 -9")), key=F.col("INDIVIDUALS"))


def genepop(g: DataFrame) -> DataFrame:
    """Title, all loci on one line, and a block of samples after ``pop`` for each stratum."""
    s = sample_lines(g, gt.gt_from_bin(_b(), F.col("REF"), F.col("ALT")), " ")
    blocks = part(g.select("STRATA").distinct(), 2, F.lit("pop"), F.col("STRATA"))
    return document(fixed(g, 0, [TITLE]), named(g, 1, ", ", lambda n: n), blocks, samples_body(s, 2, F.concat(F.col("INDIVIDUALS"), F.lit(", "), F.col("BODY"))))


def genepopedit(g: DataFrame) -> DataFrame:
    s = sample_lines(g, gt.gt_from_bin(_b(), F.col("REF"), F.col("ALT")), "\t")
    head = named(g, 0, "\t", lambda n: _tabbed(F.lit("SampleID\tPopulation\tSampleNum"), n))
    return document(head, samples_body(s, 1, _tabbed("INDIVIDUALS", "STRATA", "INDIVIDUALS", "BODY")))


def hierfstat(g: DataFrame) -> DataFrame:
    """Numbers of strata, loci, the largest allele code and its digits; the loci; stratum and genotype codes (missing 00)."""
    r, a = number("REF"), number("ALT")
    s = sample_lines(g, _two(F.concat(r, r), F.concat(r, a), F.concat(a, a), "00"), "\t").join(pop_number(g), "STRATA")
    top = F.max(F.greatest(F.when(_b() < 2, r.cast("int")), F.when(_b() > 0, a.cast("int"))))
    n = g.agg(F.count_distinct("STRATA").alias("np"), F.count_distinct("MARKERS").alias("nl"), top.alias("nu"))
    head = part(n, 0, F.concat_ws(" ", *[F.col(c).cast("string") for c in ("np", "nl", "nu")], F.lit("1")))
    loci = part(g.select("MARKERS").distinct(), 1, F.col("MARKERS"), key=F.col("MARKERS"))
    return document(head, loci, samples_body(s, 2, _tabbed(F.col("POP").cast("string"), "BODY")))


def structure(g: DataFrame) -> DataFrame:
    s = sample_lines(g, pair("-9", "\t"), "\t").join(pop_number(g), "STRATA")
    return document(named(g, 0, "\t", lambda n: n), samples_body(s, 1, _tabbed("INDIVIDUALS", F.col("POP").cast("string"), "BODY")))


def faststructure(g: DataFrame) -> DataFrame:
    """Copies of the reference allele are 1, of the alternate 2; no header."""
    s = sample_lines(g, _two("1\t1", "1\t2", "2\t2", "-9\t-9"), "\t").join(pop_number(g), "STRATA")
    return samples_body(s, 0, _tabbed("INDIVIDUALS", F.col("POP").cast("string"), F.lit("1\t1\t1\t1"), "BODY"))


def arlequin(g: DataFrame) -> DataFrame:
    """A project file: profile, a block of samples (a line for each allele copy) by stratum, and one group of all strata."""
    code = lambda c: gt.code(F.col(c))
    bodies = [sample_lines(g, copy(k, "-9", code), "\t") for k in (0, 1)]
    pops = g.groupBy("STRATA").agg(F.count_distinct("INDIVIDUALS").cast("string").alias("n"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    profile = ["GenotypicData = 1", "LocusSeparator = WHITESPACE", "GameticPhase = 0", "MissingData = '?'", "DataType = STANDARD", "[Data]", "[[Samples]]"]
    return document(
        fixed(g, 0, ["[Profile]", f'Title = "{TITLE}"']), part(g.agg(F.count_distinct("STRATA").cast("string").alias("n")), 1, F.concat(F.lit("NbSamples = "), "n")), fixed(g, 2, profile),
        *[part(pops, 3, x, F.col("STRATA"), i) for i, x in enumerate((F.concat(F.lit("SampleName = "), quoted("STRATA")), F.concat(F.lit("SampleSize = "), "n"), F.lit("SampleData = {")))],
        samples_body(bodies[0], 3, _tabbed("INDIVIDUALS", "BODY"), 3).withColumn("KEY", F.concat("KEY", F.lit(" 1"))), samples_body(bodies[1], 3, _tabbed(F.lit(""), "BODY"), 3).withColumn("KEY", F.concat("KEY", F.lit(" 2"))),
        part(pops, 3, F.lit("}"), F.col("STRATA"), 4), fixed(g, 4, ["[[Structure]]", 'StructureName = "One cluster"', "NbGroups = 1", "Group = {"]), part(pops, 5, quoted("STRATA"), F.col("STRATA")), fixed(g, 6, ["}"]),
    )


def bayescan(g: DataFrame) -> DataFrame:
    """Numbers of loci and populations, then by population the copies, 2, and both counts of each marker."""
    c = stats.genotype_counts(g, "STRATA", "MARKERS").filter("N > 0")
    j = c.join(numbered(g.select("MARKERS").distinct(), "MARKER", "MARKERS"), "MARKERS").join(pop_number(g), "STRATA")
    n = [2 * F.col("N"), F.lit(2), 2 * F.col("N0") + F.col("N1"), 2 * F.col("N2") + F.col("N1")]
    total = lambda by, name: part(g.agg(F.count_distinct(by).cast("string").alias("n")), 0 if by == "MARKERS" else 2, F.concat(F.lit(f"[{name}]="), "n"))
    pop = F.lpad(F.col("POP").cast("string"), 6, "0")
    p = pop_number(g)
    return document(
        total("MARKERS", "loci"), fixed(g, 1, [""]), total("STRATA", "populations"), fixed(g, 3, [""]), part(p, 4, F.concat(F.lit("[pop]="), F.col("POP").cast("string")), pop),
        part(j, 4, F.concat_ws(" ", F.col("MARKER").cast("string"), *[x.cast("string") for x in n]), pop, F.col("MARKER")), part(p, 4, F.lit(""), pop, 2**40),
    )


def betadiv(g: DataFrame) -> DataFrame:
    """The alternate allele's frequency of each marker in each stratum (long form of the matrix)."""
    c = stats.genotype_counts(g, "STRATA", "MARKERS").filter("N > 0")
    return c.select("STRATA", "MARKERS", ((2 * F.col("N2") + F.col("N1")) / (2 * F.col("N"))).alias("FREQ"))


def dadi(g: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """In- and out-group context, and both alleles' counts by stratum, of each marker.

    ``context`` has (MARKERS, IN_GROUP, OUT_GROUP): the three bases around the SNP in both groups; ``---`` where unknown.
    """
    c = stats.genotype_counts(g, "MARKERS", "REF", "ALT", "STRATA")
    j = c.groupBy("MARKERS", "REF", "ALT").agg(F.array_sort(F.collect_list(F.struct("STRATA", (2 * F.col("N0") + F.col("N1")).alias("a"), (2 * F.col("N2") + F.col("N1")).alias("b")))).alias("x"))
    j = j.join(context, "MARKERS", "left") if context is not None else j.withColumn("IN_GROUP", F.lit("---")).withColumn("OUT_GROUP", F.lit("---"))
    side = lambda k: F.array_join(F.transform("x", lambda s: s[k].cast("string")), "\t")
    known = lambda c: F.coalesce(c, F.lit("---"))
    line = _tabbed(known("IN_GROUP"), known("OUT_GROUP"), "REF", side("a"), "ALT", side("b"), "MARKERS")
    head = named(g, 1, "\t", lambda n: _tabbed(F.lit("IN_GROUP\tOUT_GROUP\tAllele1"), n, F.lit("Allele2"), n, F.lit("MARKERS")), "STRATA")
    return document(fixed(g, 0, [f"# {TITLE}"]), head, part(j, 2, line, key=F.col("MARKERS")))


def sequence_context(sites: DataFrame, fasta: DataFrame) -> DataFrame:
    """(MARKERS, CONTEXT): the base before, the SNP and the base after.  ``sites`` has (MARKERS, LOCUS, COL from 0), ``fasta`` (LOCUS, SEQUENCE)."""
    j = sites.join(fasta, "LOCUS")
    around = F.concat(F.when(F.col("COL") > 0, F.substring("SEQUENCE", F.col("COL"), F.lit(1))).otherwise("-"), F.substring("SEQUENCE", F.col("COL") + 1, F.lit(1)), F.when(F.col("COL") + 1 < F.length("SEQUENCE"), F.substring("SEQUENCE", F.col("COL") + 2, F.lit(1))).otherwise("-"))
    return j.filter(F.col("COL") < F.length("SEQUENCE")).select("MARKERS", around.alias("CONTEXT"))


def haplotypes(g: DataFrame) -> DataFrame:
    """Each locus as two haplotypes of its SNPs joined by ``/``; missing bases are N."""
    x = F.array_sort(F.collect_list(F.struct(F.col("POS").cast("long").alias("p"), copy(0, "N", F.col).alias("a"), copy(1, "N", F.col).alias("b"))))
    h = g.groupBy("CHROM", "LOCUS", "INDIVIDUALS", "STRATA").agg(x.alias("x"))
    hap = lambda k: F.array_join(F.transform("x", lambda s: s[k]), "")
    return h.select("CHROM", "LOCUS", "INDIVIDUALS", "STRATA", F.concat(hap("a"), F.lit("/"), hap("b")).alias("HAPLOTYPES"))


def dictionary(g: DataFrame) -> DataFrame:
    """(INDIVIDUALS, STRATA, ID): the stratum and the sample's number by name; a stratum that begins with no letter gets one."""
    s = g.select("INDIVIDUALS", "STRATA").distinct().withColumn("__n", F.row_number().over(Window.orderBy("INDIVIDUALS")))
    return s.select("INDIVIDUALS", "STRATA", F.concat(F.when(F.col("STRATA").rlike("^[A-Za-z]"), "").otherwise("P"), "STRATA", F.col("__n").cast("string")).alias("ID"))


def fineradstructure(g: DataFrame) -> DataFrame:
    """The samples' numbers by stratum, then a line of haplotypes for each locus."""
    ids = dictionary(g)
    h = haplotypes(g).join(ids.select("INDIVIDUALS", "ID"), "INDIVIDUALS")
    lines = h.groupBy("CHROM", "LOCUS").agg(_joined(F.col("HAPLOTYPES"), "ID", "\t").alias("BODY"))
    return document(named(ids, 0, "\t", lambda n: n, "ID"), part(lines, 1, F.col("BODY"), F.col("CHROM"), key=F.col("LOCUS")))


def gsi_sim(g: DataFrame) -> DataFrame:
    """Numbers of samples and markers, the markers, and a block of samples after ``pop`` and its name for each stratum."""
    code = lambda c: gt.code(F.col(c))
    s = sample_lines(g, F.concat_ws(" ", copy(0, "000", code), copy(1, "000", code)), " ")
    n = g.agg(F.count_distinct("INDIVIDUALS").cast("string").alias("i"), F.count_distinct("MARKERS").cast("string").alias("m"))
    loci = part(g.select("MARKERS").distinct(), 1, F.col("MARKERS"), key=F.col("MARKERS"))
    blocks = part(g.select("STRATA").distinct(), 2, F.concat(F.lit("pop "), "STRATA"), F.col("STRATA"))
    return document(part(n, 0, F.concat_ws(" ", "i", "m")), loci, blocks, samples_body(s, 2, F.concat_ws(" ", "INDIVIDUALS", "BODY")))


def hapmap(g: DataFrame) -> DataFrame:
    two = _two(F.concat("REF", "REF"), F.concat("REF", "ALT"), F.concat("ALT", "ALT"), "NA")
    m = marker_lines(g, two, "\t", ("MARKERS", "CHROM", "POS", "REF", "ALT"))
    head = named(g, 0, "\t", lambda n: _tabbed(F.lit("rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode"), n), "INDIVIDUALS")
    line = _tabbed("MARKERS", F.concat_ws("/", "REF", "ALT"), "CHROM", "POS", F.lit("+"), *[F.lit("NA")] * 6, "BODY")
    return document(head, part(m, 1, line, key=F.col("MARKERS")))


def hzar(g: DataFrame) -> DataFrame:
    """Reference frequency and number of samples of each marker and stratum."""
    c = stats.genotype_counts(g, "STRATA", "MARKERS").filter("N > 0")
    return c.select("STRATA", "MARKERS", ((2 * F.col("N0") + F.col("N1")) / (2 * F.col("N"))).alias("FREQ_REF"), "N")


def ldna(g: DataFrame) -> DataFrame:
    """The lower triangle of the linkage matrix, long."""
    return pairs.linkage(g)


def _doubled(g: DataFrame, sec: int, lead: str, first: str, second: str) -> DataFrame:
    """A header with two columns for each marker."""
    both = lambda n: F.array_join(F.flatten(F.transform(n, lambda m: F.array(F.concat(m, F.lit(first)), F.concat(m, F.lit(second))))), "\t")
    return named(g, sec, None, lambda n: _tabbed(F.lit(lead), both(n)))


def maverick(g: DataFrame) -> DataFrame:
    """The data file; ``maverick_parameters`` is its companion."""
    s = sample_lines(g, pair("-9", "\t"), "\t").join(pop_number(g), "STRATA")
    return document(fixed(g, 0, [f"# {TITLE}"]), _doubled(g, 1, "INDIVIDUALS\tPOP_ID", "_A1", "_A2"), samples_body(s, 2, _tabbed("INDIVIDUALS", F.col("POP").cast("string"), "BODY")))


#: fixed values: the program's parameters by section, but for Kmax
_MAVERICK = {
    "Data properties": {"headerRow_on": "t", "popCol_on": "t", "ploidyCol_on": "f", "ploidy": "2", "missingData": "-9", "dataFormat": "2"},
    "Model parameters": {"Kmin": "1", "Kmax": "", "admix_on": "t", "fixAlpha_on": "t", "alpha": "1.0", "alphaPropSD": "0.10"},
    "Simulation parameters": {"exhaustive_on": "f", "mainRepeats": "3", "mainBurnin": "500", "mainSamples": "5000", "thermodynamic_on": "t", "thermodynamicRungs": "20", "thermodynamicBurnin": "500", "thermodynamicSamples": "1000", "EMalgorithm_on": "t", "EMrepeats": "100", "EMiterations": "100"},
    "Basic output properties": {k: "t" for k in ("outputLog_on", "outputLikelihood_on", "outputQmatrix_ind_on", "outputQmatrix_pop_on", "outputQmatrixError_ind_on", "outputQmatrixError_pop_on", "outputEvidence_on", "outputEvidenceNormalised_on", "outputEvidenceDetails_on")},
}


def maverick_parameters(g: DataFrame) -> DataFrame:
    """The parameter file: up to two clusters more than there are strata."""
    lines = [x for title, keys in _MAVERICK.items() for x in (f"#### {title}", *(f"{k}\t{v}" for k, v in keys.items()), "")]
    at = next(i for i, x in enumerate(lines) if x == "Kmax\t")
    most = part(g.agg((F.count_distinct("STRATA") + 2).cast("string").alias("k")), 0, F.concat(F.lit("Kmax\t"), "k"), order=at)
    return document(fixed(g, 0, lines).filter(F.col("ORD") != at), most)


def pcadapt(g: DataFrame) -> DataFrame:
    return part(marker_lines(g, F.coalesce(_b(), F.lit(9)), " "), 0, F.col("BODY"), key=F.col("MARKERS"))


def related(g: DataFrame) -> DataFrame:
    return part(sample_lines(g, pair("0", " "), " "), 0, F.concat_ws(" ", "INDIVIDUALS", "BODY"), key=F.col("INDIVIDUALS"))


def rubias(g: DataFrame, mixtures: tuple[str, ...] = ()) -> DataFrame:
    """Sample type, reporting unit, collection, sample, alleles (missing NA); strata in ``mixtures`` are mixtures without a unit."""
    mixed = F.col("STRATA").isin(*mixtures) if mixtures else F.lit(False)
    kind, unit = F.when(mixed, "mixture").otherwise("reference"), F.when(mixed, "NA").otherwise(F.col("STRATA"))
    s = sample_lines(g, pair("NA", "\t"), "\t")
    return document(_doubled(g, 0, "sample_type\trepunit\tcollection\tindiv", "_A1", "_A2"), samples_body(s, 1, _tabbed(kind, unit, "STRATA", "INDIVIDUALS", "BODY")))


def stockr(g: DataFrame) -> DataFrame:
    """The samples, their strata, then a line of dosages for each marker."""
    pops = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("INDIVIDUALS", "STRATA"))), lambda s: s["STRATA"]), "\t")
    m = marker_lines(g, F.coalesce(_b().cast("string"), F.lit("NA")), "\t")
    return document(named(g, 0, "\t", lambda n: _tabbed(F.lit("MARKERS"), n), "INDIVIDUALS"), part(g.agg(pops.alias("p")), 1, _tabbed(F.lit("STRATA"), "p")), part(m, 2, _tabbed("MARKERS", "BODY"), key=F.col("MARKERS")))


def genlight(g: DataFrame) -> DataFrame:
    """A sample's dosages by marker as an array (missing null)."""
    x = F.array_sort(F.collect_list(F.struct("MARKERS", _b().alias("d"))))
    return g.groupBy("INDIVIDUALS", "STRATA").agg(F.transform(x, lambda s: s["d"]).alias("DOSAGES"))


def genind(g: DataFrame) -> DataFrame:
    """Copies of each allele by sample and marker (long form of the count table)."""
    return pairs.allele_counts(g)


def gtypes(g: DataFrame) -> DataFrame:
    return recode.separate_gt(recode.gt_recoding(g), "GT", long=False)


def colony_markers(g: DataFrame) -> DataFrame:
    """Allele frequencies rounded to 2, as the configuration wants them."""
    return stats.allele_summary(g, "MARKERS").select("MARKERS", F.round("FREQ_REF", 2).alias("FREQ_1"), F.round("MAF", 2).alias("FREQ_2"))


def _set(value, what: str) -> str:
    return f"{value}\t! {what}"


def colony(g: DataFrame, frequencies: bool = False, inbreeding=0, males=0, females=0, clone=0, run_length=2, analysis=1, dropout=0, error=0.02, title: str = "offspring") -> DataFrame:
    """The configuration file: settings, optionally allele frequencies, markers, samples with their alleles (0 missing), and empty parent sections."""
    s = sample_lines(g, pair("0", " "), " ")
    counted = lambda by, what, order: part(g.agg(F.count_distinct(by).cast("string").alias("n")), 1, F.concat("n", F.lit(f"\t! {what}")), order=order)
    many = lambda value, what: lambda n: F.concat(F.array_join(F.transform(n, lambda _: F.lit(str(value))), " "), F.lit(f"\t! {what}"))
    settings = [_set(1234, "seed"), _set(0, "update allele frequencies"), _set(2, "2 dioecious, 1 monoecious"), _set(inbreeding, "inbreeding"), _set(0, "0 diploid, 1 haplodiploid"), _set(f"{males} {females}", "0 polygamy, 1 monogamy, of males and females"),
                _set(clone, "clone inference"), _set(1, "scale full sibships"), _set("0 0 0", "prior of the sibship size"), _set(int(frequencies), "known allele frequencies")]
    runs = [_set(1, "runs"), _set(run_length, "length of a run"), _set(0, "monitor by iterates"), _set(10000, "monitor interval"), _set(0, "no windows"), _set(analysis, "0 pairwise, 1 full likelihood, 2 both"), _set(3, "precision of the full likelihood")]
    end = ["", _set("0 0", "probability that fathers and mothers are candidates"), _set("0 0", "candidate males and females"), _set("0 0", "known fathers"), _set("0 0", "known mothers"),
           *[_set(0, x) for x in ("known paternal sibships", "known maternal sibships", "offspring with excluded fathers", "offspring with excluded mothers", "excluded paternal sibships", "excluded maternal sibships")]]
    parts = [fixed(g, 0, [_set(f"'{title}'", "dataset"), _set(f"'{title}'", "output")]), counted("INDIVIDUALS", "offspring", 0), counted("MARKERS", "loci", 1), fixed(g, 2, settings)]
    if frequencies:
        a = pairs.allele_counts(g).groupBy("MARKERS", "ALLELES").agg(F.sum("COUNT").alias("c")).filter("c > 0").withColumn("code", gt.code(F.col("ALLELES")).cast("int"))
        x = a.groupBy("MARKERS").agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("x"), F.sum("c").alias("n"))
        listed = F.array_join(F.transform("x", lambda v: v["code"].cast("string")), " ")
        shares = F.array_join(F.transform("x", lambda v: F.round(v["c"] / F.col("n"), 2).cast("string")), " ")
        sizes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("MARKERS", F.size("x").alias("k")))), lambda v: v["k"].cast("string")), " ")
        parts += [part(x.agg(sizes.alias("k")), 3, F.concat("k", F.lit("\t! alleles by locus"))), part(x, 4, listed, F.col("MARKERS")), part(x, 4, shares, F.col("MARKERS"), 1)]
    names = [named(g, 6, " ", lambda n: F.concat(n, F.lit("\t! markers")))] + [named(g, 6, None, many(v, w), order=i) for i, (v, w) in enumerate(((0, "0 codominant, 1 dominant"), (dropout, "allelic dropout"), (error, "other errors")), 1)]
    return document(*parts, fixed(g, 5, runs), *names, fixed(g, 7, [""]), samples_body(s, 8, F.concat_ws(" ", "INDIVIDUALS", "BODY")), fixed(g, 9, end))


def fasta(sequences: DataFrame) -> DataFrame:
    return sequences.select("MARKERS", F.concat(F.lit(">"), F.col("MARKERS"), F.lit("\n"), F.col("SEQUENCE")).alias("LINE"))


DOCUMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "vcf": vcf, "tped": tped, "tfam": tfam, "genepop": genepop, "genepopedit": genepopedit, "hierfstat": hierfstat, "structure": structure, "faststructure": faststructure, "arlequin": arlequin, "bayescan": bayescan,
    "dadi": dadi, "fineradstructure": fineradstructure, "gsi_sim": gsi_sim, "hapmap": hapmap, "maverick": maverick, "maverick_parameters": maverick_parameters, "pcadapt": pcadapt, "related": related, "rubias": rubias, "stockr": stockr, "colony": colony,
}
TABLE_WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {"betadiv": betadiv, "hzar": hzar, "ldna": ldna, "genlight": genlight, "genind": genind, "gtypes": gtypes, "snprelate": genlight}
#: formats that hold two alleles of a marker only
BIALLELIC = {"genlight", "snprelate", "tped", "vcf", "betadiv"}


def write_document(doc: DataFrame, path: str) -> None:
    """The lines in their order, as parts under ``path``."""
    doc.orderBy("SEC", "BLOCK", "ORD", "KEY").select("LINE").write.mode("overwrite").text(path)


def genomic_converter(g: DataFrame, outputs: list[str], folder: str) -> list[str]:
    """Write every wanted format under ``folder`` from one persisted table; biallelic formats refuse markers with more alleles."""
    if bad := [x for x in outputs if x not in DOCUMENTS and x not in TABLE_WRITERS]:
        raise ValueError(f"no such format: {', '.join(bad)}")
    g = g.persist()
    if BIALLELIC & set(outputs) and g.filter(F.contains(F.col("ALT"), F.lit(","))).limit(1).count():
        g.unpersist()
        raise ValueError(f"not biallelic, which {', '.join(sorted(BIALLELIC & set(outputs)))} need")
    done = []
    for name in outputs:
        path = f"{folder}/{name}"
        if name in DOCUMENTS:
            write_document(DOCUMENTS[name](g), path)
        else:
            TABLE_WRITERS[name](g).write.mode("overwrite").parquet(path)
        done.append(path)
    g.unpersist()
    return done


def write_rad(g: DataFrame, path: str, folders: int = 1000) -> None:
    """The long table as Parquet, in folders by chromosome; with more than ``folders`` of them (scaffolds) sorted by it instead."""
    w = g
    if "CHROM" not in g.columns:
        w.write.mode("overwrite").parquet(path)
    elif g.select("CHROM").distinct().limit(folders + 1).count() <= folders:
        w.write.mode("overwrite").partitionBy("CHROM").parquet(path)
    else:
        w.repartitionByRange("CHROM", "MARKERS").sortWithinPartitions("CHROM", "MARKERS").write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def split_vcf(g: DataFrame, groups: DataFrame, folder: str) -> list[str]:
    """One VCF for each SPLIT group of samples (INDIVIDUALS, SPLIT)."""
    names = [r[0] for r in groups.select("SPLIT").distinct().orderBy("SPLIT").collect()]
    for n in names:
        own = g.join(groups.filter(F.col("SPLIT") == n).select("INDIVIDUALS"), "INDIVIDUALS", "left_semi")
        write_document(vcf(own), f"{folder}/{n}")
    return names


def vcf_strata(g: DataFrame, fields: list[str]) -> DataFrame:
    """A VCF whose samples carry further fields (columns of ``g``) after the genotype."""
    return vcf(g, tuple(fields))
