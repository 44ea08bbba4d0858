"""Recoding and reshaping of genotype tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from . import stats
from .order import numbered


def gt_recoding(g: DataFrame, gt_bin: bool = True, gt_vcf: bool = True, gt_vcf_nuc: bool = True, six: bool = True) -> DataFrame:
    """Every wanted encoding, from the first of GT_BIN, GT_VCF, GT_VCF_NUC, GT that is there.

    A table with GT alone takes the more frequent code of a marker as reference (ties: the smaller code).
    """
    have = g.columns
    if "GT_BIN" not in have:
        if "GT_VCF" in have:
            g = g.withColumn("GT_BIN", gt.bin_from_vcf(F.col("GT_VCF")))
        elif "GT_VCF_NUC" in have:
            g = g.withColumn("GT_BIN", gt.bin_from_nuc(F.col("GT_VCF_NUC"), F.col("REF"), F.col("ALT")))
        else:
            g = with_majority_reference(g)
            g = g.withColumn("GT_BIN", gt.bin_from_gt(F.col("GT"), gt.code(F.col("REF")), gt.code(F.col("ALT"))))
    b, r, a = F.col("GT_BIN"), F.col("REF"), F.col("ALT")
    want = {"GT_VCF": (gt_vcf, gt.vcf_from_bin(b)), "GT_VCF_NUC": (gt_vcf_nuc, gt.nuc_from_bin(b, r, a)), "GT": (six, gt.gt_from_bin(b, r, a))}
    for name, (wanted, expr) in want.items():
        if wanted:
            g = g.withColumn(name, expr)
    return g if gt_bin else g.drop("GT_BIN")


def with_majority_reference(g: DataFrame) -> DataFrame:
    """REF and ALT nucleotides from six-digit genotypes: the most and the next frequent code of a marker."""
    a = g.filter(F.col("GT") != gt.MISSING_GT).select("MARKERS", F.explode(F.array(F.substring("GT", 1, 3), F.substring("GT", 4, 3))).alias("c")).filter("c <> '000'").groupBy("MARKERS", "c").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("MARKERS").orderBy(F.desc("n"), "c")
    a = a.withColumn("i", F.row_number().over(order)).filter("i <= 2")
    nuc = F.lit(None).cast("string")
    for k, v in gt.NUCLEOTIDE_CODES.items():
        nuc = F.when(F.col("c") == v, k).otherwise(nuc)
    top = a.groupBy("MARKERS").agg(F.max(F.when(F.col("i") == 1, nuc)).alias("REF"), F.max(F.when(F.col("i") == 2, nuc)).alias("ALT"))
    return g.drop("REF", "ALT").join(top, "MARKERS", "left")


def calibrate_alleles(g: DataFrame) -> DataFrame:
    """REF is the more frequent allele: markers whose alternate is more frequent are swapped, depths too."""
    flag = stats.genotype_counts(g, "MARKERS").select("MARKERS", (F.col("N2") > F.col("N0")).alias("__swap"))
    j = g.join(flag, "MARKERS", "left")
    turned: dict[str, Column] = {"GT_BIN": gt.swapped(F.col("GT_BIN")), "REF": F.col("ALT"), "ALT": F.col("REF"), "ALLELE_REF_DEPTH": F.col("ALLELE_ALT_DEPTH"), "ALLELE_ALT_DEPTH": F.col("ALLELE_REF_DEPTH"), "REF_COUNT": F.col("ALT_COUNT"), "ALT_COUNT": F.col("REF_COUNT")}
    return j.select(*[F.when(F.col("__swap"), turned[c]).otherwise(F.col(c)).alias(c) if c in turned else F.col(c) for c in g.columns])


def separate_gt(g: DataFrame, column: str = "GT_VCF_NUC", long: bool = True) -> DataFrame:
    """The two alleles of a genotype as A1 and A2, or long as (ALLELES_GROUP, ALLELES)."""
    c = F.col(column)
    if column == "GT_BIN":
        a1, a2 = F.when(c.isNotNull(), F.when(c == 2, 2).otherwise(1)).cast("string"), F.when(c.isNotNull(), F.when(c == 0, 1).otherwise(2)).cast("string")
    elif column == "GT":
        a1, a2 = F.substring(c, 1, 3), F.substring(c, 4, 3)
    else:
        a1, a2 = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    keys = [k for k in ("MARKERS", "INDIVIDUALS", "STRATA") if k in g.columns]
    w = g.select(*keys, a1.alias("A1"), a2.alias("A2"))
    return w.unpivot(keys, ["A1", "A2"], "ALLELES_GROUP", "ALLELES") if long else w


def separate_markers(g: DataFrame, sep: str = "__") -> DataFrame:
    """CHROM, LOCUS and POS out of MARKERS."""
    part = lambda k: F.split_part("MARKERS", F.lit(sep), F.lit(k))
    return g.select("MARKERS", part(1).alias("CHROM"), part(2).alias("LOCUS"), part(3).alias("POS")).distinct()


def generate_markers_metadata(g: DataFrame) -> DataFrame:
    """VARIANT_ID by sorted name and placeholders for what is absent."""
    m = numbered(g.select("MARKERS").distinct(), "VARIANT_ID", "MARKERS")
    return m.select("MARKERS", "VARIANT_ID", F.lit("CHROM_1").alias("CHROM"), F.col("VARIANT_ID").cast("string").alias("LOCUS"), F.col("MARKERS").alias("POS"), F.lit("A").alias("REF"), F.lit("C").alias("ALT"))


def haplotype_reconstruction(h: DataFrame) -> DataFrame:
    """Haplotypes (MARKERS, INDIVIDUALS, HAPLOTYPES) without the positions that do not vary in the marker."""
    c = h.select("MARKERS", "INDIVIDUALS", "HAPLOTYPES", F.posexplode(F.split("HAPLOTYPES", "")).alias("p", "base"))
    vary = c.groupBy("MARKERS", "p").agg(F.count_distinct("base").alias("n")).filter("n > 1").select("MARKERS", "p")
    own = c.join(vary, ["MARKERS", "p"]).groupBy("MARKERS", "INDIVIDUALS", "HAPLOTYPES").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("p", "base"))), lambda x: x["base"]), "").alias("HAPLOTYPES_NEW"))
    return own.select("MARKERS", "INDIVIDUALS", "HAPLOTYPES", "HAPLOTYPES_NEW")


def rad_long(w: DataFrame, ids: list[str], values: list[str] | None = None, name: str = "MARKERS", value: str = "GT") -> DataFrame:
    return w.unpivot(ids, values, name, value)


def rad_wide(g: DataFrame, rows: list[str], names: str, values: str, columns: list, fill=None) -> DataFrame:
    """Cast with an explicit list of columns, so no extra pass finds them."""
    w = g.groupBy(*rows).pivot(names, columns).agg(F.first(values))
    return w if fill is None else w.fillna(fill, subset=[str(c) for c in columns])


def tidy_wide(w: DataFrame, value: str = "GT") -> DataFrame:
    """A wide table (POP_ID or STRATA, INDIVIDUALS, a column for each marker) as a long one."""
    if "POP_ID" in w.columns:
        w = w.withColumnRenamed("POP_ID", "STRATA")
    if "MARKERS" in w.columns or "LOCUS" in w.columns:
        return w if "MARKERS" in w.columns else w.withColumnRenamed("LOCUS", "MARKERS")
    return w.unpivot(["STRATA", "INDIVIDUALS"], None, "MARKERS", value)


def full_grid(g: DataFrame) -> DataFrame:
    """Every sample with every marker; absent cells are missing.  The result is the grid itself."""
    i, m = g.select("INDIVIDUALS").distinct(), g.select("MARKERS").distinct()
    return i.crossJoin(m).join(g.select("INDIVIDUALS", "MARKERS", "GT_BIN"), ["INDIVIDUALS", "MARKERS"], "left")


def strip_rad(g: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fact, strata and markers with surrogate numbers by sorted name."""
    s = g.select("INDIVIDUALS", "STRATA").distinct()
    s = s.withColumn("ID_SEQ", F.row_number().over(Window.orderBy("INDIVIDUALS"))).withColumn("STRATA_SEQ", F.dense_rank().over(Window.orderBy("STRATA")))
    cols = [c for c in ("MARKERS", "CHROM", "LOCUS", "POS", "COL", "REF", "ALT") if c in g.columns]
    m = numbered(g.select(*cols).distinct(), "M_SEQ", "MARKERS")
    rest = [c for c in g.columns if c not in cols and c not in ("INDIVIDUALS", "STRATA")]
    fact = g.join(s.select("INDIVIDUALS", "ID_SEQ", "STRATA_SEQ"), "INDIVIDUALS").join(m.select("MARKERS", "M_SEQ"), "MARKERS").select("ID_SEQ", "STRATA_SEQ", "M_SEQ", *rest)
    return fact, s, m


def join_rad(fact: DataFrame, s: DataFrame, m: DataFrame) -> DataFrame:
    return fact.join(m, "M_SEQ").join(s.drop("STRATA_SEQ"), "ID_SEQ").drop("M_SEQ", "ID_SEQ", "STRATA_SEQ")


def to_arrays(g: DataFrame) -> DataFrame:
    """One row for each marker with its samples' allele bits, ordered by sample; missing is 15."""
    a1, a2 = gt.allele_bits(F.col("GT_BIN"))
    miss = lambda c: F.coalesce(c, F.lit(15))
    x = F.array_sort(F.collect_list(F.struct("INDIVIDUALS", miss(a1).alias("A1"), miss(a2).alias("A2"))))
    return g.groupBy("MARKERS").agg(x.alias("CALLS"))


def from_arrays(a: DataFrame) -> DataFrame:
    """The long table of ``to_arrays``."""
    x = a.select("MARKERS", F.explode("CALLS").alias("x"))
    return x.select("MARKERS", F.col("x.INDIVIDUALS").alias("INDIVIDUALS"), F.when(F.col("x.A1") < 15, F.col("x.A1") + F.col("x.A2")).alias("GT_BIN"))


def parse_depths(v: DataFrame) -> DataFrame:
    """AD (array) as reference depth (first) and alternate depth (sum of the rest); zero is missing."""
    rest = F.aggregate(F.slice("AD", 2, F.greatest(F.size("AD") - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    rest = F.when(F.size("AD") <= 2, F.coalesce(F.get("AD", F.lit(1)), F.lit(0)).cast("long")).otherwise(rest)  # nearly all calls
    return v.withColumn("ALLELE_REF_DEPTH", F.nullif(F.get("AD", F.lit(0)).cast("long"), F.lit(0).cast("long"))).withColumn("ALLELE_ALT_DEPTH", F.nullif(rest, F.lit(0).cast("long")))


def subsample(strata: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 1) -> DataFrame:
    """``n`` samples, or a fraction, of each stratum in a seeded hash order."""
    w = Window.partitionBy("STRATA")
    i = F.row_number().over(w.orderBy(F.md5(F.concat("INDIVIDUALS", F.lit(f":{seed}"))), "INDIVIDUALS"))
    s = strata.withColumn("__i", i).withColumn("__n", F.count(F.lit(1)).over(w))
    keep = F.col("__i") <= n if n is not None else F.col("__i") <= F.ceil(F.col("__n") * fraction)
    return s.filter(keep).drop("__i", "__n")


def allele_depths(x: DataFrame) -> DataFrame:
    """ALLELE_REF_DEPTH and ALLELE_ALT_DEPTH from AD, else from the depths of the alleles' letters, else missing.

    A homozygote with a read depth and no allele depth has the read depth as its own allele's.
    """
    none = F.lit(None).cast("long")
    if "AD" in x.columns:
        x = parse_depths(x).drop("AD")
    elif "C_DEPTH" in x.columns:
        letter = lambda a: F.coalesce(*[F.when(F.col(a) == n, F.nullif(F.col(f"{n}_DEPTH"), F.lit(0).cast("long"))) for n in "CATG"])
        x = x.withColumn("ALLELE_REF_DEPTH", letter("REF")).withColumn("ALLELE_ALT_DEPTH", letter("ALT"))
    else:
        return x.withColumn("ALLELE_REF_DEPTH", none).withColumn("ALLELE_ALT_DEPTH", none)
    bare = F.col("ALLELE_REF_DEPTH").isNull() & F.col("ALLELE_ALT_DEPTH").isNull()
    own = lambda dose, c: F.when(bare & (F.col("GT_BIN") == dose), F.col("READ_DEPTH")).otherwise(F.col(c)).alias(c)
    return x.select(*[c for c in x.columns if c not in ("ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH")], own(0, "ALLELE_REF_DEPTH"), own(2, "ALLELE_ALT_DEPTH"))


def split_haplotypes(g: DataFrame) -> DataFrame:
    """Markers whose alleles are words of one length as a marker for each place that varies; others stay.

    ``g`` has MARKERS, POS, REF, ALT (comma between alleles), INDIVIDUALS and GT_VCF_NUC; the new markers end in ``_1``,
    ``_2`` .. (the place in the word), POS moves with it, and GT_BIN is there where two bases are.
    """
    alleles = F.concat(F.array("REF"), F.split("ALT", ","))
    words = (F.length("REF") > 1) & F.forall(alleles, lambda a: F.length(a) == F.length("REF"))
    x = g.withColumn("__alleles", alleles).filter(words).withColumn("__p", F.explode(F.sequence(F.lit(1), F.length("REF"))))
    at = lambda a: F.substring(a, F.col("__p"), F.lit(1))
    x = x.withColumn("__b", F.array_distinct(F.transform("__alleles", at))).filter(F.size("__b") > 1)
    sep = F.when(F.contains("GT_VCF_NUC", F.lit("|")), "|").otherwise("/")
    called = F.translate("GT_VCF_NUC", "|", "/")
    two = F.when(F.col("GT_VCF_NUC") == gt.MISSING_VCF, gt.MISSING_VCF).otherwise(F.concat(at(F.split_part(called, F.lit("/"), F.lit(1))), sep, at(F.split_part(called, F.lit("/"), F.lit(2)))))
    ref, alt = F.get("__b", F.lit(0)), F.array_join(F.slice("__b", 2, F.size("__b") - 1), ",")
    new = {"MARKERS": F.concat_ws("_", "MARKERS", F.col("__p").cast("string")), "POS": (F.col("POS").cast("long") + F.col("__p") - 1).cast("string"), "REF": ref, "ALT": alt, "GT_VCF_NUC": two}
    x = x.select(*[new[c].alias(c) if c in new else F.col(c) for c in g.columns])
    if "GT_BIN" in g.columns:
        dose = F.when(F.length("ALT") == 1, gt.bin_from_nuc(F.translate("GT_VCF_NUC", "|", "/"), F.col("REF"), F.col("ALT")))
        x = x.withColumn("GT_BIN", dose)
    return g.filter(~words).unionByName(x)


def tidy_genind(w: DataFrame, sep: str = ".") -> DataFrame:
    """A table of allele counts (INDIVIDUALS, STRATA, a column ``marker.allele`` for each allele) as a long table.

    Where no marker has more than two alleles, the rarer allele (ties: the smaller name) is the alternate and its count
    GT_BIN; else GT has two codes: the allele twice for a count of 2, ``000000`` for missing.  Names of alleles that are
    not numbers are numbered by name over the whole table.
    """
    x = w.unpivot(["INDIVIDUALS", "STRATA"], None, "c", "COUNT")
    cut = F.regexp_extract("c", r"^([^.]+)\.(.*)$", 1) if sep == "." else F.split_part("c", F.lit(sep), F.lit(1))
    name = F.regexp_extract("c", r"^([^.]+)\.(.*)$", 2) if sep == "." else F.split_part("c", F.lit(sep), F.lit(2))
    x = x.select("INDIVIDUALS", "STRATA", cut.alias("MARKERS"), F.regexp_replace(name, "^A[12]__", "").alias("ALLELES"), F.col("COUNT").cast("int").alias("COUNT"))
    seen = x.groupBy("MARKERS", "ALLELES").agg(F.coalesce(F.sum("COUNT"), F.lit(0)).alias("n"))
    most = seen.groupBy("MARKERS").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    if most <= 2:
        order = F.array_sort(F.collect_list(F.struct("n", "ALLELES")))
        two = seen.groupBy("MARKERS").agg(order.alias("o")).select("MARKERS", F.get("o", F.lit(0))["ALLELES"].alias("ALT"), F.get("o", F.lit(1))["ALLELES"].alias("REF"))
        return x.join(two, "MARKERS").filter("ALLELES = ALT").select("MARKERS", "INDIVIDUALS", "STRATA", "REF", "ALT", F.col("COUNT").alias("GT_BIN"))
    names = seen.select("ALLELES").distinct()  # as many as a table has alleles by name
    plain = names.filter(~F.col("ALLELES").rlike("[0-9]")).limit(1).count() > 0
    code = names.withColumn("code", F.lpad((F.dense_rank().over(Window.orderBy("ALLELES")) if plain else F.col("ALLELES")).cast("string"), 3, "0"))
    x = x.join(F.broadcast(code), "ALLELES").filter("COUNT is null or COUNT > 0")
    own = F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col("code"), F.col("COUNT")))))
    miss = F.max(F.col("COUNT").isNull())
    y = x.groupBy("MARKERS", "INDIVIDUALS", "STRATA").agg(own.alias("a"), miss.alias("m"))
    return y.select("MARKERS", "INDIVIDUALS", "STRATA", F.when(F.col("m") | (F.size("a") != 2), gt.MISSING_GT).otherwise(F.concat(F.get("a", F.lit(0)), F.get("a", F.lit(1)))).alias("GT"))


def tidy_genlight(w: DataFrame, alleles: DataFrame | None = None) -> DataFrame:
    """A table of dosages (INDIVIDUALS, STRATA, a column for each marker) as a long one; ``alleles`` has (MARKERS, REF, ALT), else A and C stand in."""
    x = w.unpivot(["INDIVIDUALS", "STRATA"], None, "MARKERS", "GT_BIN").withColumn("GT_BIN", F.col("GT_BIN").cast("int"))
    return x.join(alleles, "MARKERS", "left") if alleles is not None else x.withColumn("REF", F.lit("A")).withColumn("ALT", F.lit("C"))


def detect_gt(df: DataFrame, keep_one: bool = True, favourite: str = "GT_BIN") -> list[str]:
    """The genotype encodings that a table has; with ``keep_one`` the favourite, or the first there is."""
    have = [c for c in df.columns if c in ("GT", "GT_BIN", "GT_VCF", "GT_VCF_NUC")]
    return have if not keep_one or len(have) < 2 else [favourite if favourite in have else have[0]]


def check_coverage(g: DataFrame, source: str = "") -> list[str]:
    """The depth columns that hold a value; none for presence data (DArT in one or two rows)."""
    have = [c for c in ("READ_DEPTH", "ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH", "C_DEPTH", "A_DEPTH", "T_DEPTH", "G_DEPTH") if c in g.columns]
    if source in ("1row", "2rows") or not have:
        return []
    row = g.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in have]).first()
    return [c for c in have if row[c]]
