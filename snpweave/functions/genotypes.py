"""Genotype encodings as column expressions.

GT_BIN counts the alternate allele (0, 1, 2, null); GT_VCF is ``0/1`` with ``./.``; GT_VCF_NUC is ``A/C`` with
``./.``; GT is two three-digit codes with ``000000``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: allele codes of the six-digit encoding
NUCLEOTIDE_CODES = {"A": "001", "C": "002", "G": "003", "T": "004"}
MISSING_VCF, MISSING_GT = "./.", "000000"


def gt_bin_from_depth(ref: Column, alt: Column) -> Column:
    """Both read counts above zero: heterozygote; no reads: missing."""
    return F.when((ref > 0) & (alt == 0), 0).when((ref > 0) & (alt > 0), 1).when((ref == 0) & (alt > 0), 2)


def gt_bin_from_presence(ref: Column, alt: Column) -> Column:
    return F.when((ref == 1) & (alt == 0), 0).when((ref == 1) & (alt == 1), 1).when((ref == 0) & (alt == 1), 2)


def vcf_from_bin(gt: Column) -> Column:
    return F.when(gt == 0, "0/0").when(gt == 1, "0/1").when(gt == 2, "1/1").otherwise(MISSING_VCF)


def bin_from_vcf(gt: Column) -> Column:
    return F.when(gt.isin("0/0", "0|0"), 0).when(gt.isin("0/1", "1/0", "0|1", "1|0"), 1).when(gt.isin("1/1", "1|1"), 2)


def nuc_from_bin(gt: Column, ref: Column, alt: Column) -> Column:
    pair = lambda a, b: F.concat(a, F.lit("/"), b)
    return F.when(gt == 0, pair(ref, ref)).when(gt == 1, pair(ref, alt)).when(gt == 2, pair(alt, alt)).otherwise(MISSING_VCF)


def bin_from_nuc(gt: Column, ref: Column, alt: Column) -> Column:
    a, b = F.split_part(gt, F.lit("/"), F.lit(1)), F.split_part(gt, F.lit("/"), F.lit(2))
    n = (a == alt).cast("int") + (b == alt).cast("int")
    known = a.isin(".", "") | b.isin(".", "")
    return F.when(~known & ((a == ref) | (a == alt)) & ((b == ref) | (b == alt)), n)


def nuc_from_call(call: Column, alleles: Column) -> Column:
    """The bases of a call such as ``0/2`` (or ``0|2``, kept phased) out of the array of a site's alleles; ``./.`` where one is missing."""
    sep = F.when(F.contains(call, F.lit("|")), "|").otherwise("/")
    side = lambda k: F.get(alleles, F.split_part(F.translate(call, "|", "/"), F.lit("/"), F.lit(k)).try_cast("int"))
    return F.coalesce(F.concat(side(1), sep, side(2)), F.lit(MISSING_VCF))


def code(allele: Column) -> Column:
    """The three-digit code of a nucleotide; 000 for others."""
    out = F.lit("000")
    for k, v in NUCLEOTIDE_CODES.items():
        out = F.when(F.upper(allele) == k, v).otherwise(out)
    return out


def gt_from_bin(gt: Column, ref: Column, alt: Column) -> Column:
    r, a = code(ref), code(alt)
    return F.when(gt == 0, F.concat(r, r)).when(gt == 1, F.concat(r, a)).when(gt == 2, F.concat(a, a)).otherwise(MISSING_GT)


def gt_from_nuc(gt: Column) -> Column:
    part = lambda k: code(F.split_part(gt, F.lit("/"), F.lit(k)))
    return F.when(gt == MISSING_VCF, MISSING_GT).otherwise(F.concat(part(1), part(2)))


def bin_from_gt(gt: Column, ref_code: Column, alt_code: Column) -> Column:
    a, b = F.substring(gt, 1, 3), F.substring(gt, 4, 3)
    return F.when((gt != MISSING_GT) & a.isin("000").eqNullSafe(F.lit(False)), (a == alt_code).cast("int") + (b == alt_code).cast("int"))


def allele_bits(gt: Column) -> tuple[Column, Column]:
    """0 -> (0, 0), 1 -> (0, 1), 2 -> (1, 1)."""
    return F.when(gt.isNotNull(), (gt == 2).cast("int")), F.when(gt.isNotNull(), (gt >= 1).cast("int"))


def swapped(gt: Column) -> Column:
    return F.lit(2) - gt
