"""Genotype files as long tables, parsed by Spark from text lines.

Files are read through Spark, so a path may be a folder, in any store Spark reads, or compressed (``.gz``).  A VCF compressed in
blocks is read by ranges (``bgzf``), and with an index (``index_vcf``) by regions.  Only headers (the lines before the data, or
one line) and lists of samples come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from ..functions import names
from ..operators import dart, metadata, recode
from ..operators.order import numbered
from . import bgzf

#: fixed values: what a VCF header says about its caller
CALLERS = {"stacks": "stacks", "freebayes": "freebayes", "bcftools": "bcftools", "gatk": "gatk", "haplotypecaller": "gatk", "deepvariant": "deepvariant", "dragen": "dragen", "glnexus": "glnexus", "vcftools": "vcftools", "samtools": "samtools", "ipyrad": "ipyrad"}
#: fixed values: the genotype fields that each caller's files are read for
FORMATS = {"stacks": ("GT", "DP", "AD", "GL", "GQ"), "freebayes": ("GT", "DP", "AD", "GQ", "GL"), "freebayes_dirty": ("GT", "DP"), "bcftools": ("GT", "AD", "DP", "PL", "GQ"), "gatk": ("GT", "AD", "DP", "GQ", "PL"),
           "deepvariant": ("GT", "DP", "GQ", "AD"), "samtools": ("GT", "DP", "GQ"), "glnexus": ("GT", "DP", "GQ", "AD"), "dragen": ("GT", "DP", "GQ", "AD")}
#: what other files are read for, where they declare it
ANY_FORMAT = ("GT", "DP", "AD", "GL", "PL", "GP", "GQ", "HQ", "CATG", "GOF", "NR", "NV")
#: fixed values: genotype fields whose Number headers state wrongly, and how many values they have: one for each alternate
#: allele (A), allele (R) or genotype (G), or so many
REPAIRED = {"AD": "R", "AO": "A", "QA": "A", "GL": "G", "CATG": "4", "RO": "1", "QR": "1", "MIN_DP": "1", "PL": "G", "DPR": "R"}


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row[0] if row else ""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def detect_genomic_format(path: str) -> str:
    """The format of a file by its extension (a ``.gz`` left out) and first line."""
    spark = SparkSession.active()
    low = path.lower().rstrip("/").removesuffix(".gz")
    for end, kind in ((".tped", "plink.tped"), (".tfam", "plink.tped"), (".bed", "plink.bed"), (".gen", "genepop"), (".dat", "fstat"), (".parquet", "parquet"), (".rad", "parquet")):
        if low.endswith(end):
            base = path[: low.rindex(end)]
            for other in {"plink.tped": (".tfam",), "plink.bed": (".bim", ".fam")}.get(kind, ()):
                if not exists(spark, base + other):
                    raise FileNotFoundError(base + other)
            return kind
    first = _first_line(spark, path)
    if first.startswith("##fileformat=VCF"):
        return "vcf"
    if "Catalog" in first:
        return "haplotypes"
    if first.startswith("*") or "AlleleID" in first or "CloneID" in first:
        return "dart"
    if any(x in first for x in ("POP_ID", "INDIVIDUALS", "MARKERS", "LOCUS")):
        return "tidy"
    raise ValueError("format not recognised")


def detect_dart_format(lines: list[str]) -> tuple[str, int]:
    """(1row, 2rows, counts or silico.dart, number of star lines) of the first lines of a file."""
    stars = sum(x.startswith("*") for x in lines)
    rows = [x.rstrip("\n").replace("\t", ",").split(",") for x in lines[stars:]]
    head, body = rows[0], rows[1:]
    if "AlleleID" not in head and "CloneID" in head:
        return "silico.dart", stars
    key = head.index("AlleleID") if "AlleleID" in head else 0
    ids = [r[key].split("|")[0] for r in body]
    two = any(a == b for a, b in zip(ids, ids[1:], strict=False)) or (len(body) > 1 and "SNP" in head and body[1][head.index("SNP")] in ("", "NA"))
    if not two:
        return "1row", stars
    called = [i for i, n in enumerate(head) if n not in ("AlleleID", "CloneID", "SNP", "SnpPosition")][-4:]
    last = [r[i] for r in body for i in called if i < len(r) and r[i].isdigit()]
    return ("counts" if any(int(c) > 1 for c in last) else "2rows"), stars


def text_lines(spark: SparkSession, path: str, fields: int | None = None) -> DataFrame:
    """The lines (``value``) of text files; those in compressed blocks by ranges of bytes, and of these the first ``fields`` fields only, if given."""
    blocked = bgzf.lines(spark, path, fields=fields)
    return spark.read.text(path) if blocked is None else blocked


def vcf_formats(lines: list[str]) -> dict[str, dict[str, str]]:
    """Number and Type of the genotype fields that header lines declare, repaired, and what was declared.

    Fields of ``REPAIRED`` have the number that the format defines; a GT of integers is one of strings.
    """
    out = {}
    for x in lines:
        if x.startswith("##FORMAT=<") and "ID=" in x:
            said = dict(p.split("=", 1) for p in x[10:].split(",Description")[0].rstrip(">").split(",") if "=" in p)
            name, number, kind = said["ID"], said.get("Number", "."), said.get("Type", "String")
            out[name] = {"Number": REPAIRED.get(name, number), "Type": "String" if name == "GT" else kind, "declared_number": number, "declared_type": kind}
    return out


def vcf_header(spark: SparkSession, path: str) -> dict:
    """Caller, reference, samples, declared and wanted genotype fields, repaired: from the header lines alone."""
    blocked = bgzf.blocked_files(spark, path)
    if blocked:  # header lines alone, off the first blocks
        lines = bgzf.head(blocked[0])
    else:
        text, n = spark.read.text(path), 1000
        lines = [r[0] for r in text.take(n)]
        while len(lines) == n and lines[-1].startswith("#"):  # the first split holds the header of one file
            n *= 10
            lines = [r[0] for r in text.take(n)]
        lines = [x for x in lines if x.startswith("#")]
    if not any(x.startswith("#CHROM") for x in lines):  # parts in a folder come in any order
        lines = [r[0] for r in text_lines(spark, path).filter("value like '#%'").collect()]
    low = "\n".join(lines).lower()
    caller = next((v for k, v in CALLERS.items() if f"source={k}" in low or f"##source=\"{k}" in low), next((v for k, v in CALLERS.items() if k in low), "unknown"))
    if caller == "freebayes" and "dirty" in next((x for x in lines if x.lower().startswith("##source")), "").lower():
        caller = "freebayes_dirty"
    cols = next(x for x in lines if x.startswith("#CHROM")).split("\t")
    ref = next((x.split("=", 1)[1] for x in lines if x.startswith("##reference=")), None)
    declared = [x.split("ID=", 1)[1].split(",", 1)[0].rstrip(">") for x in lines if x.startswith("##FORMAT") and "ID=" in x]
    wanted = [x for x in FORMATS.get(caller, ANY_FORMAT) if x in declared] if declared else [x for x in ANY_FORMAT if x in ("GT", "DP", "AD")]
    return {"source": caller, "samples": cols[9:], "reference": ref, "contigs": sum(x.startswith("##contig") for x in lines), "formats": [x for x in lines if x.startswith("##FORMAT")], "declared": declared, "wanted": wanted, "fields": vcf_formats(lines)}


def vcf_info(spark: SparkSession, path: str) -> dict:
    """Caller, numbers of samples and variants, and the samples."""
    head = vcf_header(spark, path)
    n = text_lines(spark, path).filter("value not like '#%' and value <> ''").count()
    return {"source": head["source"], "n_samples": len(head["samples"]), "n_variants": n, "samples": head["samples"]}


def extract_ref_genome(spark: SparkSession, path: str) -> str | None:
    """The reference genome's file that a VCF names; None for others."""
    return vcf_header(spark, path)["reference"] if detect_genomic_format(path) == "vcf" else None


def index_vcf(spark: SparkSession, path: str, index: str | None = None) -> str:
    """Index a block-compressed VCF by chromosome and place; beside it (``<path>.regions``) where no other place is given."""
    index = index or f"{path.rstrip('/')}.regions"
    bgzf.write_index(spark, path, index)
    return index


def detect_indexing(spark: SparkSession, path: str, index: str | None = None) -> bool:
    return bgzf.has_index(spark, index or f"{path.rstrip('/')}.regions")


def _region(region: str) -> tuple[str, int | None, int | None]:
    """``2``, ``2:1000`` (from there on) or ``2:1000-2000`` (both ends included)."""
    chrom, _, places = region.rpartition(":") if ":" in region else (region, "", "")
    first, _, last = places.replace(",", "").partition("-")
    return chrom, int(first) if first else None, int(last) if last else None


def vcf_lines(spark: SparkSession, path: str, region: str | None = None, index: str | None = None, fields: int | None = None) -> DataFrame:
    """The site lines of a VCF (``value``), of a region only if one is given; with an index no other blocks are read."""
    if region is None:
        return text_lines(spark, path, fields).filter("value not like '#%' and value <> ''")
    chrom, first, last = _region(region)
    if detect_indexing(spark, path, index):
        return bgzf.region_lines(spark, path, index or f"{path.rstrip('/')}.regions", chrom=chrom, first=first, last=last).select("value")
    f = F.split("value", "\t", 3)
    place = F.get(f, F.lit(1)).try_cast("long")
    keep = F.get(f, F.lit(0)) == chrom
    keep = keep & (place >= first) if first is not None else keep
    keep = keep & (place <= last) if last is not None else keep
    return text_lines(spark, path).filter("value not like '#%' and value <> ''").filter(keep)


def read_vcf_raw(spark: SparkSession, path: str, region: str | None = None, index: str | None = None, sites: bool = False) -> DataFrame:
    """Site columns, FORMAT, and the rest of the line with the samples' fields, which is split only where it is used (``sites``: and not wanted)."""
    f = F.split("value", "\t", 10)
    at = lambda i: F.get(f, F.lit(i))
    v = vcf_lines(spark, path, region, index, 9 if sites else None)
    info = F.str_to_map(at(7), F.lit(";"), F.lit("="))
    return v.select(at(0).alias("CHROM"), at(1).alias("POS"), at(2).alias("LOCUS"), at(3).alias("REF"), at(4).alias("ALT"), at(5).alias("QUAL"), at(6).alias("FILTER"), info.alias("INFO"), at(8).alias("FORMAT"), at(9).alias("calls"))


_INT = lambda c: c.try_cast("long")
_LISTS = ("AD", "GL", "PL", "GP", "CATG")


def _positions(wanted: list[str]) -> list[Column]:
    """Where a site's FORMAT has each wanted field (from 0, null where it has not): found once for a site, not for a call."""
    keys = F.split("FORMAT", ":")
    return [F.nullif(F.array_position(keys, k).cast("int"), F.lit(0)).alias(f"__at_{k}") for k in wanted]


def _values(wanted: list[str]) -> list[Column]:
    """The wanted fields of a call: text, or arrays of text for those with several values."""
    of = {k: F.get("__field", F.col(f"__at_{k}") - 1) for k in wanted if k != "GT"}
    return [(F.split(c, ",") if k in _LISTS else c).alias(f"__{k}") for k, c in of.items()]


def _vcf_fields(wanted: list[str], fields: dict[str, dict[str, str]], split: bool) -> dict[str, Column]:
    """Columns of a call's further fields; ``__AD`` and so on, ``__alleles`` and ``__a`` (the row's alternate allele, from 0) are the row's.

    Likelihoods have a value for each genotype j <= k, at k(k+1)/2 + j: a row of alternate allele k has those of 0/0, 0/k and k/k
    (of a haploid call, with a value for each allele, those of 0 and k).  Of fields with a value for each alternate allele, it has
    its own; of fields with one for each allele, the reference's and its own.
    """
    real = lambda c: c.try_cast("double")
    own = (F.col("__a") + 1).cast("int")
    out = {"READ_DEPTH": _INT(F.col("__DP")) if "DP" in wanted else F.lit(None).cast("long")}
    if "AD" in wanted:
        depths = F.col("__AD").try_cast("array<bigint>")
        out["AD"] = F.when(depths.isNotNull(), F.array(F.get(depths, F.lit(0)), F.get(depths, own))) if split else depths
    for name in ("GL", "PL", "GP"):
        if name in wanted:
            values = F.col(f"__{name}")
            haploid = F.size(values) == F.size("__alleles")
            het = (own * (own + 1) / 2).cast("int")
            out |= {f"{name}_HOM_REF": real(F.get(values, F.lit(0))), f"{name}_HET": real(F.when(~haploid, F.get(values, het))), f"{name}_HOM_ALT": real(F.get(values, F.when(haploid, own).otherwise(het + own)))}
    if "CATG" in wanted:
        out |= {f"{n}_DEPTH": _INT(F.get("__CATG", F.lit(i))) for i, n in enumerate("CATG")}
    for name in ("GQ", "GOF", "NR", "NV"):
        if name in wanted:
            whole = F.col(f"__{name}")
            values = F.split(whole, ",")
            each = (fields.get(name, {}).get("Number") == "A") or (name in ("NR", "NV") and fields.get(name, {}).get("Number") == ".")
            out[name] = real(F.when(F.size(values) == F.size("__alleles") - 1, F.get(values, own - 1)).otherwise(whole)) if each else real(whole)
    return out | ({"HQ": F.col("__HQ")} if "HQ" in wanted else {})


def read_vcf(spark: SparkSession, path: str, strata: DataFrame | None = None, multiallelic: str = "keep", region: str | None = None, index: str | None = None) -> DataFrame:
    """Long genotypes; samples cleaned, strata joined (samples without one go), markers named.

    The header says which fields exist and which its caller's files are read for: READ_DEPTH and allele depths (from AD, or
    from CATG by the alleles' letters; a homozygote without allele depths has its read depth as its allele's), GL_*, PL_*, GP_*
    (HOM_REF, HET, HOM_ALT), GQ, HQ, GOF, NR, NV where they are.  ``region`` (``2:1000-2000``) reads only its sites; with an index
    (``index_vcf``) only its blocks.  ``GT_VCF_NUC`` holds the called bases of any number of alleles.  Sites with several
    alternate alleles: ``keep`` has one row and no GT_BIN for calls with an allele beyond the first; ``split`` has a row for
    each alternate allele (markers get ``_1``, ``_2`` ..), whose GT_BIN counts its copies and whose depths and likelihoods are
    its own; ``drop`` leaves them out.
    """
    if multiallelic not in ("keep", "split", "drop"):
        raise ValueError(f"no such rule: {multiallelic}")
    head = vcf_header(spark, path)

    def named(sites: bool) -> DataFrame:
        # increasing in the file's order; no sort and no shuffle of the calls
        x = read_vcf_raw(spark, path, region, index, sites).withColumn("VARIANT_ID", F.monotonically_increasing_id())
        if multiallelic == "drop":
            x = x.filter(~F.contains("ALT", F.lit(",")))
        return metadata.name_vcf_markers(x, head["source"], reference=head["reference"] is not None or head["contigs"] > 0 or head["source"] == "unknown")

    m, again = named(False), metadata.repeats(named(True))
    if again.limit(1).count():  # rare: only then do the calls meet a join
        m = metadata.suffixed(m, again)
    alleles = F.split("ALT", ",")
    if multiallelic == "split":
        m = m.select("*", F.posexplode(alleles).alias("__a", "__alt"))
        m = m.withColumn("MARKERS", F.when(F.contains("ALT", F.lit(",")), F.concat_ws("_", "MARKERS", (F.col("__a") + 1).cast("string"))).otherwise(F.col("MARKERS")))
    else:
        m = m.withColumn("__a", F.lit(0)).withColumn("__alt", F.col("ALT"))
    keys = ["MARKERS", "CHROM", "LOCUS", "POS", "REF", "FILTER"]
    ids = F.array(*[F.lit(names.clean_ind(s)) for s in head["samples"]])
    wanted = [k for k in head["wanted"] if k != "GT"]
    word = lambda a, b: F.concat(F.col(a), F.lit("/"), F.col(b))
    m = m.withColumn("__alt1", F.get(alleles, F.lit(0)))
    common = [word("REF", "REF").alias("__00"), word("REF", "__alt1").alias("__01"), word("__alt1", "__alt1").alias("__11")]  # the usual calls, written once for a site
    x = m.select(*keys, "__alt", "__a", *common, F.concat(F.array("REF"), alleles).alias("__alleles"), *_positions(wanted), F.posexplode(F.split("calls", "\t")).alias("k", "call"))
    only = bool(head["declared"]) and set(head["declared"]) <= {"GT"}
    if not only:
        x = x.withColumn("__field", F.split("call", ":"))
        x = x.select(*[c for c in x.columns if not c.startswith("__at_") and c != "__field"], F.get("__field", F.lit(0)).alias("__gt"), *_values(wanted))
    call = F.col("call") if only else F.col("__gt")
    if multiallelic == "split":
        one = F.split(F.translate(call, "|", "/"), "/")
        number = (F.col("__a") + 1).cast("string")
        bin_ = F.when((F.size(one) == 2) & ~F.array_contains(one, "."), F.size(F.filter(one, lambda c: c == number)))
    else:
        bin_ = gt.bin_from_vcf(call)
    x = x.select(*keys, F.col("__alt").alias("ALT"), F.get(ids, F.col("k")).alias("INDIVIDUALS"), bin_.alias("GT_BIN"), F.when(call == "0/0", F.col("__00")).when(call == "./.", gt.MISSING_VCF).when(call == "0/1", F.col("__01")).when(call == "1/1", F.col("__11")).otherwise(gt.nuc_from_call(call, F.col("__alleles"))).alias("GT_VCF_NUC"), *[c.alias(n) for n, c in _vcf_fields(wanted, head["fields"], multiallelic == "split").items()])
    x = recode.allele_depths(x)
    if strata is not None:
        return x.join(strata.select(names.clean_ind_names(F.col("INDIVIDUALS")).alias("INDIVIDUALS"), "STRATA"), "INDIVIDUALS")
    return x.withColumn("STRATA", F.lit("pop"))


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """Long six-digit genotypes of a tped with its tfam; loci that nobody has are dropped."""
    fam = numbered_lines(spark, path[:-5] + ".tfam").filter("line <> ''")
    return tidy_tped(spark.read.text(path), fam.select(F.col("n").alias("KEY"), F.col("line").alias("LINE")))


def tidy_tped(lines: DataFrame, samples: DataFrame) -> DataFrame:
    """The same from lines (``value``) and the lines of the samples' file (``LINE``), which by ``KEY`` are in the order of the calls.

    A line's calls leave it one by one, each with its place, and meet the samples by place: no row holds a whole line beside a call, and
    no names come to the driver.
    """
    f = F.split(F.trim("LINE"), r"\s+")
    who = numbered(samples, "k", "KEY").select((F.col("k") - 1).alias("k"), names.clean_ind_names(F.get(f, F.lit(1))).alias("INDIVIDUALS"), F.get(f, F.lit(0)).alias("STRATA"))
    n = who.count()
    f = F.split(F.trim("value"), r"\s+", 5)
    t = lines.filter("value <> ''").select(F.get(f, F.lit(0)).alias("CHROM"), F.get(f, F.lit(1)).alias("LOCUS"), F.get(f, F.lit(3)).alias("POS"), F.get(f, F.lit(4)).alias("rest"))
    t = t.select(F.concat_ws("__", *[names.clean_markers_names(F.col(k)) for k in ("CHROM", "LOCUS", "POS")]).alias("MARKERS"), "CHROM", "LOCUS", "POS", "rest")
    pairs = F.slice(F.regexp_extract_all(F.coalesce("rest", F.lit("")), F.lit(r"\S+(\s+\S+)?"), F.lit(0)), 1, max(n, 1))
    # a call that is not missing has the letter of a base alone between blanks
    some = F.exists(pairs, lambda c: c.rlike(r"(?i)(^|\s)[ACGT](\s|$)"))
    typed = t.groupBy("MARKERS").agg(F.max(some).alias("some")).filter("some").select("MARKERS")
    # a line that ends early has missing calls
    calls = F.concat("v", F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size("v"), F.lit(0))))
    x = t.join(typed, "MARKERS", "left_semi").select("MARKERS", "CHROM", "LOCUS", "POS", pairs.alias("v")).select("MARKERS", "CHROM", "LOCUS", "POS", F.posexplode(calls).alias("k", "v"))
    c = F.split("v", r"\s+")
    x = x.select("MARKERS", "CHROM", "LOCUS", "POS", "k", F.concat(gt.code(F.get(c, F.lit(0))), gt.code(F.get(c, F.lit(1)))).alias("GT"))
    return x.join(who, "k").select("MARKERS", "CHROM", "LOCUS", "POS", "INDIVIDUALS", "STRATA", "GT")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): the lines of one text file, numbered from 0 in its order, without one task for all of them.

    Rows are numbered within their split; the splits' sizes (a number for each) are added up on the driver.
    """
    t = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    split, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in t.groupBy(split.alias("p")).agg(F.count(F.lit(1))).collect())
    before, pairs = 0, [F.lit(-1).cast("long"), F.lit(0).cast("long")]
    for p, n in sizes:
        pairs += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    return t.select((F.element_at(F.create_map(*pairs), split) + at).alias("n"), F.col("value").alias("line"))


#: what a PLINK byte's two bits say: copies of the first allele of the bim (the alternate); 3 is missing
_BED = np.array([[(2, 3, 1, 0)[b >> s & 3] for s in (0, 2, 4, 6)] for b in range(256)], np.int8)
_BED_VARIANTS = 4 << 20


def _bed_rows(path: str, width: int, n_samples: int):
    """Rows (k, end) as (k, doses): the variants' bytes are read in ranges, so no file or split has to fit in memory."""

    def run(batches):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        step = max(1, _BED_VARIANTS // width)
        with store.open_input_file(place) as f:
            for rb in batches:
                for k, end in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                    for lo in range(k, end, step):
                        hi = min(end, lo + step)
                        raw = np.frombuffer(f.read_at((hi - lo) * width, 3 + lo * width), np.uint8).reshape(hi - lo, width)
                        doses = _BED[raw].reshape(hi - lo, -1)[:, :n_samples]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array([x.tobytes() for x in doses], pa.binary())], ["k", "doses"])

    return run


def read_bed(spark: SparkSession, prefix: str) -> DataFrame:
    """Long dosages of a PLINK bed with bim and fam; two bits a genotype, variant by variant, in ranges of variants."""
    fam = [r[0].split() for r in numbered_lines(spark, prefix + ".fam").filter("line <> ''").orderBy("n").select("line").collect()]
    width = -(-len(fam) // 4)
    lines = numbered_lines(spark, prefix + ".bim").filter("line <> ''")
    f = F.split(F.trim("line"), r"\s+")
    bim = lines.select(F.col("n").alias("k"), *[F.get(f, F.lit(i)).alias(n) for i, n in ((0, "CHROM"), (1, "LOCUS"), (3, "POS"), (4, "ALT"), (5, "REF"))])
    n = lines.count()
    step = max(1, min(1 << 16, (64 << 20) // max(1, width)))
    ranges = spark.range(0, n, step, max(1, -(-n // step))).select("id", F.least(F.col("id") + step, F.lit(n)).alias("end"))
    rows = ranges.mapInArrow(_bed_rows(prefix + ".bed", width, len(fam)), "k long, doses binary")
    who = F.array(*[F.struct(F.lit(r[1]).alias("i"), F.lit(r[0]).alias("s")) for r in fam])
    x = rows.join(bim, "k").select("CHROM", "LOCUS", "POS", "REF", "ALT", "doses", F.posexplode(who).alias("n", "who"))
    dose = F.conv(F.hex(F.substring("doses", F.col("n") + 1, F.lit(1))), 16, 10).cast("int")
    return x.select(F.concat_ws("__", *[names.clean_markers_names(F.col(c)) for c in ("CHROM", "LOCUS", "POS")]).alias("MARKERS"), "CHROM", "LOCUS", "POS", "REF", "ALT", names.clean_ind_names(F.col("who.i")).alias("INDIVIDUALS"), F.col("who.s").alias("STRATA"), F.when(dose < 3, dose).alias("GT_BIN"))


def _unique_ids(x: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (one row each) whose INDIVIDUALS stands more than once get ``_1``, ``_2`` .. in their order."""
    w = Window.partitionBy("INDIVIDUALS")
    x = x.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(*keys)))
    return x.withColumn("INDIVIDUALS", F.when(F.col("__n") > 1, F.concat_ws("_", "INDIVIDUALS", F.col("__i").cast("string"))).otherwise(F.col("INDIVIDUALS"))).drop("__n", "__i")


def read_genepop(spark: SparkSession, path: str) -> DataFrame:
    """Long six-digit genotypes; alleles of one or two digits are padded; strata are the blocks' numbers.

    A line of a block without a comma goes on with the sample before it; samples that share a name are numbered.
    """
    t = numbered_lines(spark, path).filter("n > 0 and trim(line) <> ''").withColumn("pop", F.lower(F.trim("line")) == "pop")
    pops = [r[0] for r in t.filter("pop").select("n").orderBy("n").collect()]  # one for each stratum
    t = t.withColumn("block", sum((F.when(F.col("n") >= p, 1).otherwise(0) for p in pops[1:]), F.when(F.col("n") >= (pops[0] if pops else 0), 1).otherwise(0)) if len(pops) < 200 else F.size(F.filter(F.array(*[F.lit(p) for p in pops]), lambda p: p <= F.col("n"))))
    loci = t.filter("block = 0").select("n", F.posexplode(F.split("line", ",")).alias("k", "l")).withColumn("l", F.trim("l")).filter("l <> ''")
    loci = loci.select("l", (F.row_number().over(Window.orderBy("n", "k")) - 1).alias("k"))  # the names alone
    d = t.filter("block > 0 and not pop")
    if d.filter(~F.contains("line", F.lit(","))).limit(1).count():
        start = F.last(F.when(F.contains("line", F.lit(",")), F.col("n")), ignorenulls=True).over(Window.partitionBy("block").orderBy("n"))
        d = d.withColumn("s", start).groupBy("block", F.col("s").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("line"))
    d = d.select("n", "block", names.clean_ind_names(F.trim(F.substring_index("line", ",", 1))).alias("INDIVIDUALS"), F.split(F.trim(F.expr("substring(line, instr(line, ',') + 1)")), r"\s+").alias("g"))
    x = _unique_ids(d, ["n"]).select("block", "INDIVIDUALS", F.posexplode("g").alias("k", "raw")).join(loci, "k")
    half = (F.length("raw") / 2).cast("int")
    six = F.concat(F.lpad(F.substring("raw", F.lit(1), half), 3, "0"), F.lpad(F.substring("raw", half + 1, half), 3, "0"))
    return x.select(names.clean_markers_names(F.col("l")).alias("MARKERS"), "INDIVIDUALS", F.col("block").cast("string").alias("STRATA"), six.alias("GT"))


def read_fstat(spark: SparkSession, path: str) -> DataFrame:
    """Long six-digit genotypes; samples are numbered within the file."""
    t = numbered_lines(spark, path).filter("trim(line) <> ''")
    head = t.filter("n = 0").first()["line"].split()
    n_loci, coding = int(head[1]), int(head[3])
    loci = t.filter(f"n between 1 and {n_loci}").select((F.col("n") - 1).cast("int").alias("k"), F.trim("line").alias("m"))
    f = F.split(F.trim("line"), r"\s+")
    d = t.filter(f"n > {n_loci}").select("n", F.get(f, F.lit(0)).alias("STRATA"), F.slice(f, 2, F.lit(n_loci)).alias("g"))
    x = d.select("n", "STRATA", F.posexplode("g").alias("k", "g")).join(loci, "k")
    wide = F.lpad("g", 2 * coding, "0")
    six = F.concat(F.lpad(F.substring(wide, 1, coding), 3, "0"), F.lpad(F.substring(wide, coding + 1, coding), 3, "0"))
    return x.select(names.clean_markers_names(F.col("m")).alias("MARKERS"), F.concat(F.lit("ind-"), (F.col("n") - n_loci).cast("string")).alias("INDIVIDUALS"), "STRATA", six.alias("GT"))


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """Long haplotype genotypes: consensus loci go, three or more alleles are paralogs (missing), one allele is doubled, N is missing."""
    w = spark.read.csv(path, sep="\t", header=True)
    key, *rest = w.columns
    ids = [c for c in rest if c.lower() not in ("cnt", "segdist")]
    x = w.select(F.col(key).alias("LOCUS"), *[F.col(f"`{c}`") for c in ids]).unpivot(["LOCUS"], ids, "INDIVIDUALS", "h")
    bad = x.filter(F.lower("h") == "consensus").select("LOCUS").distinct()
    n = F.size(F.split("h", "/"))
    g = F.when(F.col("h").isin("-", "") | F.contains(F.col("h"), F.lit("N")) | (n > 2), "./.").when(n == 1, F.concat_ws("/", "h", "h")).otherwise(F.col("h"))
    return x.join(bad, "LOCUS", "left_anti").select(F.col("LOCUS").alias("MARKERS"), "LOCUS", names.clean_ind_names(F.col("INDIVIDUALS")).alias("INDIVIDUALS"), g.alias("GT_VCF_NUC"))


def _dart_head(spark: SparkSession, path: str) -> tuple[str, list[str], list[list[str]], str, str]:
    """Dialect, column names, cells of the star lines, separator, and the header line."""
    first = [r[0] for r in spark.read.text(path).limit(50).collect()]
    kind, stars = detect_dart_format(first)
    sep = "\t" if "\t" in first[stars] else ","
    return kind, first[stars].split(sep), [x.split(sep) for x in first[:stars]], sep, first[stars]


#: fixed values: columns that describe the marker; the others are targets
DART_COLUMNS = {"AlleleID", "CloneID", "AlleleSequence", "AlleleSequenceRef", "AlleleSequenceSnp", "TrimmedSequence", "TrimmedSequenceRef", "TrimmedSequenceSnp", "ClusterConsensusSequence", "ClusterTempIndex", "SNP", "SnpPosition", "CallRate", "OneRatio", "OneRatioRef", "OneRatioSnp",
                "FreqHomRef", "FreqHomSnp", "FreqHets", "PICRef", "PICSnp", "PIC", "AvgPIC", "AvgCountRef", "AvgCountSnp", "RatioAvgCountRefAvgCountSnp", "AvgReadDepth", "StDevReadDepth", "Qpmr", "Reproducibility", "RepAvg", "MarkerName", "UID", "rdepth"}


def dart_targets(spark: SparkSession, path: str, metadata: bool = False) -> DataFrame:
    """TARGET_ID of a DArT file, in its order; with ``metadata`` the star lines above each as columns.

    A line of plate wells is WELL, of their letters WELL_ROW, of their numbers WELL_COL, any other META_1, META_2 ..
    """
    import re

    _, head, stars, _, _ = _dart_head(spark, path)
    at = [i for i, n in enumerate(head) if n not in DART_COLUMNS and not n.startswith(("Chrom_", "ChromPos_", "AlnCnt_", "AlnEvalue_", "Strand_"))]
    columns: dict[str, list] = {}
    for k, cells in enumerate(stars if metadata else [], 1):
        own = [cells[i].strip() if i < len(cells) and cells[i].strip() not in ("", "-", "*") else None for i in at]
        said = {x.upper() for x in own if x}
        shapes = {"WELL": "[A-H](?:[1-9]|1[0-2])", "WELL_ROW": "[A-H]", "WELL_COL": "(?:[1-9]|1[0-2])"}
        name = next((n for n, r in shapes.items() if said and n not in columns and all(re.fullmatch(r, x) for x in said)), f"META_{k}")
        columns[name] = own
    rows = [(i + 1, head[j], *[c[i] for c in columns.values()]) for i, j in enumerate(at)]
    return spark.createDataFrame(rows, ", ".join(["TARGET_SEQ int", "TARGET_ID string", *[f"{n} string" for n in columns]]))


def read_dart(spark: SparkSession, path: str, strata: DataFrame, whitelist: DataFrame | None = None, calibrate: bool = True) -> DataFrame:
    """Long genotypes of a DArT file (1row, 2rows or counts) for the targets in ``strata`` (TARGET_ID, INDIVIDUALS, STRATA).

    A silico file has no alleles: its rows are (MARKERS, SEQUENCE, VALUE 1 present, 0 absent, null unknown) by sample.
    ``whitelist`` (MARKERS) keeps its markers only; ``calibrate`` makes the more frequent allele the reference.
    """
    kind, head, _, sep, line = _dart_head(spark, path)
    t = spark.read.text(path).filter("value not like '*%' and value <> ''").filter(F.col("value") != F.lit(line)).withColumn("ROW", F.monotonically_increasing_id())
    f = F.split("value", sep)
    of = lambda n: F.get(f, F.lit(head.index(n)))
    targets = [r[0] for r in strata.select("TARGET_ID").distinct().collect() if r[0] in head]
    calls = F.explode(F.array(*[F.struct(F.lit(x).alias("TARGET_ID"), of(x).alias("VALUE")) for x in targets]) if targets else F.array().cast("array<struct<TARGET_ID:string,VALUE:string>>")).alias("c")
    live = lambda x: x if whitelist is None else x.join(whitelist.select("MARKERS").distinct(), "MARKERS", "left_semi")
    if kind == "silico.dart":
        sequence = next((n for n in ("AlleleSequence", "TrimmedSequence", "SEQUENCE", "Sequence") if n in head), None)
        x = t.select(names.clean_markers_names(of("CloneID")).alias("MARKERS"), (of(sequence) if sequence else F.lit(None).cast("string")).alias("SEQUENCE"), calls)
        return live(x.select("MARKERS", "SEQUENCE", "c.TARGET_ID", F.col("c.VALUE").try_cast("int").alias("VALUE"))).join(strata, "TARGET_ID")
    meta = [of("AlleleID" if "AlleleID" in head else "CloneID").alias("ALLELE_ID"), (of("SNP") if "SNP" in head else F.lit("")).alias("SNP"), (of("SnpPosition") if "SnpPosition" in head else F.lit("1")).alias("SNP_POSITION")]
    x = t.select("ROW", *meta, calls).select("ROW", "ALLELE_ID", "SNP", "SNP_POSITION", "c.*").withColumn("VARIANT_ID", F.split_part("ALLELE_ID", F.lit("|"), F.lit(1)))
    m = dart.markers_metadata(x.filter("SNP <> ''").select("ALLELE_ID", "SNP", "SNP_POSITION").distinct()).withColumn("VARIANT_ID", F.split_part("ALLELE_ID", F.lit("|"), F.lit(1)))
    long = dart.one_row(x.select("VARIANT_ID", "TARGET_ID", "VALUE")) if kind == "1row" else dart.two_rows(x.select("VARIANT_ID", "TARGET_ID", "ROW", "VALUE"), counts=kind == "counts")
    g = dart.genotyper(long, counts=kind == "counts")
    g = live(g.join(m.select("VARIANT_ID", "MARKERS", "CHROM", "LOCUS", "POS", "REF", "ALT"), "VARIANT_ID")).join(strata, "TARGET_ID")
    return recode.calibrate_alleles(g) if calibrate else g


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    return recode.tidy_wide(spark.read.csv(path, sep="\t", header=True))


def read_rad(spark: SparkSession, path: str, columns: list[str] | None = None, markers: DataFrame | None = None, individuals: DataFrame | None = None) -> DataFrame:
    """A stored table; with dimensions that have FILTERS, only their whitelisted rows, which must be in the table."""
    df = spark.read.parquet(path)
    for key, dim in (("MARKERS", markers), ("INDIVIDUALS", individuals)):
        if dim is not None:
            keep = metadata.extract(dim, whitelist=True).select(key).distinct()
            if lost := keep.join(df.select(key).distinct(), key, "left_anti").limit(5).collect():
                raise ValueError(f"whitelisted {key} that the store lacks: {[r[0] for r in lost]}")
            df = df.join(keep, key, "left_semi")
    return df.select(*columns) if columns else df


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.csv(path, sep="\t", header=True)
    return w.select(*[names.clean_markers_names(F.col(c)).alias(names.snake_upper(c)) if c.upper() in ("MARKERS", "CHROM", "LOCUS", "POS") else F.col(c) for c in w.columns]).distinct()


def read_blacklist_id(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select(names.clean_ind_names(F.col("INDIVIDUALS")).alias("INDIVIDUALS")).distinct()


def read_blacklist_genotypes(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.csv(path, sep="\t", header=True)
    return b.withColumn("INDIVIDUALS", names.clean_ind_names(F.col("INDIVIDUALS"))).withColumn("MARKERS", names.clean_markers_names(F.col("MARKERS"))).distinct()


def read_genotypes(spark: SparkSession, path: str, strata: DataFrame | None = None, whitelist: DataFrame | None = None, blacklist_id: DataFrame | None = None, common: bool = False, monomorphic: bool = False) -> DataFrame:
    """Any format, by sniffing; then the listed markers, without the listed samples, and optionally without markers that a stratum lacks or that do not vary."""
    from ..operators import filters, stats

    kind = detect_genomic_format(path)
    if kind == "vcf":
        g = read_vcf(spark, path, strata)
    elif kind == "dart":
        g = read_dart(spark, path, strata)
    else:
        base = path[: path.rindex(".")]
        one = {"plink.tped": lambda: read_tped(spark, base + ".tped"), "plink.bed": lambda: read_bed(spark, base), "genepop": lambda: read_genepop(spark, path), "fstat": lambda: read_fstat(spark, path), "haplotypes": lambda: read_haplotypes(spark, path), "parquet": lambda: read_rad(spark, path), "tidy": lambda: read_tidy(spark, path)}
        g = one[kind]()
        if strata is not None:
            g = g.drop("STRATA").join(strata.select("INDIVIDUALS", "STRATA"), "INDIVIDUALS")
    if whitelist is not None:
        g = filters.whitelist(g, whitelist)
    if blacklist_id is not None:
        g = g.join(blacklist_id.select("INDIVIDUALS").distinct(), "INDIVIDUALS", "left_anti")
    if (common or monomorphic) and "GT_BIN" not in g.columns:
        g = recode.gt_recoding(g)
    if monomorphic:
        g = g.join(stats.monomorphic(g), "MARKERS", "left_anti")
    return filters.common_markers(g) if common else g
