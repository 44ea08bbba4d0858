"""Files in and out: each reader against a small file, and round trips."""

import glob

import pytest
from pyspark.sql import functions as F

from snpweave import adapter
from snpweave.model import Dataset
from snpweave.operators import recode, strata
from snpweave.plans import cascade
from snpweave.sinks import writers
from snpweave.sources import readers

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def text(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def g(spark):
    return adapter.tidy(spark, SF).persist()


def test_vcf_round_trip(spark, g, tmp_path):
    writers.genomic_converter(g, ["vcf"], str(tmp_path))
    one = tmp_path / "one.vcf"
    one.write_text(text(tmp_path / "vcf"))
    assert readers.detect_genomic_format(str(one)) == "vcf"
    head = readers.vcf_header(spark, str(one))
    assert len(head["samples"]) == 10 and head["source"] == "unknown"
    back = readers.read_vcf(spark, str(one), g.select("INDIVIDUALS", "STRATA").distinct())
    want = g.select(F.concat_ws("__", "CHROM", "MARKERS", "POS").alias("MARKERS"), "INDIVIDUALS", "STRATA", "GT_BIN")
    assert rows(back, "MARKERS", "INDIVIDUALS", "STRATA", "GT_BIN") == rows(want, "MARKERS", "INDIVIDUALS", "STRATA", "GT_BIN")


def test_vcf_fields_and_repeats(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text("##fileformat=VCFv4.2\n##source=freeBayes v1\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta_1\tb\n"
                 "c1\t5\tl1\tA\tC\t.\tPASS\tNS=2\tGT:DP:AD\t0/1:7:4,3\t./.:.:.\nc1\t5\tl1\tA\tG\t.\tPASS\tNS=2\tGT:DP:AD\t1|1:5:0,5\t0/0:2:2,0\n")  # fmt: skip
    got = rows(readers.read_vcf(spark, str(p)), "MARKERS", "INDIVIDUALS", "GT_BIN", "READ_DEPTH", "ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH")
    assert got == sorted([("c1__l1__5_1", "a-1", 1, 7, 4, 3), ("c1__l1__5_1", "b", None, None, None, None), ("c1__l1__5_2", "a-1", 2, 5, None, 5), ("c1__l1__5_2", "b", 0, 2, 2, None)], key=str)


def test_tped_round_trip(spark, g, tmp_path):
    writers.genomic_converter(g, ["tped", "tfam"], str(tmp_path))
    (tmp_path / "x.tped").write_text(text(tmp_path / "tped"))
    (tmp_path / "x.tfam").write_text(text(tmp_path / "tfam"))
    assert readers.detect_genomic_format(str(tmp_path / "x.tped")) == "plink.tped"
    back = readers.read_tped(spark, str(tmp_path / "x.tped"))
    want = recode.gt_recoding(g).select(F.concat_ws("__", "CHROM", "MARKERS", "POS").alias("MARKERS"), "INDIVIDUALS", "STRATA", "GT")
    assert rows(back, "MARKERS", "INDIVIDUALS", "STRATA", "GT") == rows(want, "MARKERS", "INDIVIDUALS", "STRATA", "GT")


def test_tped_samples_stay_in_tables(spark, tmp_path):
    """Samples are rows, met by place: the plan neither names them nor has a whole line beside each call; odd lines as before."""
    (tmp_path / "x.tfam").write_text("p  s_1 0 0 0 -9\n\nq s2 0 0 0 -9\np s3 0 0 0 -9\n")
    (tmp_path / "x.tped").write_text("1 a 0 5 A C  g G 0 0\n1 b 0 6 0 0 N 0 0 0\n\n2\tc\t0\t7\tT\tA\tC\n2 d 0 8 A A C C G G T T\n2 e 0 9 0 0 0 0 0 0 A A\n2 f 0 9\n")
    back = readers.read_tped(spark, str(tmp_path / "x.tped"))
    want = [("1__a__5", ("001002", "003003", "000000")), ("2__c__7", ("004001", "002000", "000000")), ("2__d__8", ("001001", "002002", "003003"))]
    assert rows(back, "MARKERS", "INDIVIDUALS", "STRATA", "GT") == sorted((m, i, s, c) for m, x in want for i, s, c in zip(("s-1", "s2", "s3"), "pqp", x))
    plan = back._jdf.queryExecution().toString()
    assert "s_1" not in plan and "s-1" not in plan and not any("Generate posexplode" in x and "who" in x for x in plan.split("\n"))


def test_multiallelic_and_fields(spark, tmp_path):
    p = tmp_path / "m.vcf"
    p.write_text("##fileformat=VCFv4.2\n##contig=<ID=c1>\n##reference=ref.fa\n##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=DP,Number=1>\n##FORMAT=<ID=CATG,Number=4>\n##FORMAT=<ID=GL,Number=3>\n##FORMAT=<ID=GQ,Number=1>\n"
                 "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\n"
                 "c1\t5\tl1\tA\tC,G\t.\tPASS\t.\tGT:DP\t1/2:7\t0|2:3\t2/2:4\t./.:.\nc1\t9\tl2\tG\tT\t.\tq10\t.\tGT:DP:CATG:GL:GQ\t0/1:9:0,1,4,5:-1.5,0,-2:30\t0/0:6:.:.:.\t1/1:5:0,0,5,0:.:.\t0/0:.:.:.:.\n")  # fmt: skip
    g = readers.read_vcf(spark, str(p))
    assert rows(g.filter("LOCUS = 'l1'"), "INDIVIDUALS", "GT_BIN", "GT_VCF_NUC") == sorted([("a", None, "C/G"), ("b", None, "A|G"), ("c", None, "G/G"), ("d", None, "./.")], key=str)
    one = readers.read_vcf(spark, str(p), multiallelic="split")
    assert rows(one.filter("LOCUS = 'l1'"), "MARKERS", "ALT", "INDIVIDUALS", "GT_BIN") == sorted([(f"c1__l1__5_{k}", a, i, n) for k, a, v in ((1, "C", (1, 0, 0, None)), (2, "G", (1, 1, 2, None))) for i, n in zip("abcd", v)], key=str)
    assert rows(one.filter("LOCUS = 'l2'").select("MARKERS").distinct(), "MARKERS") == [("c1__l2__9",)]
    assert readers.read_vcf(spark, str(p), multiallelic="drop").select("MARKERS").distinct().count() == 1
    got = {r["INDIVIDUALS"]: r for r in g.filter("LOCUS = 'l2'").collect()}
    assert (got["a"]["ALLELE_REF_DEPTH"], got["a"]["ALLELE_ALT_DEPTH"], got["a"]["GL_HOM_REF"], got["a"]["GL_HOM_ALT"], got["a"]["GQ"]) == (5, 4, -1.5, -2.0, 30.0)
    assert (got["b"]["ALLELE_REF_DEPTH"], got["b"]["ALLELE_ALT_DEPTH"], got["c"]["ALLELE_ALT_DEPTH"], got["d"]["ALLELE_REF_DEPTH"]) == (6, None, 5, None)
    assert readers.vcf_info(spark, str(p))["n_variants"] == 2 and readers.extract_ref_genome(spark, str(p)) == "ref.fa"
    assert recode.check_coverage(g) == ["READ_DEPTH", "ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH", "C_DEPTH", "A_DEPTH", "T_DEPTH", "G_DEPTH"] and recode.check_coverage(g, "1row") == []
    assert recode.detect_gt(g) == ["GT_BIN"] and recode.detect_gt(g, keep_one=False) == ["GT_BIN", "GT_VCF_NUC"]
    import gzip

    with gzip.open(tmp_path / "m2.vcf.gz", "wt") as f:
        f.write(p.read_text())
    assert readers.detect_genomic_format(str(tmp_path / "m2.vcf.gz")) == "vcf" and rows(readers.read_vcf(spark, str(tmp_path / "m2.vcf.gz")), *g.columns) == rows(g, *g.columns)
    with pytest.raises(ValueError):
        readers.read_vcf(spark, str(p), multiallelic="nope")


def test_split_haplotypes(spark):
    g = spark.createDataFrame([("m", "10", "ACG", "ATG,TCG", i, b, n) for i, b, n in (("a", "ACG/ATG", None), ("b", "TCG|TCG", None), ("c", "./.", None))] + [("s", "20", "A", "C", "a", "A/C", 1)], "MARKERS string, POS string, REF string, ALT string, INDIVIDUALS string, GT_VCF_NUC string, GT_BIN int")
    got = rows(recode.split_haplotypes(g), "MARKERS", "POS", "REF", "ALT", "INDIVIDUALS", "GT_VCF_NUC", "GT_BIN")
    want = [("m_1", "10", "A", "T", "a", "A/A", 0), ("m_1", "10", "A", "T", "b", "T|T", 2), ("m_1", "10", "A", "T", "c", "./.", None), ("m_2", "11", "C", "T", "a", "C/T", 1), ("m_2", "11", "C", "T", "b", "C|C", 0), ("m_2", "11", "C", "T", "c", "./.", None), ("s", "20", "A", "C", "a", "A/C", 1)]
    assert got == sorted(want, key=str)


def test_genind_and_genlight(spark):
    w = spark.createDataFrame([("i1", "p", 2, 0, 1, 1), ("i2", "p", 1, 1, 0, 2), ("i3", "q", None, None, 2, 0)], "INDIVIDUALS string, STRATA string, `m1.A` int, `m1.C` int, `m2.G` int, `m2.T` int")
    got = rows(recode.tidy_genind(w), "MARKERS", "INDIVIDUALS", "REF", "ALT", "GT_BIN")
    assert got == sorted([("m1", "i1", "A", "C", 0), ("m1", "i2", "A", "C", 1), ("m1", "i3", "A", "C", None), ("m2", "i1", "T", "G", 1), ("m2", "i2", "T", "G", 0), ("m2", "i3", "T", "G", 2)], key=str)
    many = w.withColumn("m1.G", F.when(F.col("INDIVIDUALS") == "i2", 0).otherwise(0)).withColumn("m1.G", F.col("`m1.G`"))
    got = rows(recode.tidy_genind(many), "MARKERS", "INDIVIDUALS", "GT")
    assert got == sorted([("m1", "i1", "001001"), ("m1", "i2", "001002"), ("m1", "i3", "000000"), ("m2", "i1", "003004"), ("m2", "i2", "004004"), ("m2", "i3", "003003")], key=str)
    l = spark.createDataFrame([("i1", "p", 0, 2)], "INDIVIDUALS string, STRATA string, a int, b int")
    assert rows(recode.tidy_genlight(l), "MARKERS", "GT_BIN", "REF", "ALT") == [("a", 0, "A", "C"), ("b", 2, "A", "C")]


def test_import_cascade(spark, tmp_path):
    p = tmp_path / "c.vcf"
    head = "##fileformat=VCFv4.2\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\tx\n"
    sites = [("5", "A", "C", "PASS", "0/1 0/0 1/1 0/1 0/0"), ("6", "A", "C", "q10", "0/1 0/0 1/1 0/1 0/0"), ("7", "A", "C,G", "PASS", "0/1 0/0 1/1 0/1 0/0"), ("8", "A", "G", "PASS", "0/0 0/0 0/0 0/0 0/1"), ("9", "A", "G", "PASS", "0/1 0/0 ./. ./. 0/1"), ("10", "G", "T", "PASS", "0/1 0/1 0/0 1/1 0/1"), ("11", "G", "T", "PASS", "0/1 ./. 0/0 0/1 0/1")]
    p.write_text(head + "".join("\t".join(["c1", pos, f"l{pos}", r, a, ".", f, ".", "GT", *calls.split()]) + "\n" for pos, r, a, f, calls in sites))
    s = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q")], "INDIVIDUALS string, STRATA string")
    ds = cascade.import_vcf(spark, str(p), s, whitelist_markers=spark.createDataFrame([(f"c1__l{k}__{k}",) for k in (5, 8, 10, 11)], "MARKERS string"), genotyping=0.1)
    tags = {r["MARKERS"].split("__")[-1]: r["FILTERS"] for r in ds.markers.collect()}
    assert tags == {"5": "whitelist", "6": "filter.vcf.filter.column", "7": "filter.haplotype.format", "8": "filter.monomorphic", "9": "filter.common.markers", "10": "whitelist", "11": "filter.genotyping"}
    assert {r["INDIVIDUALS"]: r["FILTERS"] for r in ds.individuals.collect()} == {"a": "whitelist", "b": "whitelist", "c": "whitelist", "d": "whitelist", "x": "filter.strata"}
    assert [r["FILTERS"] for r in ds.ledger][-1] == "filter.genotyping" and ds.ledger[-1]["AFTER"].endswith("/ 2")
    with pytest.raises(ValueError):
        cascade.import_vcf(spark, str(p), s, nope=1)


def test_bed(spark, tmp_path, monkeypatch):
    (tmp_path / "x.fam").write_text("p1 i1 0 0 0 -9\np1 i2 0 0 0 -9\np2 i3 0 0 0 -9\np2 i4 0 0 0 -9\np2 i5 0 0 0 -9\n")
    (tmp_path / "x.bim").write_text("1 l1 0 10 C A\n1 l2 0 20 G T\n")
    # 00 hom first allele, 10 het, 11 hom second, 01 missing; low bits first
    (tmp_path / "x.bed").write_bytes(bytes([0x6C, 0x1B, 0x01, 0b01111000, 0b10, 0b11111111, 0b00]))
    assert readers.detect_genomic_format(str(tmp_path / "x.bed")) == "plink.bed"
    with pytest.raises(FileNotFoundError):
        readers.detect_genomic_format(str(tmp_path / "y.bed"))
    monkeypatch.setattr(readers, "_BED_VARIANTS", 2)
    got = {(r["LOCUS"], r["INDIVIDUALS"]): r["GT_BIN"] for r in readers.read_genotypes(spark, str(tmp_path / "x.bed")).collect()}
    assert [got["l1", f"i{k}"] for k in range(1, 6)] == [2, 1, 0, None, 1]
    assert [got["l2", f"i{k}"] for k in range(1, 6)] == [0, 0, 0, 0, 2]


def test_genepop_and_fstat(spark, tmp_path):
    p = tmp_path / "x.gen"
    p.write_text("title\nl.1\nl2\nPOP\na_1 , 0102 0000\nb , 0101 0202\npop\nc , 0202 0102\n")
    got = rows(readers.read_genepop(spark, str(p)), "STRATA", "INDIVIDUALS", "MARKERS", "GT")
    assert got == sorted([("1", "a-1", "l_1", "001002"), ("1", "a-1", "l2", "000000"), ("1", "b", "l_1", "001001"), ("1", "b", "l2", "002002"), ("2", "c", "l_1", "002002"), ("2", "c", "l2", "001002")], key=str)
    p.write_text("title\nl.1, l2\nPOP\na , 0102\n0000\na , 0101 0202\n")
    got = rows(readers.read_genepop(spark, str(p)), "INDIVIDUALS", "MARKERS", "GT")
    assert got == sorted([("a_1", "l_1", "001002"), ("a_1", "l2", "000000"), ("a_2", "l_1", "001001"), ("a_2", "l2", "002002")], key=str)
    q = tmp_path / "x.dat"
    q.write_text("2 2 2 1\nl1\nl2\n1 12 0\n2 22 11\n")
    got = rows(readers.read_fstat(spark, str(q)), "STRATA", "INDIVIDUALS", "MARKERS", "GT")
    assert got == sorted([("1", "ind-1", "l1", "001002"), ("1", "ind-1", "l2", "000000"), ("2", "ind-2", "l1", "002002"), ("2", "ind-2", "l2", "001001")], key=str)


def test_haplotypes(spark, tmp_path):
    p = tmp_path / "h.tsv"
    p.write_text("Catalog Locus ID\tCnt\ta\tb\n1\t2\tAC/AG\tAC\n2\t2\tconsensus\tconsensus\n3\t2\tA/C/G\t-\n4\t2\tAN\tA/T\n")
    assert readers.detect_genomic_format(str(p)) == "haplotypes"
    got = rows(readers.read_haplotypes(spark, str(p)), "MARKERS", "INDIVIDUALS", "GT_VCF_NUC")
    assert got == sorted([("1", "a", "AC/AG"), ("1", "b", "AC/AC"), ("3", "a", "./."), ("3", "b", "./."), ("4", "a", "./."), ("4", "b", "A/T")], key=str)


DART = {
    "1row": "*,*,*,o1,o2\nAlleleID,SNP,SnpPosition,t1,t2\n10|F|0-5:A>C,5:A>C,5,0,2\n11|F|0-7:G>T,7:G>T,7,1,-\n",
    "2rows": "AlleleID,SNP,SnpPosition,t1,t2\n10|F|0,,5,1,1\n10|F|0-5:A>C,5:A>C,5,0,1\n11|F|0,,7,0,-\n11|F|0-7:G>T,7:G>T,7,1,-\n",
    "counts": "AlleleID,SNP,SnpPosition,t1,t2\n10|F|0,,5,4,3\n10|F|0-5:A>C,5:A>C,5,0,9\n11|F|0,,7,0,0\n11|F|0-7:G>T,7:G>T,7,6,0\n",
}


@pytest.mark.parametrize("kind", DART)
def test_dart(spark, tmp_path, kind):
    p = tmp_path / "d.csv"
    p.write_text(DART[kind])
    assert readers.detect_dart_format(DART[kind].splitlines())[0] == kind
    s = spark.createDataFrame([("t1", "i1", "a"), ("t2", "i2", "b")], "TARGET_ID string, INDIVIDUALS string, STRATA string")
    got = rows(readers.read_dart(spark, str(p), s, calibrate=False), "MARKERS", "INDIVIDUALS", "REF", "ALT", "GT_BIN")
    assert got == sorted([("CHROM_1__10__5", "i1", "A", "C", 0), ("CHROM_1__10__5", "i2", "A", "C", 1), ("CHROM_1__11__7", "i1", "G", "T", 2), ("CHROM_1__11__7", "i2", "G", "T", None)], key=str)
    got = rows(readers.read_dart(spark, str(p), s, whitelist=spark.createDataFrame([("CHROM_1__11__7",)], "MARKERS string")), "MARKERS", "INDIVIDUALS", "REF", "ALT", "GT_BIN")
    assert got == sorted([("CHROM_1__11__7", "i1", "T", "G", 0), ("CHROM_1__11__7", "i2", "T", "G", None)], key=str)


def test_silico_and_targets(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("*,*,P1,P1,P2\n*,*,A1,B12,H3\n*,*,A,B,H\n*,*,1,12,3\nCloneID,AlleleSequence,t1,t2,t3\n100,TGCA,1,0,-\n101,TGCC,0,1,1\n")
    s = spark.createDataFrame([("t1", "i1", "a"), ("t3", "i3", "b")], "TARGET_ID string, INDIVIDUALS string, STRATA string")
    got = rows(readers.read_dart(spark, str(p), s), "MARKERS", "SEQUENCE", "INDIVIDUALS", "STRATA", "VALUE")
    assert got == sorted([("100", "TGCA", "i1", "a", 1), ("100", "TGCA", "i3", "b", None), ("101", "TGCC", "i1", "a", 0), ("101", "TGCC", "i3", "b", 1)], key=str)
    t = readers.dart_targets(spark, str(p), metadata=True).orderBy("TARGET_SEQ")
    assert [tuple(r) for r in t.select("TARGET_ID", "META_1", "WELL", "WELL_ROW", "WELL_COL").collect()] == [("t1", "P1", "A1", "A", "1"), ("t2", "P1", "B12", "B", "12"), ("t3", "P2", "H3", "H", "3")]


def test_lists_and_store(spark, g, tmp_path):
    (tmp_path / "w.tsv").write_text("MARKERS\na-1\na-1\nb\n")
    assert rows(readers.read_whitelist(spark, str(tmp_path / "w.tsv")), "MARKERS") == [("a_1",), ("b",)]
    (tmp_path / "i.tsv").write_text("INDIVIDUALS\na_1\na-1\n")
    assert rows(readers.read_blacklist_id(spark, str(tmp_path / "i.tsv")), "INDIVIDUALS") == [("a-1",)]
    (tmp_path / "s.tsv").write_text("INDIVIDUALS\tSTRATA\na_1\tx y\nb\tz\n")
    assert rows(strata.read_strata(spark, str(tmp_path / "s.tsv")), "INDIVIDUALS", "STRATA") == [("a-1", "x_y"), ("b", "z")]
    writers.write_rad(g, str(tmp_path / "rad"))
    assert readers.read_rad(spark, str(tmp_path / "rad"), ["MARKERS", "GT_BIN"]).count() == g.count()
    ds = Dataset.from_tidy(g)
    assert ds.live().count() == g.count()
    done = writers.genomic_converter(g, [*writers.DOCUMENTS, *writers.TABLE_WRITERS], str(tmp_path / "all"))
    assert len(done) == len(writers.DOCUMENTS) + len(writers.TABLE_WRITERS) and all(glob.glob(f"{p}/part-*") for p in done)
    with pytest.raises(ValueError):
        writers.genomic_converter(g, ["nope"], str(tmp_path))
    with pytest.raises(ValueError):
        writers.genomic_converter(g.withColumn("ALT", F.lit("C,G")), ["vcf"], str(tmp_path))
    white = ds.markers.withColumn("FILTERS", F.when(F.col("CHROM") == "1", "filter.x").otherwise("whitelist"))
    assert readers.read_rad(spark, str(tmp_path / "rad"), markers=white).select("CHROM").distinct().count() == 4
    with pytest.raises(ValueError):
        readers.read_rad(spark, str(tmp_path / "rad"), individuals=spark.createDataFrame([("nobody", "whitelist")], "INDIVIDUALS string, FILTERS string"))


def test_genepop_and_fstat_round_trips(spark, g, tmp_path):
    writers.genomic_converter(g, ["genepop", "hierfstat"], str(tmp_path))
    (tmp_path / "x.gen").write_text(text(tmp_path / "genepop"))
    (tmp_path / "x.dat").write_text(text(tmp_path / "hierfstat"))
    pops = writers.pop_number(g)
    want = recode.gt_recoding(g).join(pops, "STRATA").select("MARKERS", "INDIVIDUALS", F.col("POP").cast("string").alias("STRATA"), "GT")
    assert rows(readers.read_genepop(spark, str(tmp_path / "x.gen")), "MARKERS", "INDIVIDUALS", "STRATA", "GT") == rows(want, "MARKERS", "INDIVIDUALS", "STRATA", "GT")
    order = {r[0]: f"ind-{i}" for i, r in enumerate(g.select("INDIVIDUALS", "STRATA").distinct().orderBy("STRATA", "INDIVIDUALS").select("INDIVIDUALS").collect(), 1)}
    back = rows(readers.read_fstat(spark, str(tmp_path / "x.dat")), "MARKERS", "INDIVIDUALS", "STRATA", "GT")
    assert back == sorted([(r["MARKERS"], order[r["INDIVIDUALS"]], r["STRATA"], r["GT"]) for r in want.collect()], key=str)


FOUR = [("c", "l1", "c__l1__5", "5", "A", "T", "i1", "p", 1), ("c", "l1", "c__l1__5", "5", "A", "T", "i2", "q", None), ("c", "l2", "c__l2__7", "7", "G", "C", "i1", "p", 2), ("c", "l2", "c__l2__7", "7", "G", "C", "i2", "q", 0)]
GOLDEN = {
    "genepop": "genotypes written by snpweave\nc__l1__5, c__l2__7\npop\ni1, 001004 002002\npop\ni2, 000000 003003\n",
    "hierfstat": "2 2 4 1\nc__l1__5\nc__l2__7\n1\t14\t22\n2\t00\t33\n",
    "structure": "c__l1__5\tc__l2__7\ni1\t1\t1\t4\t2\t2\ni2\t2\t-9\t-9\t3\t3\n",
    "gsi_sim": "2 2\nc__l1__5\nc__l2__7\npop p\ni1 001 004 002 002\npop q\ni2 000 000 003 003\n",
    "bayescan": "[loci]=2\n\n[populations]=2\n\n[pop]=1\n1 2 2 1 1\n2 2 2 0 2\n\n[pop]=2\n2 2 2 2 0\n\n",
    "rubias": "sample_type\trepunit\tcollection\tindiv\tc__l1__5_A1\tc__l1__5_A2\tc__l2__7_A1\tc__l2__7_A2\nreference\tp\tp\ti1\t1\t4\t2\t2\nreference\tq\tq\ti2\tNA\tNA\t3\t3\n",
    "related": "i1 1 4 2 2\ni2 0 0 3 3\n",
    "hapmap": "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\ti1\ti2\nc__l1__5\tA/T\tc\t5\t+\tNA\tNA\tNA\tNA\tNA\tNA\tAT\tNA\nc__l2__7\tG/C\tc\t7\t+\tNA\tNA\tNA\tNA\tNA\tNA\tCC\tGG\n",
    "dadi": "# genotypes written by snpweave\nIN_GROUP\tOUT_GROUP\tAllele1\tp\tq\tAllele2\tp\tq\tMARKERS\n---\t---\tA\t1\t0\tT\t1\t0\tc__l1__5\n---\t---\tG\t0\t2\tC\t2\t0\tc__l2__7\n",
    "fineradstructure": "p1\tq2\nA/T\tN/N\nC/C\tG/G\n",
    "stockr": "MARKERS\ti1\ti2\nSTRATA\tp\tq\nc__l1__5\t1\tNA\nc__l2__7\t2\t0\n",
    "vcf": '##fileformat=VCFv4.3\n##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ti1\ti2\nc\t5\tc__l1__5\tA\tT\t.\tPASS\tNS=1\tGT\t0/1\t./.\nc\t7\tc__l2__7\tG\tC\t.\tPASS\tNS=2\tGT\t1/1\t0/0\n',
    "arlequin": "[Profile]\nTitle = \"genotypes written by snpweave\"\nNbSamples = 2\nGenotypicData = 1\nLocusSeparator = WHITESPACE\nGameticPhase = 0\nMissingData = '?'\nDataType = STANDARD\n[Data]\n[[Samples]]\n"
                'SampleName = "p"\nSampleSize = 1\nSampleData = {\ni1\t001\t002\n\t004\t002\n}\nSampleName = "q"\nSampleSize = 1\nSampleData = {\ni2\t-9\t003\n\t-9\t003\n}\n[[Structure]]\nStructureName = "One cluster"\nNbGroups = 1\nGroup = {\n"p"\n"q"\n}\n',
}


def test_whole_files(spark, tmp_path):
    four = spark.createDataFrame(FOUR, "CHROM string, LOCUS string, MARKERS string, POS string, REF string, ALT string, INDIVIDUALS string, STRATA string, GT_BIN int")
    writers.genomic_converter(four, [*GOLDEN, "colony"], str(tmp_path))
    for name, want in GOLDEN.items():
        assert text(tmp_path / name) == want, name
    lines = text(tmp_path / "colony").split("\n")
    assert lines[2].startswith("2\t") and "i1 1 4 2 2" in lines and lines.index("i2 0 0 3 3") == lines.index("i1 1 4 2 2") + 1 and "c__l1__5 c__l2__7\t! markers" in lines
    known = [r["LINE"] for r in writers.colony(four, frequencies=True).orderBy("SEC", "BLOCK", "ORD", "KEY").collect()]
    at = known.index("2 2\t! alleles by locus")
    assert known[at + 1 : at + 5] == ["1 4", "0.5 0.5", "2 3", "0.5 0.5"]
    names = writers.split_vcf(four, spark.createDataFrame([("i1", "x"), ("i2", "y")], "INDIVIDUALS string, SPLIT string"), str(tmp_path / "split"))
    assert names == ["x", "y"] and "\ti1\n" in text(tmp_path / "split/x") and "\ti2\n" in text(tmp_path / "split/y")
    fasta = spark.createDataFrame([("l1", "GGAC")], "LOCUS string, SEQUENCE string")
    around = writers.sequence_context(spark.createDataFrame([("c__l1__5", "l1", 2), ("other", "l1", 0)], "MARKERS string, LOCUS string, COL int"), fasta)
    assert rows(around, "MARKERS", "CONTEXT") == [("c__l1__5", "GAC"), ("other", "-GG")]
