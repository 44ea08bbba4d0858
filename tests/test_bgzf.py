"""Block-compressed files: ranges, seams, regions."""

import gzip
import random

import pyarrow as pa
import pytest

from snpweave.sources import bgzf, readers


def _write(path, text: bytes) -> str:
    path.write_bytes(bgzf.compress(text) + bgzf.END)
    assert gzip.decompress(path.read_bytes()) == text
    return str(path)


def _ranges(path, n):
    import os

    size = os.path.getsize(path)
    cuts = [size * k // n for k in range(n + 1)]
    return [line for lo, hi in zip(cuts, cuts[1:], strict=False) for t in bgzf.text_of(path, lo, hi, most=3000) for line in bgzf.to_lines(t).to_pylist()]


@pytest.mark.parametrize("ending", ["\n", ""])
def test_seams(tmp_path, ending):
    rng = random.Random(5)
    # lines of all lengths, some longer than several blocks; bytes that do not compress hold the magic by chance
    lines = ["".join(rng.choice("ACGTé\t/|") for _ in range(rng.choice((0, 1, 40, 3000, 200_000)))) for _ in range(120)] + ["x" * 65279, "", "", "last"]
    path = _write(tmp_path / "a.gz", ("\n".join(lines) + ending).encode())
    for n in (1, 2, 3, 7, 50, 400):
        assert _ranges(path, n) == lines, n


def test_random_bytes_and_false_headers(tmp_path):
    rng = random.Random(1)
    body = bytearray(rng.randbytes(400_000).replace(b"\n", b"n").replace(b"\r", b"r"))
    for k in range(0, len(body) - 64, 5000):
        body[k : k + 18] = bgzf.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x10\0"
        body[k + 30 : k + 31] = b"\n"
    text = bytes(body)
    path = _write(tmp_path / "r.gz", text)
    for n in (1, 9, 60):
        import os

        size = os.path.getsize(path)
        got = b"".join(t for lo, hi in ((size * k // n, size * (k + 1) // n) for k in range(n)) for t in bgzf.text_of(path, lo, hi))
        assert got == text


def test_damage_is_told(tmp_path):
    path = _write(tmp_path / "d.gz", b"some text\n" * 20_000)
    raw = bytearray((tmp_path / "d.gz").read_bytes())
    raw[-40] ^= 1  # a checksum of the last member
    (tmp_path / "d.gz").write_bytes(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        list(bgzf.text_of(path, 0, len(raw)))


def test_lines_of_a_file(spark, tmp_path):
    text = "".join(f"{k}\tline {k % 97}\r\n" for k in range(60_000))
    path = _write(tmp_path / "l.txt.gz", text.encode())
    (tmp_path / "plain.gz").write_bytes(gzip.compress(text.encode()))
    df = bgzf.lines(spark, path, split=20_000)
    assert df.rdd.getNumPartitions() > 8
    assert sorted(r[0] for r in df.collect()) == sorted(text.split("\r\n")[:-1])
    assert bgzf.lines(spark, str(tmp_path / "plain.gz")) is None and not bgzf.is_blocked("viewfs://nowhere/x.gz")
    assert readers.text_lines(spark, str(tmp_path / "plain.gz")).count() == 60_000
    empty = _write(tmp_path / "e.gz", b"")
    assert bgzf.lines(spark, empty).count() == 0


HEAD = '##fileformat=VCFv4.2\n##source=GATK\n##FORMAT=<ID=GT,Number=1,Type=String,Description="x">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">\n'


def _vcf(n=9000, samples=3):
    rng = random.Random(2)
    out = [HEAD + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(samples)) + "\n"]
    rows = []
    for k in range(n):
        chrom, pos = str(1 + k * 5 // n), 100 + (k % (n // 5)) * 50
        rows.append((chrom, pos))
        out.append(f"{chrom}\t{pos}\tl{k}\tA\tC\t.\tPASS\tXX={rng.random()}\tGT:DP\t" + "\t".join(f"{rng.choice(['0/0', '0/1', '1/1', './.'])}:{rng.randrange(90)}" for _ in range(samples)) + "\n")
    return "".join(out).encode(), rows


def test_same_rows_as_plain_text(spark, tmp_path):
    text, _ = _vcf(2000)
    (tmp_path / "p.vcf").write_bytes(text)
    path = _write(tmp_path / "p.vcf.gz", text)
    a, b = (readers.read_vcf(spark, p).drop("VARIANT_ID") for p in (str(tmp_path / "p.vcf"), path))
    assert a.count() == 6000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert readers.vcf_info(spark, path) == readers.vcf_info(spark, str(tmp_path / "p.vcf"))


def test_regions(spark, tmp_path):
    text, rows = _vcf()
    path = _write(tmp_path / "i.vcf.gz", text)
    index = str(tmp_path / "i.regions")
    bgzf.write_index(spark, path, index, chunk=8000, split=50_000)
    assert bgzf.has_index(spark, index) and not readers.detect_indexing(spark, path)
    stored = [tuple(r) for r in bgzf.read_index(spark, index).select("path", "lo", "hi", "CHROM", "first", "last").collect()]
    for chrom, first, last in (("2", 1000, 4000), ("4", None, 300), ("5", 90_000, None), ("3", None, None), ("9", None, None), ("2", 10**8, None)):
        region = chrom + (f":{first or 0}" + (f"-{last}" if last else "") if first or last else "")
        want = {(c, p) for c, p in rows if c == chrom and p >= (first or 0) and p <= (last or 10**9)}
        for at in (index, None):  # by its blocks, and by a look at all lines
            got = readers.vcf_lines(spark, path, region, at).selectExpr("split(value, '\t')[0] AS c", "cast(split(value, '\t')[1] AS long) AS p").collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    g = readers.read_vcf(spark, path, region="2:1000-4000", index=index)
    assert g.count() == 3 * 61 and g.select("CHROM").distinct().count() == 1

    # the plan reads the region's blocks alone: bytes are counted as they are fetched
    chunks = "\n".join("\t".join(map(str, r)) for r in stored)
    reader = bgzf.BlockReader({"paths": path, "chunks": chunks, "placed": "true"})
    asked = [bgzf.EqualTo(("CHROM",), "2"), bgzf.GreaterThanOrEqual(("POS",), 1000), bgzf.LessThanOrEqual(("POS",), 4000)]
    assert list(reader.pushFilters(asked)) == asked
    lines = [pa.Table.from_batches([b]) for p in reader.partitions() for b in reader.read(p)]
    size = (tmp_path / "i.vcf.gz").stat().st_size
    assert sum(t.num_rows for t in lines) < 0.1 * len(rows) and 0 < reader.read_bytes < 0.35 * size
    whole = bgzf.BlockReader({"paths": path, "chunks": chunks, "placed": "true"})
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == len(rows)


def test_filters_on_the_frame_choose_blocks(spark, tmp_path):
    text, rows = _vcf()
    path = _write(tmp_path / "f.vcf.gz", text)
    index = readers.index_vcf(spark, path)
    assert readers.detect_indexing(spark, path)
    x = bgzf.region_lines(spark, path, index)
    assert x.count() == len(rows)
    some = x.filter("CHROM IN ('1', '5') AND POS > 500 AND POS < 700")
    assert sorted((r["CHROM"], r["POS"]) for r in some.collect()) == sorted((c, p) for c, p in rows if c in ("1", "5") and 500 < p < 700)


def test_likelihoods_of_several_alleles(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n##source=GATK\n##contig=<ID=1>\n" + "".join(f'##FORMAT=<ID={i},Number={n},Type={t},Description="x">\n' for i, n, t in (("GT", "1", "Integer"), ("AD", ".", "Integer"), ("DP", "1", "Integer"), ("GQ", "1", "Integer"), ("PL", "3", "Integer")))
    body = [
        ("1", "10", "A", "C,G,T", "GT:AD:DP:GQ:PL", "1/2:1,20,30,4:55:99:0,1,2,10,11,12,20,21,22,23", "./.:.:.:.:.", "3:1,2,3,9:15:9:5,6,7,8"),
        ("1", "20", "A", "C", "GT:PL", "0/1:30,0,40", "1/1:9,8,.", "0/0"),
    ]
    text = head + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n" + "".join("\t".join((c, p, ".", r, a, ".", "PASS", ".", f, *calls)) + "\n" for c, p, r, a, f, *calls in body)
    (tmp_path / "m.vcf").write_text(text)
    path = str(tmp_path / "m.vcf")
    fields = readers.vcf_header(spark, path)["fields"]
    assert fields["PL"] == {"Number": "G", "Type": "Integer", "declared_number": "3", "declared_type": "Integer"} and fields["GT"]["Type"] == "String" and fields["AD"]["Number"] == "R"
    cols = ["POS", "ALT", "INDIVIDUALS", "GT_BIN", "PL_HOM_REF", "PL_HET", "PL_HOM_ALT", "ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH"]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in readers.read_vcf(spark, path, multiallelic="split").select(*cols).collect()}
    assert len(got) == 12
    assert got["10", "C", "s1"] == (1, 0.0, 1.0, 2.0, 1, 20)
    assert got["10", "G", "s1"] == (1, 0.0, 10.0, 12.0, 1, 30)
    assert got["10", "T", "s1"] == (0, 0.0, 20.0, 23.0, 1, 4)
    assert got["10", "G", "s2"] == (None, None, None, None, None, None)
    assert got["10", "T", "s3"][1:] == (5.0, None, 8.0, 1, 9)  # a haploid call
    assert got["20", "C", "s1"] == (1, 30.0, 0.0, 40.0, None, None) and got["20", "C", "s2"][1:4] == (9.0, 8.0, None) and got["20", "C", "s3"][1:4] == (None, None, None)
    kept = {tuple(r)[:3]: tuple(r)[3:] for r in readers.read_vcf(spark, path).select(*cols).collect()}
    assert kept["10", "C,G,T", "s1"][1:] == (0.0, 1.0, 2.0, 1, 54) and kept["20", "C", "s1"] == got["20", "C", "s1"]


def test_first_fields():
    for text in (b"a\tb\tc\nd\n\n\te\tf", b"", b"x", b"a\tb\n"):
        for n in (1, 2, 3):
            want = [b"\t".join(x.split(b"\t")[:n]) for x in text.split(b"\n")]
            assert bgzf.first_fields(text, n).split(b"\n")[:-1] == (want if text and not text.endswith(b"\n") else want[:-1])
