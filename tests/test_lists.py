"""Lists of samples and genotypes, strata from file heads, and what is left behind."""

import os
import subprocess
import sys
from pathlib import Path

from snpweave.functions import names
from snpweave.operators import detect, strata
from snpweave.plans import cascade
from snpweave.sources import readers

ROOT = Path(__file__).resolve().parent.parent


def test_strata_of_a_haplotype_file(spark, tmp_path):
    path = tmp_path / "h.tsv"
    path.write_text("Catalog ID\tCnt\tQUE-01\tONT_2\tplain\n1\t3\tA/C\tA\tC\n")
    assert {tuple(r) for r in strata.strata_haplo(spark, str(path)).collect()} == {("QUE-01", "QUE"), ("ONT_2", "ONT"), ("plain", "plain")}


def test_blacklists(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("MARKERS\tINDIVIDUALS\n1__l__5\ta b\n1__l__5\ta b\n2__l__9\tc\n")
    got = {(r["MARKERS"], r["INDIVIDUALS"]) for r in readers.read_blacklist_genotypes(spark, str(tmp_path / "g.tsv")).collect()}
    assert got == {("1__l__5", names.clean_ind("a b")), ("2__l__9", "c")}
    (tmp_path / "i.tsv").write_text("INDIVIDUALS\na b\nc\nc\n")
    assert {r[0] for r in readers.read_blacklist_id(spark, str(tmp_path / "i.tsv")).collect()} == {names.clean_ind("a b"), "c"}


def test_all_markers_are_in_the_presence_matrix(spark):
    g = spark.createDataFrame([(f"m{k}", f"s{s}", "p", None if (k + s) % 3 == 0 else 1) for k in range(40) for s in range(4)], "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int")
    assert detect.missingness(g).count() == 160 and detect.missingness(g, 10).select("MARKERS").distinct().count() == 10


def test_long_linkage_by_window_in_the_cascade(spark):
    rows = [("1", str(10 * k), "l", f"m{k}", f"s{s}", "p", "A", "C", (s + k // 3) % 3) for k in range(9) for s in range(12)]
    g = spark.createDataFrame(rows, "CHROM string, POS string, LOCUS string, MARKERS string, INDIVIDUALS string, STRATA string, REF string, ALT string, GT_BIN int")
    step = next(s for s in cascade.steps(monomorphic=False, common=False, long_ld=0.9, ld_method="corr", ld_window=15) if s.name == "filter.long.ld")
    # three equal markers in a row; the window reaches one neighbour, so the third of each three stays
    assert {r["MARKERS"] for r in step.bad(g).collect()} == {"m1", "m4", "m7"}


def test_checkpoints_go_with_the_application(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from snpweave.operators import order
print(order.numbered(s.range(50), "n", "id").count())
import os
print(sum(len(f) for _, _, f in os.walk({str(tmp_path / "shared")!r})) > 0)
s.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ)
    assert out.stdout.split() == ["50", "True"], out.stderr[-500:]
    assert not [f for _, _, names_ in os.walk(tmp_path / "shared") for f in names_]
