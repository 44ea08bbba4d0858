"""Markers with any number of alleles."""

import random
from collections import Counter
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from snpweave import catalog
from snpweave.functions import genotypes as gt
from snpweave.operators import alleles, stats

SF = "/root/testdata/sf0.001"
SCHEMA = "MARKERS string, INDIVIDUALS string, STRATA string, REF string, ALT string, GT_VCF_NUC string, AD array<long>"


def _calls(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _random(n=12, samples=30, seed=3):
    rng, rows = random.Random(seed), []
    for m in range(n):
        al = ["".join(rng.choice("ACGT") for _ in range(6)) for _ in range(2 + m % 3)]
        for s in range(samples):
            x, y = sorted(rng.choices(range(len(al)), [5, 3, 2, 1][: len(al)], k=2))
            call = "./." if rng.random() < 0.1 else f"{al[x]}{rng.choice('/|')}{al[y]}"
            rows.append((f"m{m}", f"s{s}", f"p{s % 3}", al[0], ",".join(al[1:]), call, [rng.randrange(9) for _ in al]))
    return rows


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACGA", 1), ("A", "A", 0), ("AC", "ACGT", 2), ("", "A", 1), ("AAAA", "CCCC", 4)], "a string, b string, d int")
    assert all(r["d"] == r["h"] for r in df.withColumn("h", alleles.hamming(F.col("a"), F.col("b"))).collect())


def test_pi_equals_a_plain_program(spark):
    rows = _random()
    count, own = {}, {}
    for m, s, p, _, _, call, _ in rows:
        if call != "./.":
            a = call.replace("|", "/").split("/")
            own.setdefault((s, p), []).append(sum(x != y for x, y in zip(*a, strict=True)) / 50)
            for x in a:
                for k in ((m, p), (m, None)):
                    count.setdefault(k, {}).setdefault(x, 0)
                    count[k][x] += 1
    pi = {}
    for k, c in count.items():
        n, names = sum(c.values()), sorted(c)
        pi[k] = sum(c[a] / n * c[b] / n * sum(x != y for x, y in zip(a, b, strict=True)) for i, a in enumerate(names) for b in names[i + 1 :]) / 50
    g = _calls(spark, rows)
    got = {(r["MARKERS"], r["STRATA"]): r["PI"] for r in alleles.pi_markers(g, 50, "STRATA").collect()}
    assert got == pytest.approx({k: v for k, v in pi.items() if k[1]})
    assert {(r["MARKERS"], None): r["PI"] for r in alleles.pi_markers(g, 50).collect()} == pytest.approx({k: v for k, v in pi.items() if not k[1]})
    assert {(r["INDIVIDUALS"], r["STRATA"]): r["PI"] for r in alleles.pi_individuals(g, 50).collect()} == pytest.approx({k: sum(v) / len(v) for k, v in own.items()})
    means = {r["STRATA"]: r["PI"] for r in alleles.pi_pop(g, 50).collect()}
    assert means["OVERALL"] == pytest.approx(sum(v for k, v in pi.items() if not k[1]) / 12)


def test_two_alleles_agree_with_the_dosage_path(spark):
    rng = random.Random(9)
    rows = [(f"m{m}", f"s{s}", f"p{s % 3}", "A", "C", rng.choice([0, 0, 1, 2, None]) if m else 0, 9, rng.randrange(9), rng.randrange(9)) for m in range(8) for s in range(25)]
    g = spark.createDataFrame(rows, "MARKERS string, INDIVIDUALS string, STRATA string, REF string, ALT string, GT_BIN int, READ_DEPTH long, ALLELE_REF_DEPTH long, ALLELE_ALT_DEPTH long")
    w = g.withColumn("GT_VCF_NUC", gt.nuc_from_bin(F.col("GT_BIN"), F.col("REF"), F.col("ALT"))).withColumn("AD", F.array("ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH"))
    two = {r["MARKERS"]: r for r in stats.minor_alleles(g).collect()}
    for r in alleles.minor_alleles(w, "depth").collect():
        t = two[r["MARKERS"]]
        assert (r["MAC_GLOBAL"], r["MAC_GLOBAL_CORR"], r["MAD_GLOBAL_CORR"]) == (t["ALT_COUNT"], t["MAC_GLOBAL_CORR"], t["MAD_GLOBAL_CORR"])
        assert r["MAF_GLOBAL_COUNT_CORR"] == t["MAF_GLOBAL_COUNT_CORR"] and r["MAF_GLOBAL_DEPTH_CORR"] == t["MAF_GLOBAL_DEPTH_CORR"]
    minor = {(r["MARKERS"], r["STRATA"]): (r["MAF_LOCAL"], r["MAF_GLOBAL"]) for r in stats.maf(g).collect()}
    got = {}
    for r in alleles.maf(w).filter("REF <> 'REF'").collect():
        got[r["MARKERS"], r["STRATA"]] = (r["MAF_LOCAL"], r["MAF_GLOBAL"])
    tied = {r["MARKERS"] for r in stats.minor_alleles(g).filter("REF_COUNT = ALT_COUNT").collect()}
    assert got and all(minor[k] == pytest.approx(v) for k, v in got.items() if k[0] not in tied)
    pi = {r["MARKERS"]: r["PI"] for r in stats.pi_markers(g, 90).collect()}
    assert {r["MARKERS"]: r["PI"] for r in alleles.pi_markers(w, 90).collect()} == pytest.approx(pi)


def test_roles(spark):
    rows = [("m", f"s{k}", "p", "A", "C,G", c, d) for k, (c, d) in enumerate([("C/C", [0, 1, 9]), ("A/C", [2, 2, 9]), ("G|G", [0, 0, 9]), ("A/A", None), ("./.", None)])]
    rows += [("t", "s1", "p", "T", "A", "T/A", [1, 1]), ("u", "s1", "p", "T", "A", "G/A", [1, 1])]
    g = _calls(spark, rows)
    got = {r["MARKERS"]: tuple(r)[1:] for r in alleles.roles(g).collect()}
    assert got["m"] == ("A", "C,G", False) and got["t"] == ("T", "A", False)  # three copies each: a tie leaves the reference
    assert {r["MARKERS"]: tuple(r)[1:] for r in alleles.roles(g, "depth").collect()}["m"] == ("G", "A,C", True)
    old = spark.createDataFrame([("m", "C"), ("m", "C"), ("t", "X")], "MARKERS string, ANCESTRAL string")
    anc = {r["MARKERS"]: tuple(r)[1:] for r in alleles.roles(g, "ancestral", old).collect()}
    assert anc["m"] == ("C", "A,G", True) and anc["t"] == ("T", "A", False)
    assert {r["MARKERS"]: (r["ALLELES"], r["COUNTS"]) for r in alleles.dictionary(g).collect()}["u"] == (["T", "A", "G"], [0, 1, 1])  # called, not declared
    new = {r["INDIVIDUALS"]: r for r in alleles.recalibrate(g.filter("MARKERS = 'm'"), "depth").collect()}
    assert (new["s0"]["REF"], new["s0"]["ALT"], new["s0"]["GT_BIN"], new["s0"]["AD"]) == ("G", "A,C", 2, [9, 0, 1]) and new["s2"]["GT_BIN"] == 0 and new["s4"]["GT_BIN"] is None and new["s3"]["AD"] is None
    role = {r["HAPLOTYPES"]: r["REF"] for r in alleles.maf(_calls(spark, [("m", f"s{k}", "p", "A", "C,G,T", c, None) for k, c in enumerate(["A/A", "A/C", "C/G", "G/T", "G/C"])])).collect()}
    assert role == {"A": "REF", "C": "ALT", "G": "ALT", "T": "MAF"}


def test_filters_and_no_declared_alleles(spark):
    rows = _random()
    g = _calls(spark, rows + [("mono", "s0", "p", "A", "C", "C/C", [0, 4])])
    why = {r["MARKERS"]: r["FILTERS"] for r in alleles.minor_alleles(g, biallelic=True).collect()}
    assert why["mono"] == "monomorphic" and why["m0"] == "whitelist" and why["m1"] == "multi-allelic"
    bare = {r["MARKERS"]: r for r in alleles.dictionary(g.drop("REF", "ALT")).collect()}
    assert all(r["COUNTS"] == sorted(r["COUNTS"], reverse=True) for r in bare.values()) and bare["mono"]["ALLELES"] == ["C"]
    with pytest.raises(ValueError):
        alleles.minor_alleles(g, "mean")
    assert alleles.pi_pop(g.limit(0), 90).filter("STRATA <> 'OVERALL'").count() == 0


def test_pairs_of_alleles_in_their_marker(spark):
    calls = [("m", "p", "AC/AC"), ("m", "p", "AC|AGT"), ("m", "q", "TT/./."), ("m", "q", "TT/TT"), ("m", "q", "AGT/TT/TT"), ("n", "p", "A/."), ("n", "q", None), ("o", "p", "A/A")]
    g = spark.createDataFrame(calls, "MARKERS string, STRATA string, GT_VCF_NUC string")
    apart = lambda a, b: sum(x != y for x, y in zip_longest(a, b))
    want = {}
    for keys in ((), ("STRATA",)):
        n = Counter()
        for m, s, c in calls:
            a = (c or ".").replace("|", "/").split("/")
            n.update(() if "." in a else [((m, s)[: 1 + len(keys)], x) for x in a])
        for at in {k for k, _ in n}:
            own = {x: v for (k, x), v in n.items() if k == at}
            want[at] = sum(own[a] * own[b] * apart(a, b) for a in own for b in own if a < b) / sum(own.values()) ** 2 / 10
        got = alleles.pi_markers(g, 10, *keys)
        assert {tuple(r[c] for c in ("MARKERS", *keys)): pytest.approx(r["PI"], abs=1e-15) for r in got.collect()} == {k: v for k, v in want.items() if len(k) == 1 + len(keys)}
        assert {(*(r[c] for c in ("MARKERS", *keys)), r["ALLELES"]): r["N"] for r in alleles.allele_table(g, *keys).collect() if r["N"]} == {(*k, x): v for (k, x), v in n.items()}


@pytest.mark.parametrize("name", ["pi_rad", "compute_maf", "calibrate_alleles", "calibrate_alleles_depth", "pi_pop"])
def test_haplotypes_are_dealt_once(spark, name):
    """The items go to their markers as narrow rows; nothing of a size with the cells is dealt again, and no lambda is given a cell's call."""
    q = catalog.QUERIES[{"calibrate_alleles": "calibrate_alleles__haplotypes_count", "calibrate_alleles_depth": "calibrate_alleles__haplotypes_depth"}.get(name, f"{name}__haplotypes")]
    plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "hashpartitioning(STRATA" not in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)
    assert not any("GT_VCF_NUC" in x and "exists(" in x for x in plan.split("\n"))
