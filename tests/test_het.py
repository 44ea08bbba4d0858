"""Threshold tables of heterozygosity against a filter for each threshold."""

import random

import pytest

from snpweave.operators import het

SCHEMA = "CHROM string, LOCUS string, MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int"


def _grid(spark):
    rng, rows = random.Random(8), []
    for k in range(30):
        for snp in range(1 + k % 3):
            p = rng.random()
            for s in range(36):
                lost = (k % 7 == 0 and s % 4 == 0) or rng.random() < 0.1
                rows.append((str(k % 2), f"l{k // 2}", f"m{k}_{snp}", f"s{s}", f"p{s % 4}", None if lost else rng.choice((1, 0)) if rng.random() < p else 0))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _units(rows, approach):
    h, strata = {}, sorted({r[4] for r in rows})
    for c, loc, m, _, p, x in rows:
        for q in (p, "OVERALL"):
            if x is not None:
                h.setdefault(((c, loc) if approach == "haplotype" else (m,), q), {}).setdefault(m, []).append(x == 1)
    out = {k: [sum(v) / len(v) for v in snps.values()] for k, snps in h.items()}
    return out, {k for k, _ in out}, strata


@pytest.mark.parametrize("approach", ["haplotype", "SNP"])
def test_tables(spark, approach):
    rows, g = _grid(spark)
    values, units, strata = _units(rows, approach)
    s = het.summary(g, approach)
    for r in s.collect():
        v = values[(r["CHROM"], r["LOCUS"]) if approach == "haplotype" else (r["MARKERS"],), r["STRATA"]]
        assert (r["HET_MEAN"], r["HET_MIN"], r["HET_MAX"], r["HET_DIF"]) == pytest.approx((sum(v) / len(v), min(v), max(v), max(v) - min(v)), abs=1e-8)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in het.threshold_table(s, len(strata)).collect()}
    n = 0
    for t in (*het.LEVELS, None):
        for d in (*het.STEPS, None) if approach == "haplotype" else (None,):
            if t is None and d is None:
                continue
            fits = lambda v, t=t, d=d: v is not None and (t is None or round(max(v), 9) <= t) and (d is None or round(max(v) - min(v), 9) <= d)
            bad = {u: sum(not fits(values.get((u, p))) for p in strata) for u in units}
            for o in range(len(strata) + 1):
                n += 1
                white = sum(b <= o for b in bad.values())
                assert got["STRATA", t, d, o] == (white, len(units) - white)
            white = sum(fits(values.get((u, "OVERALL"))) for u in units)
            n += 1
            assert got["OVERALL", t, d, 0] == (white, len(units) - white)
    assert len(got) == n


def test_blacklists(spark):
    rows, g = _grid(spark)
    values, units, strata = _units(rows, "haplotype")
    bad = {u: sum((u, p) in values and (max(values[u, p]) > 0.5 or max(values[u, p]) - min(values[u, p]) > 0.2) for p in strata) for u in units}
    got = {r["MARKERS"]: r["OUTLIERS"] for r in het.blacklist(g, "haplotype", "pop", 0.5, 0.2, 1).collect()}
    assert got == {m: bad[c, loc] for c, loc, m, *_ in rows if bad[c, loc] > 1} and got
    snp, _, _ = _units(rows, "SNP")
    assert {r["MARKERS"] for r in het.blacklist(g, "SNP", "overall", 0.4).collect()} == {k[0][0] for k, v in snp.items() if k[1] == "OVERALL" and v[0] > 0.4}
    with pytest.raises(ValueError):
        het.summary(g, "locus")
    assert het.threshold_table(het.summary(g.limit(0)), 3).count() == 0
    few = het.individuals(g, 0.1, 0.3).collect()
    assert 0 < len(few) < 36
