"""Closed forms and invariants of the genotype operators, and every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave import catalog
from snpweave.functions import names
from snpweave.model import Dataset
from snpweave.operators import filters, hwe, models, pairs, recode, stats
from snpweave.plans import cascade
from snpweave.streaming import counts

SF = "/root/testdata/sf0.001"
T = "MARKERS string, CHROM string, LOCUS string, POS string, COL int, REF string, ALT string, INDIVIDUALS string, STRATA string, GT_BIN int, READ_DEPTH long, ALLELE_REF_DEPTH long, ALLELE_ALT_DEPTH long"


def tidy(spark, calls):
    """calls: {marker: {sample: (stratum, dosage)}}"""
    return spark.createDataFrame([(m, "1", m, "1", 0, "A", "C", i, s, d, None if d is None else 8, None if d in (None, 2) else 6, None if d in (None, 0) else 2) for m, x in calls.items() for i, (s, d) in x.items()], T)


ONE = {"m": {"a": ("p", 0), "b": ("p", 1), "c": ("p", 2), "d": ("p", None)}}


def test_one_marker(spark):
    r = stats.marker_stats(tidy(spark, ONE)).first()
    assert (r["MAC_GLOBAL"], r["MAF_GLOBAL"], r["MISSING_PROP"]) == (3, 0.5, 0.25)
    assert r["HET_OBS"] == pytest.approx(1 / 3) and r["FIS"] == pytest.approx(1 - 1 / 1.5)


def test_five_numbers(spark):
    r = stats.tibble_stats(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double"), "v", "x").first()
    assert (r["Q25"], r["MEDIAN"], r["Q75"], r["IQR"], r["OUTLIERS_LOW"], r["OUTLIERS_HIGH"]) == (1.75, 3.0, 5.0, 3.25, 1.0, 8.0)


def test_private_and_pi(spark):
    g = tidy(spark, {"m": {"a": ("A", 1), "b": ("B", 0)}})
    assert [tuple(r) for r in stats.private_alleles(stats.alleles(g)).collect()] == [("A", "m", "C")]
    assert stats.pi_markers(tidy(spark, {"m": {"a": ("p", 1)}}), 100).first()["PI"] == 0.0025


def test_similarity(spark):
    g = tidy(spark, {f"m{k}": {"a": ("p", x), "b": ("p", y)} for k, (x, y) in enumerate([(0, 0), (1, 2), (2, 2), (None, 1)])})
    r = pairs.genome_similarity(g).first()
    assert (r["MARKERS_COMMON"], r["IDENTICAL"], round(r["IDENTICAL_PROP"], 6)) == (3, 2, 0.666667)


def test_hwe_exact(spark):
    # 3 alternate copies among 10 samples: one or three heterozygotes, by counting arrangements
    from math import comb, factorial

    ways = {h: 2**h * factorial(10) / (factorial(h) * factorial((3 - h) // 2) * factorial(10 - h - (3 - h) // 2)) for h in (1, 3)}
    p = {h: w / comb(20, 3) for h, w in ways.items()}
    assert sum(p.values()) == pytest.approx(1)
    got = {tuple(r)[:3]: r["MID_P_VALUE"] for r in hwe.mid_p(spark.createDataFrame([(8, 1, 1), (7, 3, 0)], "AA long, AB long, BB long")).collect()}
    assert got[(8, 1, 1)] == pytest.approx(p[1] / 2, abs=1e-8) and got[(7, 3, 0)] == pytest.approx(p[1] + p[3] / 2, abs=1e-8)


def test_recode_round_trip(spark):
    g = recode.gt_recoding(tidy(spark, ONE))
    assert [tuple(r) for r in g.select("GT_VCF", "GT_VCF_NUC", "GT").filter("INDIVIDUALS = 'b'").collect()] == [("0/1", "A/C", "001002")]
    for c in ("GT_VCF", "GT_VCF_NUC"):
        back = recode.gt_recoding(g.select("MARKERS", "INDIVIDUALS", "REF", "ALT", c))
        assert sorted(map(str, back.select("INDIVIDUALS", "GT_BIN").collect())) == sorted(map(str, g.select("INDIVIDUALS", "GT_BIN").collect()))
    assert names.snake_upper("CloneID rep.avg") == "CLONE_ID_REP_AVG"


def test_outlier_rule_and_blank(spark):
    s = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([1, 1, 1, 1, 9])], "MARKERS string, MISSING_PROP double")
    assert [r[0] for r in filters.genotyping(s, "outliers").collect()] == ["0", "1", "2", "3", "4"]  # the bound 1 is not the extreme, so it is inclusive
    g = tidy(spark, ONE)
    assert filters.blank(g, g.filter("INDIVIDUALS = 'a'")).filter("GT_BIN is null").count() == 2


def test_cascade_adds_up(spark):
    from snpweave import adapter

    ds = cascade.run(Dataset.from_tidy(adapter.tidy(spark, SF)), cascade.steps(genotyping=0.1, ma=3, short_ld="mac"))
    assert ds.markers.count() == 200 and len(ds.ledger) == 5
    white = ds.markers.filter("FILTERS = 'whitelist'").count()
    assert ds.ledger[-1]["AFTER"].split(" / ")[-1] == str(white) and cascade.ledger(spark, ds).count() == 5
    with pytest.raises(ValueError):
        cascade.READ_OPTIONS.resolve({"nope": 1})


def test_stream(spark, tmp_path):
    tidy(spark, ONE).select("MARKERS", "INDIVIDUALS", "STRATA", "GT_BIN").write.parquet(str(tmp_path / "in"))
    q = counts.marker_counts(counts.genotype_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("live").collect()] == [("m", 1, 1, 1, 3, 4)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def show(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 7) + 0.0) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", ["marker_stats", "summarise_genotypes", "betas_estimator", "hwe_analysis", "ld_pruning", "filter_rad", "filter_ledger", "write_vcf", "merge_dart", "distance_individuals__ibs"])
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(catalog.ORACLES[name])
    head = [d[0] for d in rel.description]
    assert sorted(head) == cols
    want = sorted(tuple(show(r[head.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_catalog_is_complete():
    assert len(catalog.QUERIES) > 180 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_closure_of_long_chains(spark):
    import random

    names = [f"n{i:04d}" for i in range(400)]
    mixed = names[1:]
    random.Random(5).shuffle(mixed)
    chain = [*mixed[:200], names[0], *mixed[200:]]
    e = list(zip(chain, chain[1:])) + [(f"q{i:03d}", f"q{i + 1:03d}") for i in range(60)] + [("z", "z")]
    got = dict(map(tuple, pairs.closure(spark.createDataFrame(e, "a string, b string"), "a", "b").collect()))
    assert got == {n: "n0000" for n in names} | {f"q{i:03d}": "q000" for i in range(61)} | {"z": "z"}
    ld = spark.createDataFrame([(a, b, 0.9) for a, b in e[:399]], "MARKERS_A string, MARKERS_B string, LD double")
    miss = spark.createDataFrame([(n, 0.1) for n in names], "MARKERS string, MISSING_PROP double")
    assert [r["MARKERS"] for r in pairs.ld_pruning(ld, miss).filter("KEEP").collect()] == ["n0000"]
    assert pairs.closure(ld.limit(0), "MARKERS_A", "MARKERS_B").count() == 0


def test_pair_blocks(spark, monkeypatch):
    from snpweave import adapter

    g = adapter.tidy(spark, SF)
    one = sorted(map(tuple, pairs.pair_counts(g).collect()))
    monkeypatch.setattr(pairs, "BLOCK", 3)
    assert sorted(map(tuple, pairs.pair_counts(g).collect())) == one and len(one) == 45


def test_models(spark):
    import numpy as np

    from snpweave import adapter
    from snpweave.operators import models

    g = adapter.tidy(spark, SF)
    a, b = (models.estimate_m(g, reps=20).collect() for _ in range(2))
    assert a == b and all(0 <= r["M"] <= 1 for r in a)
    assert models.simulate_genotypes(g, 0.0).filter("GT_BIN = 1").count() == g.filter("GT_BIN = 1").count()
    x = np.linspace(0, 1, 200)
    assert np.allclose(models.quantile_fit(x, 1 + 2 * x, 0.3), (1, 2), atol=1e-6)
    w = models.local_pca(g, 20).collect()
    assert len(w) == 10 and all(r["N_SNP"] == 20 and abs(sum(r["VALUES"]) - 1) < 1e-9 and len(r["AXES"]) == 2 * 8 * 10 for r in w)


def test_models_use_all_rows(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from snpweave import adapter
    from snpweave.operators import models

    # 60,000 rows: the line must be that of all of them
    s = spark.range(60_000).select((F.col("id") % 97 / 10.0).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 38) + F.col("id") % 97 / 30.0).alias("y"))
    got = models.quantile_residuals(s, "x", "y").toPandas()
    a, b = models.quantile_fit(got["x"].to_numpy(), got["y"].to_numpy(), 0.3)
    off = np.abs(got["QR_RESIDUALS"] - (got["y"] - a - b * got["x"])).max()
    assert off < 5e-4, off  # the rounds end a little before the last digits settle
    g = adapter.tidy(spark, SF)
    whole = models.estimate_m(g, reps=6).collect()
    monkeypatch.setattr(models, "MAX_COUNTS", 20)
    assert models.distinct_counts(g).count() > 20
    one, two = (models.estimate_m(g, reps=6).collect() for _ in range(2))
    assert one == two and len(one) == len(whole) == 6 and all(0 <= r["M"] <= 1 for r in one) and len({r["M"] for r in one}) > 1


def test_run_control(tmp_path):
    from snpweave.plans import run

    p = run.make_folder("step", str(tmp_path), date=False)
    assert p.endswith("01_step") and run.folder_prefix(str(tmp_path)) == 2
    assert run.file_name("x", "tsv", "/d", date=False) == "/d/x.tsv" and run.cores(9, 5) % 2 == 0
    assert cascade.choose_markers_subsample(1000, 10) == 1.0 and cascade.choose_markers_subsample(3_000_000, 9000) < 0.3


def pair_cov(y):
    """Covariance of rows, pair by pair over the columns that both have."""
    out = np.zeros((len(y), len(y)))
    for i in range(len(y)):
        for j in range(i, len(y)):
            m = ~np.isnan(y[i]) & ~np.isnan(y[j])
            if m.sum() > 1:
                out[i, j] = out[j, i] = ((y[i, m] - y[i, m].mean()) * (y[j, m] - y[j, m].mean())).sum() / (m.sum() - 1)
    return out


def test_inversions_against_dense_scaling(spark):
    """Windows by windows in numpy: distances, classical scaling, outliers, clusters, r2."""
    rng = np.random.default_rng(3)
    n, size, k = 24, 12, 2
    x = rng.binomial(2, rng.uniform(0.1, 0.9, 12 * size), (n, 12 * size)).astype(float)
    kind = rng.integers(0, 3, n)
    turned = np.arange(size) % 2  # either allele may be the reference
    x[:, 4 * size : 5 * size] = np.where(turned, 2 - kind[:, None], kind[:, None])  # an inversion: three kinds of samples
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = [(f"m{j:03d}", str(j // (6 * size)), str(10 * j), f"i{i:02d}", "p", None if np.isnan(x[i, j]) else int(x[i, j])) for i in range(n) for j in range(x.shape[1])]
    g = spark.createDataFrame(rows + [("z", "0", "99999", "i00", "p", 1)], "MARKERS string, CHROM string, POS string, INDIVIDUALS string, STRATA string, GT_BIN int")
    mats = []
    for w in range(12):
        y = x[:, w * size : (w + 1) * size]
        c = pair_cov(y - np.nanmean(y, axis=0))
        val, vec = np.linalg.eigh(c)
        val, vec = val[::-1][:k], vec[:, ::-1][:, :k]
        mats.append((vec * (val / np.abs(val).sum())) @ vec.T)
    d2 = np.array([[((a - b) ** 2).sum() for b in mats] for a in mats])
    centre = np.eye(12) - 1 / 12
    val, vec = np.linalg.eigh(-centre @ d2 @ centre / 2)
    want = np.sqrt((vec[:, ::-1][:, :k] ** 2 * val[::-1][:k]).sum(axis=1))
    got = {int(r["CHROM"]) * 6 + r["WINDOW"]: r["LS_DIST"] for r in models.window_scaling(models.local_pca(g, size, k), k).collect()}
    assert sorted(got) == list(range(12))
    assert np.allclose([got[w] for w in range(12)], want, rtol=1e-6, atol=1e-9), (got, want)
    found = models.inversions(g, size, k, 0.95).collect()
    assert {(r["CHROM"], r["WINDOW"]) for r in found} == {("0", 4)}
    sizes = np.bincount(kind)
    assert sorted(r["N_IND"] for r in found) == sorted(sizes.tolist()) and found[0]["LD_MEAN"] > 0.8
    het = {r["N_IND"]: r["MEAN_HET"] for r in found}
    assert het[sizes[1]] > 0.99 or sizes[1] in (sizes[0], sizes[2])


def test_kmeans_on_a_line():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=8)
        own = models.kmeans_line(x, 3)
        cost = lambda lab: sum(((x[lab == c] - x[lab == c].mean()) ** 2).sum() for c in set(lab))
        assert np.isclose(cost(own), min(cost(np.array(lab)) for lab in itertools.product(range(3), repeat=8)))


def test_chain_against_grid(spark):
    """The chain's mean of m against the posterior on a grid of m and allele frequencies."""
    rng = np.random.default_rng(7)
    m, rows = 0.25, []
    for j in range(60):
        p = rng.uniform(0.2, 0.8)
        het = rng.random(80) < 2 * p * (1 - p)
        hom = np.where(rng.random(80) < p * p / (p * p + (1 - p) ** 2), 0, 2)
        x = np.where(het, np.where(rng.random(80) < m, rng.choice([0, 2], 80), 1), hom)
        rows += [(f"m{j}", f"i{i}", int(v)) for i, v in enumerate(x)]
    g = spark.createDataFrame(rows, "MARKERS string, INDIVIDUALS string, GT_BIN int")
    c = stats.genotype_counts(g, "MARKERS").select("N0", "N1", "N2").toPandas().to_numpy(float)
    ms, ps = np.linspace(0.005, 0.995, 100), np.linspace(0.005, 0.995, 100)
    h = 2 * ps * (1 - ps)
    post = np.zeros(len(ms))
    for a, t in enumerate(ms):
        f = np.log(np.stack([ps**2 + h * t / 2, h * (1 - t), (1 - ps) ** 2 + h * t / 2]))
        each = c @ f - 0.5 * np.log(ps * (1 - ps))
        top = each.max(axis=1)
        post[a] = (top + np.log(np.exp(each - top[:, None]).sum(axis=1))).sum()
    w = np.exp(post - post.max())
    want = (w * ms).sum() / w.sum()
    chain = [r["M"] for r in models.estimate_m(g, reps=3000, seed=4).orderBy("ITERATION").collect()][500:]
    assert abs(np.mean(chain) - want) < 0.02, (np.mean(chain), want)


def test_linkage_by_slices_and_window(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 3, (30, 40))
    rows = [(f"m{j:02d}", str(j % 2), str(j * 10), f"i{i}", "p", None if x[i, j] < 0 else int(x[i, j])) for i in range(30) for j in range(40)]
    g = spark.createDataFrame(rows, "MARKERS string, CHROM string, POS string, INDIVIDUALS string, STRATA string, GT_BIN int")
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = (x[:, a] >= 0) & (x[:, b] >= 0)
            if a % 2 == b % 2 and both.sum() > 1 and x[both, a].std() and x[both, b].std():
                want[f"m{a:02d}", f"m{b:02d}"] = np.corrcoef(x[both, a], x[both, b])[0, 1] ** 2
    for block, size in ((256, 8192), (5, 7)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "SLICE", size)
        got = {(r[0], r[1]): r[2] for r in pairs.linkage(g).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        near = {(r[0], r[1]) for r in pairs.linkage(g, window=60).collect()}
        assert near == {k for k in want if 10 * (int(k[1][1:]) - int(k[0][1:])) <= 60}
        high = {(r[0], r[1]) for r in pairs.linkage(g, least=0.1).collect()}
        assert high == {k for k in got if got[k] >= 0.1}
        counts_ = {(r["ID1"], r["ID2"]): (r["COMMON"], r["IDENTICAL"], r["ABSDIFF"]) for r in pairs.pair_counts(g).collect()}
        for (p, q), v in counts_.items():
            i, j = int(p[1:]), int(q[1:])
            both = (x[i] >= 0) & (x[j] >= 0)
            assert v == (both.sum(), (x[i][both] == x[j][both]).sum(), np.abs(x[i][both] - x[j][both]).sum())
        assert len(counts_) == 30 * 29 // 2


def test_numbers_and_tiles(spark):
    import random

    from snpweave.operators import order

    n = 1003
    x = spark.createDataFrame(random.Random(2).sample([(f"k{i:05d}",) for i in range(n)], n), "k string").repartition(7)
    got = order.numbered(x, "i", "k").collect()
    assert {r["k"]: r["i"] for r in got} == {f"k{i:05d}": i + 1 for i in range(n)}
    for size, tiles in ((10, 3), (3, 5), (12, 4)):
        rows = duckdb.sql(f"SELECT i, ntile({tiles}) OVER (ORDER BY i) AS t FROM range(1, {size + 1}) r(i)").fetchall()
        got = spark.range(1, size + 1).select("id", order.tile(F.col("id"), size, tiles)).collect()
        assert sorted(map(tuple, got)) == sorted(rows)
