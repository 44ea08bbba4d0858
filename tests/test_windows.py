"""Local axes and the scaling of windows, against dense computations and at real numbers of samples."""

import resource

import numpy as np
import pytest

from snpweave import adapter
from snpweave.operators import models

FIELDS = "CHROM string, WINDOW long, START long, END long, N_SNP long, VALUES array<double>, AXES binary"


def pair_cov(y):
    """Covariance of rows, pair by pair over the columns that both have."""
    out = np.zeros((len(y), len(y)))
    for i in range(len(y)):
        for j in range(i, len(y)):
            m = ~np.isnan(y[i]) & ~np.isnan(y[j])
            if m.sum() > 1:
                out[i, j] = out[j, i] = ((y[i, m] - y[i, m].mean()) * (y[j, m] - y[j, m].mean())).sum() / (m.sum() - 1)
    return out


def _windows(rng, count, n, k, kinds):
    """Low-rank covariances near a few kinds."""
    base = [np.linalg.qr(rng.normal(size=(n, k)))[0] for _ in range(kinds)]
    out = []
    for w in range(count):
        q = np.linalg.qr(base[w % kinds] + 0.02 * rng.normal(size=(n, k)))[0]
        v = np.sort(rng.uniform(0.2, 1.0, k))[::-1]
        out.append((v / v.sum(), np.ascontiguousarray(q.T)))
    return out


def _dense(mats, k):
    m = np.array([(a.T * v) @ a for v, a in mats]).reshape(len(mats), -1)
    d2 = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    j = np.eye(len(m)) - 1 / len(m)
    val, vec = np.linalg.eigh(-j @ d2 @ j / 2)
    return vec[:, ::-1][:, :k] * np.sqrt(val[::-1][:k])


def test_axes_of_a_matrix():
    rng = np.random.default_rng(2)
    for n in (3, 40, 300):
        a = rng.normal(size=(n, n))
        c = a + a.T  # largest, not largest in size
        c -= 3 * np.eye(n)
        values, axes = models.top_axes(lambda q, c=c: c @ q, n, 2)
        want = np.linalg.eigvalsh(c)[::-1][:2]
        assert np.allclose(values, want, rtol=1e-8) and np.allclose(axes @ c, axes * values[:, None], atol=1e-5 * abs(want[0]))


def test_covariance_of_pairs():
    rng = np.random.default_rng(4)
    x = rng.binomial(2, 0.4, (23, 17)).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[5] = np.nan
    assert np.allclose(models.pair_covariance(x, rows=7), pair_cov(x - np.nanmean(x, axis=0)))
    full = np.where(np.isnan(x), 1.0, x)
    c = np.cov(full - full.mean(axis=0))
    for lam, v in (models.window_axes(full, 3), models.top_axes(lambda q: c @ q, len(c), 3)):
        assert np.allclose(lam, np.linalg.eigvalsh(c)[::-1][:3]) and np.allclose(np.abs(v @ v.T), np.eye(3), atol=1e-8)


@pytest.mark.parametrize("landmarks", [60, 500])
def test_scaling_equals_classical_scaling(spark, landmarks):
    rng = np.random.default_rng(landmarks)
    mats = _windows(rng, 60, 30, 2, 3)
    df = spark.createDataFrame([("1", i, 0, 1, 10, v.tolist(), a.tobytes()) for i, (v, a) in enumerate(mats)], FIELDS).repartition(5)
    want = _dense(mats, 2)
    got = models.window_scaling(df, 2, landmarks).orderBy("WINDOW").collect()
    own = np.array([[r["LS_PC1"], r["LS_PC2"]] for r in got])
    assert np.allclose(np.abs(own), np.abs(want), rtol=1e-6, atol=1e-9)
    assert np.allclose([r["LS_DIST"] for r in got], np.sqrt((want**2).sum(axis=1)))


def test_few_landmarks_keep_the_outliers(spark):
    rng = np.random.default_rng(1)
    mats = _windows(rng, 200, 25, 2, 2)
    df = spark.createDataFrame([("1", i, 0, 1, 10, v.tolist(), a.tobytes()) for i, (v, a) in enumerate(mats)], FIELDS)
    own = np.array([r["LS_PC1"] for r in models.window_scaling(df, 2, 24).orderBy("WINDOW").collect()])
    want = _dense(mats, 2)[:, 0]
    assert abs(np.corrcoef(own, want)[0, 1]) > 0.999
    assert models.window_scaling(df.limit(0)).count() == 0


def test_five_thousand_samples(spark):
    """The driver holds the landmarks' axes, and nothing of samples by samples (one such matrix would take 200 MB)."""
    n, rng = 5000, np.random.default_rng(6)
    mats = _windows(rng, 300, n, 2, 3)
    df = spark.createDataFrame([("1", i, 0, 1, 10, v.tolist(), a.tobytes()) for i, (v, a) in enumerate(mats)], FIELDS).repartition(8).persist()
    df.count()
    inner = np.array([models.axes_products(v, a, np.array([v for v, _ in mats]), np.array([a for _, a in mats])) for v, a in mats[:3]])
    assert np.allclose(inner[0, 1], np.einsum("a,b,ab", mats[0][0], mats[1][0], (mats[0][1] @ mats[1][1].T) ** 2))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = models.window_scaling(df, 2, landmarks=200).collect()
    assert len(got) == 300 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB
    assert sum(r["LS_DIST"] > 0 for r in got) == 300


def test_golden(spark):
    """The registered query on fixed tables: its values as they were when they agreed with the dense computation."""
    g = adapter.tidy(spark, "/root/testdata/sf0.001")
    w = {(r["CHROM"], r["WINDOW"]): (r["START"], r["END"], r["LS_DIST"]) for r in models.window_scaling(models.local_pca(g, 10)).collect()}
    x = g.toPandas().pivot_table(index="INDIVIDUALS", columns="MARKERS", values="GT_BIN", aggfunc="first", dropna=False)
    where = g.select("MARKERS", "CHROM", "POS").distinct().toPandas().assign(POS=lambda d: d["POS"].astype(int)).sort_values(["CHROM", "POS"])
    mats, keys = [], []
    for c, own in where.groupby("CHROM"):
        for k in range(len(own) // 10):
            y = x[own["MARKERS"].tolist()[10 * k : 10 * k + 10]].to_numpy(float)
            with np.errstate(all="ignore"):
                y = y - np.where(np.isnan(y).all(axis=0), 0, np.nanmean(y, axis=0))
            val, vec = np.linalg.eigh(pair_cov(y))
            val, vec = val[::-1][:2], vec[:, ::-1][:, :2]
            mats.append((val / np.abs(val).sum(), vec.T))
            keys.append((c, k))
    want = np.sqrt((_dense(mats, 2) ** 2).sum(axis=1))
    assert set(w) == set(keys) and np.allclose([w[k][2] for k in keys], want, rtol=1e-5, atol=1e-8)


@pytest.mark.parametrize(("dense", "block"), [(2048, 500), (2048, 7), (10, 7), (10, 60)])
def test_all_windows_are_scaled_whatever_their_axes_take(spark, monkeypatch, dense, block):
    """The scaling never comes from some of the windows: not where their axes are large, nor where their matrix stays out of the driver."""
    monkeypatch.setattr(models, "DENSE", dense)
    mats = _windows(np.random.default_rng(9), 60, 30, 3, 20)
    df = spark.createDataFrame([("1", i, 0, 1, 10, v.tolist(), a.tobytes()) for i, (v, a) in enumerate(mats)], FIELDS).repartition(3)
    want = _dense(mats, 2)
    got = models.window_scaling(df, 2, block, most=8 * 3 * 11 * block).orderBy("WINDOW").collect()
    own = np.array([[r["LS_PC1"], r["LS_PC2"]] for r in got])
    assert np.allclose(np.abs(own), np.abs(want), rtol=1e-6, atol=1e-7)
    assert np.allclose([r["LS_DIST"] for r in got], np.sqrt((want**2).sum(axis=1)), atol=1e-7)


def test_largest_axes_by_few_vectors():
    """Where the vectors that are held do not do, the best of them start anew."""
    d = np.concatenate([[1.003, 1.001], np.linspace(0, 1, 298)])
    values, axes = models.top_axes(lambda q: d[:, None] * q, 300, 2, most=40)
    assert np.allclose(values, d[:2], atol=1e-9) and np.allclose(np.abs(axes[:, :2]), np.eye(2), atol=1e-4)
