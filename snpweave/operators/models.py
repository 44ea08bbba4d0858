"""Operators that iterate or simulate: miscall rate, corrected genotypes, quantile regression, local PCA, linkage by chromosome.

Spark aggregates or groups; what a chain or a fit sees is a bounded table (distinct genotype counts, one window).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs, stats
from .order import checkpointed, numbered

MAX_COUNTS = 100_000
#: windows whose inner products come to the driver (32 MB)
DENSE = 2048


def distinct_counts(g: DataFrame) -> DataFrame:
    """How many markers have each triple of genotype counts."""
    return stats.genotype_counts(g, "MARKERS").groupBy("N0", "N1", "N2").agg(F.count(F.lit(1)).alias("MARKERS"))


def estimate_m(g: DataFrame, reps: int = 200, start: float = 0.1, a0: float = 0.5, a1: float = 0.5, step: float = 0.05, seed: int = 1) -> DataFrame:
    """A chain for the rate m at which heterozygotes are called homozygous: (ITERATION, M).

    The likelihood depends on the distinct triples of counts alone.  Up to ``MAX_COUNTS`` of them make one block, held
    by the driver; more are dealt into blocks of about that size, whose frequencies stay with Spark: each iteration
    sends their share of the likelihood ratio and writes their state to the checkpoint folder.
    """
    triples = pairs.checkpointed(distinct_counts(g))
    blocks = -(-triples.count() // MAX_COUNTS)
    prior = lambda x: (a0 - 1) * np.log(x) + (a1 - 1) * np.log(1 - x)

    def loglik(n, m, p):
        h = 2 * p * (1 - p)
        f = np.stack([p * p + h * m / 2, h * (1 - m), (1 - p) ** 2 + h * m / 2], axis=1)
        return (n * np.log(np.maximum(f, 1e-300))).sum(axis=1)

    def first(n):
        return (2 * n[:, 0] + n[:, 1] + a0) / (2 * n.sum(axis=1) + a0 + a1)

    def move(rng, n, m, p):
        new = np.clip(p + rng.normal(0, step, len(p)), 1e-4, 1 - 1e-4)
        take = np.log(rng.random(len(p))) < loglik(n, m, new) + prior(new) - loglik(n, m, p) - prior(p)
        return np.where(take, new, p)

    def ratio(n, w, m, t, p):
        return float((w * (loglik(n, t, p) - loglik(n, m, p))).sum())

    rng, m, out = np.random.default_rng(seed), start, []
    if blocks <= 1:
        c = triples.orderBy("N0", "N1", "N2").toPandas()
        n, w = c[["N0", "N1", "N2"]].to_numpy(float), c["MARKERS"].to_numpy(float)
        p = first(n)
    else:
        fields = "N0 long, N1 long, N2 long, MARKERS long, b int, p double, d double"
        state = triples.withColumn("b", F.pmod(F.xxhash64("N0", "N1", "N2"), F.lit(blocks)).cast("int")).withColumn("p", F.lit(None).cast("double")).withColumn("d", F.lit(0.0))

    def turn(i, m, t):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["N0", "N1", "N2"])
            n, w = pdf[["N0", "N1", "N2"]].to_numpy(float), pdf["MARKERS"].to_numpy(float)
            p = move(np.random.default_rng([seed, i, int(pdf["b"].iloc[0])]), n, m, first(n) if i == 0 else pdf["p"].to_numpy(float))
            return pdf.assign(p=p, d=w * (loglik(n, t, p) - loglik(n, m, p)))

        return run

    for i in range(reps):
        if blocks <= 1:
            p = move(rng, n, m, p)
        t = abs(m + rng.normal(0, step))
        if blocks > 1:
            state = pairs.checkpointed(state.groupBy("b").applyInPandas(turn(i, m, t if t < 1 else m), fields))
        if t < 1:
            d = ratio(n, w, m, t, p) if blocks <= 1 else state.agg(F.sum("d")).first()[0]
            if np.log(rng.random()) < d:
                m = t
        out.append((i + 1, float(m)))
    return g.sparkSession.createDataFrame(out, "ITERATION int, M double")


def simulate_genotypes(g: DataFrame, m: float, seed: int = 1) -> DataFrame:
    """Homozygotes become heterozygotes with their posterior probability of a miscall, by a seeded hash (MD5) of the cell."""
    c = stats.genotype_counts(g, "MARKERS").filter("N > 0").select("MARKERS", ((2 * F.col("N0") + F.col("N1")) / (2 * F.col("N"))).alias("p"))
    j = g.join(c, "MARKERS", "left")
    het = F.col("p") * (1 - F.col("p")) * m
    hom = F.when(F.col("GT_BIN") == 0, F.col("p") * F.col("p")).otherwise((1 - F.col("p")) * (1 - F.col("p")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "MARKERS", "INDIVIDUALS", F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    gt = F.when(F.col("GT_BIN").isin(0, 2) & (u < F.try_divide(het, het + hom)), 1).otherwise(F.col("GT_BIN"))
    return j.select(*[gt.alias(x) if x == "GT_BIN" else F.col(x) for x in g.columns])


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 100) -> tuple[float, float]:
    """Intercept and slope of a quantile regression, by reweighted least squares."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(rounds):
        r = y - a @ b
        w = np.where(r >= 0, tau, 1 - tau) / np.maximum(np.abs(r), 1e-6)
        new = np.linalg.lstsq(a * w[:, None] ** 0.5, y * w**0.5, rcond=None)[0]
        if np.abs(new - b).max() < 1e-10:
            break
        b = new
    return float(b[0]), float(b[1])


def quantile_residuals(s: DataFrame, x: str, y: str, tau: float = 0.3, rounds: int = 100) -> DataFrame:
    """``s`` with QR_RESIDUALS of y on x; the line is fitted on all rows by ``quantile_fit``'s rounds, five sums each."""
    own = pairs.checkpointed(s.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    n, mean = own.agg(F.count(F.lit(1)), F.avg("x")).first()
    if n < 2:
        return s.withColumn("QR_RESIDUALS", F.lit(None).cast("double"))
    z, a, b = F.col("x") - F.lit(mean), 0.0, 0.0
    for k in range(rounds + 1):
        # the step from the line so far, which keeps the sums small
        r = F.col("y") - F.lit(a) - F.lit(b) * z
        w = F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(1e-6)) if k else F.lit(1.0)
        sw, sz, sr, szz, szr = own.select(w.alias("w"), z.alias("z"), r.alias("r")).agg(F.sum("w"), F.sum(F.expr("w * z")), F.sum(F.expr("w * r")), F.sum(F.expr("w * z * z")), F.sum(F.expr("w * z * r"))).first()
        spread = szz - sz * sz / sw
        up = (szr - sz * sr / sw) / spread if spread > 1e-12 * szz else 0.0
        right = (sr - up * sz) / sw
        if k and max(abs(right), abs(up), abs(right - up * mean)) < 1e-10:
            break
        a, b = a + right, b + up
    return s.withColumn("QR_RESIDUALS", F.col(y) - F.lit(a - b * mean) - F.lit(b) * F.col(x))


def _windows(g: DataFrame, size: int) -> DataFrame:
    """(MARKERS, WINDOW, c): full windows of ``size`` neighbouring SNPs of a chromosome; c is a SNP's place by name in its window."""
    m = numbered(g.select("MARKERS", "CHROM", F.col("POS").cast("long").alias("__pos")).distinct(), "__n", "CHROM", "__pos", "MARKERS")
    c = m.groupBy("CHROM").agg(F.min("__n").alias("first"), F.count(F.lit(1)).alias("n"))
    m = m.join(c, "CHROM").withColumn("WINDOW", F.floor((F.col("__n") - F.col("first")) / size).cast("long"))
    place = F.row_number().over(Window.partitionBy("CHROM", "WINDOW").orderBy("MARKERS")) - 1
    return m.filter((F.col("WINDOW") + 1) * size <= F.col("n")).select("MARKERS", "WINDOW", place.alias("c"))


def _samples(g: DataFrame) -> tuple[DataFrame, int]:
    """(INDIVIDUALS, i) by name from 0, staged, and their number."""
    s = checkpointed(numbered(g.select("INDIVIDUALS").distinct(), "i", "INDIVIDUALS").withColumn("i", F.col("i") - 1))
    return s, s.count()


def _table(pdf: pd.DataFrame, n: int) -> np.ndarray:
    """Samples by SNPs, from their numbers."""
    x = np.full((n, 1 + int(pdf["c"].max())), np.nan)
    x[pdf["i"].to_numpy(), pdf["c"].to_numpy()] = pdf["GT_BIN"].to_numpy(float)
    return x


def top_axes(times, n: int, k: int, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, given by its product with vectors, and their vectors as rows.

    Rayleigh-Ritz over a block Krylov space that grows until the residuals are small (or the space is everything); of ``most``
    vectors the best start anew, as long as that helps.  The largest are meant, not those of largest size.
    """
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(n, min(n, k + 4))))[0]
    basis, image, before = q, times(q), np.inf
    while True:
        values, every = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1][:k], every[:, ::-1][:, :k]
        left = np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0).max(initial=0.0)
        full = basis.shape[1] >= min(n, most)
        if left <= 1e-10 * max(np.abs(values).max(initial=0.0), 1e-300) or full and (n <= most or left >= before):
            return values, np.ascontiguousarray((basis @ turn).T)
        if full:
            q, before = np.linalg.qr(basis @ every[:, ::-1][:, : min(n, k + 4)])[0], left
            basis, image = q, times(q)
            continue
        more = image[:, -q.shape[1] :].copy()
        for _ in range(2):
            more -= basis @ (basis.T @ more)
        more, r = np.linalg.qr(more)
        sound = np.abs(np.diag(r)) > 1e-12 * max(1.0, np.abs(r).max(initial=0.0))
        more = more[:, sound][:, : n - basis.shape[1]]
        if not more.shape[1]:
            return values, np.ascontiguousarray((basis @ turn).T)
        basis, image, q = np.hstack([basis, more]), np.hstack([image, times(more)]), more


def pair_covariance(x: np.ndarray, rows: int = 512) -> np.ndarray:
    """Covariance of samples (rows of ``x``), each pair over the SNPs that both have; 0 where that is not defined."""
    with np.errstate(all="ignore"):
        have = ~np.isnan(x)
        h = have.astype(float)
        z = np.where(have, x - np.where(have.any(axis=0), np.nansum(x, axis=0) / np.maximum(1, have.sum(axis=0)), 0.0), 0.0)
        out = np.empty((len(x), len(x)))
        for i in range(0, len(x), rows):
            a, b = h[i : i + rows], z[i : i + rows]
            n = a @ h.T
            c = (b @ z.T - (b @ h.T) * (a @ z.T) / n) / (n - 1)
            out[i : i + rows] = np.where(n > 1.5, c, 0.0)
    return out


def covariance_times(x: np.ndarray, cells: int = 1 << 22):
    """The product of ``pair_covariance(x)`` with vectors, without that matrix.

    How many SNPs two samples share depends on which ones each of them lacks.  Samples that lack the same ones form a class, and what a
    pair of classes adds to the product is of the rank of the SNPs; ``cells`` bounds the pairs of classes at a time.
    """
    have = ~np.isnan(x)
    z = np.where(have, x - np.where(have.any(axis=0), np.nansum(x, axis=0) / np.maximum(1, have.sum(axis=0)), 0.0), 0.0)
    _, first, own = np.unique(np.packbits(have, axis=1), axis=0, return_index=True, return_inverse=True)
    own = own.reshape(-1)
    h = have[first].astype(float)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(h)))
    sorted_z = z[order]
    step = max(1, cells // len(h))

    def times(q: np.ndarray) -> np.ndarray:
        out = np.empty_like(q)
        for c in range(q.shape[1]):
            w = np.add.reduceat(sorted_z * q[order, c, None], starts, axis=0)
            t = np.empty_like(w)
            for r in range(0, len(h), step):
                a = h[r : r + step]
                n = a @ h.T
                one = np.where(n > 1.5, 1 / np.maximum(n - 1, 0.5), 0.0)
                t[r : r + step] = one @ w - (one / np.maximum(n, 1) * (a @ w.T)) @ h
            out[:, c] = np.einsum("ij,ij->i", z, t[own])
        return out

    return times


def window_axes(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the samples' covariance over a window's SNPs, and the axes as rows.

    SNPs are centred.  The covariance, which is pairwise complete where genotypes are missing, is never formed.
    """
    if np.isnan(x).any():
        return top_axes(covariance_times(x), len(x), k)
    y = x - x.mean(axis=0)
    y = y - y.mean(axis=1, keepdims=True)
    v, s, _ = np.linalg.svd(y, full_matrices=False)
    return s[:k] ** 2 / max(1, x.shape[1] - 1), np.ascontiguousarray(v[:, :k].T)


def local_pca(g: DataFrame, size: int = 100, k: int = 2) -> DataFrame:
    """(CHROM, WINDOW, START, END, N_SNP, VALUES, AXES) of full windows: the ``k`` largest eigenvalues of the samples' pairwise-complete covariance, divided by the sum of their sizes, and the eigenvectors.

    A window is a bounded group: its SNPs by all samples, as numbers.
    """
    samples, n = _samples(g)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _table(pdf, n)
        lam, v = window_axes(x, k)
        total = np.abs(lam).sum()
        return pd.DataFrame({"CHROM": [key[0]], "WINDOW": [int(key[1])], "START": [int(pdf["POS"].min())], "END": [int(pdf["POS"].max())], "N_SNP": [x.shape[1]], "VALUES": [(lam / total if total else lam).tolist()], "AXES": [v.tobytes()]})

    own = g.join(_windows(g, size), "MARKERS").join(samples, "INDIVIDUALS").select("CHROM", "WINDOW", "c", F.col("POS").cast("long").alias("POS"), "i", F.col("GT_BIN").cast("float").alias("GT_BIN"))
    return own.groupBy("CHROM", "WINDOW").applyInPandas(solve, "CHROM string, WINDOW long, START long, END long, N_SNP long, VALUES array<double>, AXES binary")


def axes_products(values: np.ndarray, axes: np.ndarray, others: np.ndarray, other_axes: np.ndarray) -> np.ndarray:
    """Inner products of a window's low-rank covariance with others': from the squared products of their axes alone.

    ``axes`` is (r, n), ``other_axes`` (m, r, n): no matrix of samples by samples is formed.
    """
    m, r, n = other_axes.shape
    p = (axes @ other_axes.reshape(m * r, n).T).reshape(len(axes), m, r) ** 2
    return np.einsum("a,amb,mb->m", values, p, others)


def window_products(w: DataFrame, rank: int, block: int, most: int) -> DataFrame:
    """(LO, HI, X): inner products of windows' low-rank covariances, a row for each pair of blocks of windows; ``w`` has (i, VALUES, AXES).

    A pair of blocks is a unit of work, which meets the samples in slices and adds up the products of the axes: a task holds those of
    two blocks and one slice of their axes (``most`` bytes at most for a block, or one sample), whatever the number of windows and samples.
    """
    step = max(1, most // (8 * rank * block))
    last = w.agg(F.max("i")).first()[0] // block

    def cut(batches):
        for pdf in batches:
            out, size = [], 0
            for i, v, a in zip(pdf["i"], pdf["VALUES"], pdf["AXES"], strict=True):
                v, a = np.asarray(v, float), np.frombuffer(a).reshape(len(v), -1)
                for s in range(0, a.shape[1], step):
                    out.append((i // block, i % block, s // step, v.tobytes(), a[:, s : s + step].tobytes()))
                    size += len(out[-1][-1])
                    if size > most:
                        yield pd.DataFrame(out, columns=["b", "at", "s", "v", "x"])
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["b", "at", "s", "v", "x"])

    def products(batches):
        now = part = sums = None
        values, held = ({}, {}), ({}, {})

        def add():
            x = [np.concatenate([h[i] for i in sorted(h)]) for h in held if h]
            if len(x) == 2:
                p = x[0] @ x[1].T
                return p if sums is None else sums + p
            return sums

        def finish():
            n, m = (len(v) for v in values)
            out = np.einsum("ia,jb,iajb->ij", *[np.array([v[i] for i in range(len(v))]) for v in values], sums.reshape(n, rank, m, rank) ** 2, optimize=True)
            return pd.DataFrame({"LO": [now[0]], "HI": [now[1]], "X": [out.tobytes()]})

        for pdf in batches:
            for lo, hi, b, at, s, v, x in pdf[["LO", "HI", "b", "at", "s", "v", "x"]].itertuples(index=False):
                if (lo, hi, s) != part:
                    if part is not None:
                        sums, held = add(), ({}, {})
                    if (lo, hi) != now:
                        if now is not None:
                            yield finish()
                        now, sums, values = (lo, hi), None, ({}, {})
                    part = lo, hi, s
                own, x = np.frombuffer(v), np.frombuffer(x)
                # a window with fewer axes has others of no weight
                full = np.zeros((rank, len(x) // len(own)))
                full[: len(own)] = x.reshape(len(own), -1)
                for side in (0, 1):
                    if b == (lo, hi)[side]:
                        values[side][at], held[side][at] = np.pad(own, (0, rank - len(own))), full
        if now is not None:
            sums = add()
            yield finish()

    rows = w.select("i", "VALUES", "AXES").mapInPandas(cut, "b int, at int, s int, v binary, x binary").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(last))))
    rows = rows.select(F.least("b", "c").cast("int").alias("LO"), F.greatest("b", "c").cast("int").alias("HI"), "b", "at", "s", "v", "x")
    units = min((last + 1) * (last + 2) // 2, 1024)
    return rows.repartition(units, "LO", "HI").sortWithinPartitions("LO", "HI", "s").mapInPandas(products, "LO int, HI int, X binary")


def centred_times(products: DataFrame, n: int, block: int):
    """The product of the doubly centred matrix of ``window_products`` with vectors: tasks add up their blocks, and the blocks of all tasks are added by key."""
    sc = products.sparkSession.sparkContext

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "y": [np.sum([np.frombuffer(y) for y in pdf["y"]], axis=0).tobytes()]})

    def times(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(q - q.mean(axis=0))

        def run(batches):
            q, out = shared.value, {}
            for pdf in batches:
                for lo, hi, x in pdf[["LO", "HI", "X"]].itertuples(index=False):
                    a, b = (q[i * block : (i + 1) * block] for i in (lo, hi))
                    x = np.frombuffer(x).reshape(len(a), len(b))
                    out[lo] = out.get(lo, 0.0) + x @ b
                    if lo != hi:
                        out[hi] = out.get(hi, 0.0) + x.T @ a
            if out:
                yield pd.DataFrame({"b": list(out), "y": [np.ascontiguousarray(y).tobytes() for y in out.values()]})

        y = np.empty_like(q, order="C")
        for b, part in products.mapInPandas(run, "b int, y binary").groupBy("b").applyInPandas(total, "b int, y binary").collect():
            y[b * block : (b + 1) * block] = np.frombuffer(part).reshape(-1, q.shape[1])
        shared.unpersist()
        return y - y.mean(axis=0)

    return times


def window_scaling(w: DataFrame, k: int = 2, landmarks: int = 500, most: int = 64 << 20) -> DataFrame:
    """Classical scaling of windows by the distance of their low-rank covariances: ``w`` with LS_PC1 .. and LS_DIST.

    The distance of two windows is the Frobenius norm of the difference of their matrices (values times axes), which follows from
    products of their axes.  Every window is a landmark: the inner products of all pairs of windows, doubly centred, are what classical
    scaling takes the largest axes of.  They are computed by blocks of ``landmarks`` windows, in slices of samples whose axes take ``most``
    bytes in a block.  Up to ``DENSE`` windows their matrix comes to the driver; of more it stays staged, in blocks, and its product with a
    few vectors is what the driver sees.  The sign of an axis makes its first coordinate (by CHROM and WINDOW) that is not 0 positive.
    """
    w = checkpointed(w)
    named = [f"LS_PC{j + 1}" for j in range(k)]
    n, rank = w.agg(F.count(F.lit(1)), F.max(F.size("VALUES"))).first()
    if not n:
        return w.select("*", *[F.lit(None).cast("double").alias(c) for c in [*named, "LS_DIST"]])
    w = checkpointed(numbered(w, "i", "CHROM", "WINDOW").withColumn("i", F.col("i") - 1))
    products = window_products(w, rank, landmarks, most)
    if n <= DENSE:
        inner = np.empty((n, n))
        for lo, hi, x in products.collect():
            x = np.frombuffer(x).reshape(min(landmarks, n - lo * landmarks), -1)
            a, b = lo * landmarks, hi * landmarks
            inner[a : a + x.shape[0], b : b + x.shape[1]] = x
            inner[b : b + x.shape[1], a : a + x.shape[0]] = x.T
        inner = inner - inner.mean(axis=0)
        lam, u = np.linalg.eigh(inner - inner.mean(axis=1)[:, None])
        lam, u = lam[::-1][:k], u[:, ::-1][:, :k]
    else:
        lam, u = top_axes(centred_times(checkpointed(products), n, landmarks), n, k)
        u = u.T
    at = np.zeros((n, k))
    at[:, : len(lam)] = np.where(lam > 1e-12 * max(lam.max(initial=0.0), 1e-300), u * np.sqrt(np.maximum(lam, 0.0)), 0.0)
    first = at[(np.abs(at) > 1e-9 * np.abs(at).max(axis=0)).argmax(axis=0), np.arange(k)]
    at *= np.where(first < 0, -1.0, 1.0)
    places = pd.DataFrame({"i": np.arange(n, dtype=np.int32)} | {c: at[:, j] for j, c in enumerate(named)} | {"LS_DIST": np.sqrt((at**2).sum(axis=1))})
    places = w.sparkSession.createDataFrame(places, "i int, " + ", ".join(f"{c} double" for c in [*named, "LS_DIST"]))
    return w.join(F.broadcast(places), "i").drop("i")


def outlier_windows(w: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Windows whose scaled distance from the middle is at the quantile or beyond."""
    q = w.agg(F.percentile("LS_DIST", F.lit(quantile)).alias("q"))
    return w.crossJoin(F.broadcast(q)).filter("LS_DIST >= q").drop("q")


def kmeans_line(x: np.ndarray, k: int) -> np.ndarray:
    """The clusters (0 .. by their means) of values on a line with the least sum of squares, by dynamic programming over the sorted values."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    n = len(v)
    k = min(k, n)
    s, s2 = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    cost = np.full((k + 1, n + 1), np.inf)
    cost[0, 0] = 0.0
    cut = np.zeros((k + 1, n + 1), int)
    for c in range(1, k + 1):
        # the best cut never goes back as the values grow, so the middle one bounds those on both sides
        todo = [(c, n, c - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(first, c - 1), min(last, j - 1) + 1)
            t = cost[c - 1, i] + (s2[j] - s2[i]) - (s[j] - s[i]) ** 2 / (j - i)
            best = int(t.argmin())
            cost[c, j], cut[c, j] = t[best], i[best]
            todo += [(lo, j - 1, first, int(i[best])), (j + 1, hi, int(i[best]), last)]
    out, j = np.zeros(n, int), n
    for c in range(k, 0, -1):
        i = cut[c, j]
        out[order[i:j]] = c - 1
        j = i
    return out


def window_clusters(g: DataFrame, windows: DataFrame, size: int = 100, clusters: int = 3) -> DataFrame:
    """Of each wanted window (CHROM, WINDOW): clusters of samples on the first axis with their sizes and heterozygosity, and the mean and median r2 of its SNPs.

    Axes are those of scaled SNPs (ones that do not vary are left out); clusters are numbered along the axis, whose sign makes
    the first sample's coordinate not positive.
    """
    samples, n_samples = _samples(g)
    out = "CHROM string, WINDOW long, CLUSTER int, N_IND long, MEAN_HET double, LD_MEAN double, LD_MEDIAN double"

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _table(pdf, n_samples)
        with np.errstate(all="ignore"):
            have = ~np.isnan(x)
            n = have.sum(axis=0)
            mean = np.nansum(x, axis=0) / np.maximum(1, n)
            z = np.where(have, x - mean, 0.0)
            sd = np.sqrt((z * z).sum(axis=0) / np.maximum(1, n - 1))
            u, s, _ = np.linalg.svd(z[:, sd > 0] / sd[sd > 0], full_matrices=False)
            axis = u[:, 0] * s[0] if len(s) else np.zeros(n_samples)
            axis = -axis if axis[0] > 0 else axis
            own = kmeans_line(np.round(axis, 12), clusters)
            het = (x == 1).sum(axis=1) / np.where(have.sum(axis=1) > 0, have.sum(axis=1), np.nan)
            h, v = have.astype(float), np.where(have, x, 0.0)
            c, sx, sxy, sxx = h.T @ h, v.T @ h, v.T @ v, (v * v).T @ h
            r2 = (c * sxy - sx * sx.T) ** 2 / ((c * sxx - sx * sx) * (c * sxx - sx * sx).T)
        pairs_ = r2[np.triu_indices(len(r2), 1)]
        pairs_ = pairs_[np.isfinite(pairs_)]
        ld = (round(float(pairs_.mean()), 6), round(float(np.median(pairs_)), 6)) if len(pairs_) else (None, None)
        rows = [(key[0], int(key[1]), int(i), int((own == i).sum()), round(float(np.nanmean(het[own == i])), 6) if np.isfinite(het[own == i]).any() else None, *ld) for i in range(own.max() + 1)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])

    live = g.join(_windows(g, size), "MARKERS").join(samples, "INDIVIDUALS").join(windows.select("CHROM", "WINDOW").distinct(), ["CHROM", "WINDOW"], "left_semi")
    return live.select("CHROM", "WINDOW", "c", "i", F.col("GT_BIN").cast("float").alias("GT_BIN")).groupBy("CHROM", "WINDOW").applyInPandas(solve, out)


def inversions(g: DataFrame, size: int = 100, k: int = 2, quantile: float = 0.99, clusters: int = 3) -> DataFrame:
    """Candidate windows: those far out in the scaled space of local PCAs, a row for each cluster of samples."""
    w = pairs.checkpointed(window_scaling(local_pca(g, size, k), k).select("CHROM", "WINDOW", "START", "END", "N_SNP", F.round("LS_DIST", 9).alias("LS_DIST")))
    far = pairs.checkpointed(outlier_windows(w, quantile))
    return far.join(window_clusters(g, far, size, clusters), ["CHROM", "WINDOW"])


def ld_by_chromosome(g: DataFrame, thresholds=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), method: str = "r2", window: int | None = None) -> DataFrame:
    """Of each chromosome and threshold, the pairs (within a window, if one is given) linked more strongly."""
    ld = pairs.linkage(g, method=method, window=window).withColumn("CHROM", F.split_part("MARKERS_A", F.lit("__"), F.lit(1)))
    t = stats.at_thresholds(ld, "LD", list(thresholds), "CHROM")
    return t.select("CHROM", "THRESHOLD", F.col("BLACKLISTED_MARKERS").alias("LINKED_PAIRS"), (F.col("BLACKLISTED_MARKERS") + F.col("WHITELISTED_MARKERS")).alias("PAIRS"))


def histogram(df: DataFrame, value: str, bins: int = 20, *by: str) -> DataFrame:
    """The table behind a histogram or density: counts in equal bins of [min, max] (one broadcast row)."""
    lim = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    j = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(lim))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return j.groupBy(*by, F.coalesce(b, F.lit(0)).cast("int").alias("BIN")).agg(F.count(F.lit(1)).alias("N"))


def shared_sets(g: DataFrame) -> DataFrame:
    """The table behind an intersection plot: how many markers are genotyped in each set of strata."""
    s = stats.genotype_counts(g, "MARKERS", "STRATA").filter("N > 0").groupBy("MARKERS").agg(F.array_join(F.array_sort(F.collect_set("STRATA")), "&").alias("STRATA_SET"))
    return s.groupBy("STRATA_SET").agg(F.count(F.lit(1)).alias("N"))
