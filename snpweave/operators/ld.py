"""Linkage of markers: five measures from tables of genotypes, and pruning by a sliding window.

Markers are dealt in blocks of a bounded number: by hash within a chromosome where every pair is wanted, by place where a
window says which pairs are.  A pair of blocks is a unit of work; it meets the samples in slices, one after the other, and adds
up its 3 x 3 tables of genotypes (products of 0/1 matrices).  Measures are taken from the tables, and pairs under ``least`` go
before anything leaves the task.  A task holds two blocks of one slice and nine tables of counts, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import checkpointed, numbered

#: markers in a block; samples in a slice
BLOCK, SLICE = 256, 8192
METHODS = ("r2", "corr", "composite", "r", "dprime")
#: rounds of expectation-maximisation at most, and the change under which a pair is settled
ROUNDS, SETTLED = 500, 1e-13


def indexed(df: DataFrame, key: str, size: int, *by: str) -> DataFrame:
    """Distinct ``key`` (and ``by``) with (block, at): a block for each ``size`` keys of ``by`` in hash order, and the place in it.

    The number of blocks follows the count; places are given within a block, so no task holds all keys.
    """
    k = df.select(*by, key).distinct()
    n = k.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("blocks"))
    k = k.join(F.broadcast(n), list(by)) if by else k.crossJoin(F.broadcast(n))
    k = k.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    return k.withColumn("at", F.row_number().over(Window.partitionBy(*by, "block").orderBy(key)) - 1).drop("blocks")


def haplotypes(t: list[list[np.ndarray]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies of both reference alleles, and of the haplotype that has both, of pairs of markers.

    ``t[d][e]`` counts samples with d and e copies of the alternate alleles.  All but samples with one copy of each say their
    haplotypes; those are shared by expectation-maximisation, from independent alleles on.
    """
    n = sum(c for row in t for c in row)
    two = 2 * n
    sure = [2 * t[0][0] + t[0][1] + t[1][0], 2 * t[0][2] + t[0][1] + t[1][2], 2 * t[2][0] + t[1][0] + t[2][1], 2 * t[2][2] + t[1][2] + t[2][1]]
    both = t[1][1]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (sure[0] + sure[1] + both) / two
        b = (sure[0] + sure[2] + both) / two
        h = [a * b, a * (1 - b), (1 - a) * b, (1 - a) * (1 - b)]
        live = np.flatnonzero((both > 0) & (n > 0))
        out = np.where(both > 0, h[0], sure[0] / two)
        h = [x[live] for x in h]
        s, m, w = [x[live] for x in sure], both[live], two[live]
        for _ in range(rounds):
            if not len(live):
                break
            p, q = h[0] * h[3], h[1] * h[2]
            share = np.where(p + q > 0, p / np.where(p + q > 0, p + q, 1), 0.5)
            new = [(s[0] + m * share) / w, (s[1] + m * (1 - share)) / w, (s[2] + m * (1 - share)) / w, (s[3] + m * share) / w]
            moving = np.abs(new[0] - h[0]) > SETTLED
            out[live] = new[0]
            live, h, s, m, w = live[moving], [x[moving] for x in new], [x[moving] for x in s], m[moving], w[moving]
    return a, b, out


def measure(t: list[list[np.ndarray]], method: str) -> np.ndarray:
    """A measure of pairs from their tables of genotypes, absolute; not a number where it is not defined.

    ``r2``: squared correlation of dosages; ``corr``: that correlation; ``composite``: the disequilibrium of genotypes over the
    genotypic variances, which depart from those of random mating; ``r``, ``dprime``: from estimated haplotypes.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        if method in ("r", "dprime"):
            a, b, h = haplotypes(t)
            d = h - a * b
            if method == "r":
                return np.abs(d) / np.sqrt(a * (1 - a) * b * (1 - b))
            most = np.where(d > 0, np.minimum(a * (1 - b), (1 - a) * b), np.minimum(a * b, (1 - a) * (1 - b)))
            return np.abs(d) / most
        row, col = [sum(t[d]) for d in range(3)], [t[0][e] + t[1][e] + t[2][e] for e in range(3)]
        n = sum(row)
        if method == "composite":
            a, b = (row[1] + 2 * row[2]) / (2 * n), (col[1] + 2 * col[2]) / (2 * n)
            gap = (2 * t[2][2] + t[2][1] + t[1][2] + t[1][1] / 2) / n - 2 * a * b
            va, vb = a * (1 - a) + row[2] / n - a * a, b * (1 - b) + col[2] / n - b * b
            return np.abs(gap) / np.sqrt(np.where((va > 1e-12) & (vb > 1e-12), va * vb, np.nan))
        sx, sy, sxx, syy = row[1] + 2 * row[2], col[1] + 2 * col[2], row[1] + 4 * row[2], col[1] + 4 * col[2]
        sxy = t[1][1] + 2 * (t[1][2] + t[2][1]) + 4 * t[2][2]
        cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
        cov, v = cov.astype(np.float64), np.where((vx > 0) & (vy > 0), vx.astype(np.float64) * vy, np.nan)
        return cov * cov / v if method == "r2" else np.abs(cov) / np.sqrt(v)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        yield from pdf.itertuples(index=False, name=None)


class _Unit:
    """A pair of blocks: its markers and nine tables, filled slice by slice."""

    def __init__(self, same: bool):
        self.same, self.names, self.place, self.size = same, ({}, {}), ({}, {}), [0, 0]
        self.tables: list[list[np.ndarray]] | None = None
        self.held: tuple[list, list] = ([], [])

    def take(self, side: int, name: str, at: int, size: int, place: int | None, js, ds) -> None:
        self.names[side][at], self.place[side][at], self.size[side] = name, place, size
        self.held[side].append((at, np.asarray(js, np.int64), np.asarray(ds, np.int8)))

    def _dense(self, side: int) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = self.held[side]
        width = 1 + max(int(j.max()) for s in self.held for _, j, _ in s)
        x = np.full((len(rows), width), -1, np.int8)
        for k, (_, j, d) in enumerate(rows):
            x[k, j] = d
        return np.array([r[0] for r in rows]), [(x == d).astype(np.float32) for d in range(3)]

    def add(self) -> None:
        """The tables of the slice that is held."""
        if self.held[0] and (self.held[1] or self.same):
            a, hot_a = self._dense(0)
            b, hot_b = (a, hot_a) if self.same else self._dense(1)
            if self.tables is None:
                shape = (self.size[0], self.size[0 if self.same else 1])
                self.tables = [[np.zeros(shape, np.int64) for _ in range(3)] for _ in range(3)]
            at = np.ix_(a, b)
            for d in range(3):
                for e in range(3):
                    self.tables[d][e][at] += np.rint(hot_a[d] @ hot_b[e].T).astype(np.int64)
        self.held = ([], [])

    def pairs(self, method: str, least: float, window: int | None) -> pd.DataFrame | None:
        if self.tables is None:
            return None
        n = sum(c for row in self.tables for c in row)
        names = [np.array([self.names[s].get(k, "") for k in range(self.size[s])], object) for s in ((0, 0) if self.same else (0, 1))]
        want = n > 0
        if self.same:
            want &= names[0][:, None] < names[1][None, :]
        if window is not None:
            pos = [np.array([self.place[s].get(k) or 0 for k in range(self.size[s])]) for s in ((0, 0) if self.same else (0, 1))]
            want &= np.abs(pos[0][:, None] - pos[1][None, :]) <= window
        i, j = np.nonzero(want)
        ld = measure([[self.tables[d][e][i, j] for e in range(3)] for d in range(3)], method)
        keep = np.isfinite(ld) & (ld >= least - 1e-6)
        i, j, ld = i[keep], j[keep], ld[keep]
        left, right = names[0][i], names[1][j]
        turn = left > right
        return pd.DataFrame({"MARKERS_A": np.where(turn, right, left), "MARKERS_B": np.where(turn, left, right), "LD": ld})


def _solve(method: str, least: float, window: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, now, part = None, None, None
        for key, lo, hi, part_of, block, name, at, size, place, js, ds in _rows(batches):
            if (key, lo, hi) != now:
                if unit is not None:
                    unit.add()
                    if (out := unit.pairs(method, least, window)) is not None and len(out):
                        yield out
                unit, now, part = _Unit(lo == hi), (key, lo, hi), part_of
            if part_of != part:
                unit.add()
                part = part_of
            unit.take(0 if block == lo else 1, name, at, size, place, js, ds)
        if unit is not None:
            unit.add()
            if (out := unit.pairs(method, least, window)) is not None and len(out):
                yield out

    return run


def placed_blocks(markers: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(``key``, MARKERS, __pos, block, at): ``size`` neighbours in a block, by place; a block may hold the end of one chromosome only."""
    n = numbered(markers, "__n", key, "__pos", "MARKERS").withColumn("block", F.floor((F.col("__n") - 1) / size).cast("int"))
    return n.withColumn("at", F.row_number().over(Window.partitionBy(key, "block").orderBy("__n")) - 1)


def near_blocks(markers: DataFrame, key: str, window: int) -> DataFrame:
    """(``key``, block, lo, hi): for each pair of blocks with places within the window, a row for each of the two.

    Blocks meet in bins of the window's width that they touch, so only neighbours are compared.
    """
    b = markers.groupBy(key, "block").agg(F.min("__pos").alias("first"), F.max("__pos").alias("last"))
    w = max(1, window)
    bins = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / w), F.floor((F.col("last") + w) / w))))
    other = bins.select(key, "bin", F.col("block").alias("hi"), F.col("first").alias("first_hi"), F.col("last").alias("last_hi"))
    met = bins.join(other, [key, "bin"]).filter((F.col("hi") >= F.col("block")) & (F.col("first_hi") - F.col("last") <= window) & (F.col("first") - F.col("last_hi") <= window))
    met = met.select(key, F.col("block").alias("lo"), "hi").distinct()
    return met.select(key, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"), "lo", "hi")


def linkage(g: DataFrame, key: str = "CHROM", least: float = 0.0, window: int | None = None, method: str = "r2") -> DataFrame:
    """(MARKERS_A, MARKERS_B, LD) of two markers of one ``key`` over the samples that have both, rounded to 6; A < B.

    ``method`` is one of ``METHODS`` (see ``measure``).  Pairs under ``least`` are left out before they leave their task.  With
    ``window``, markers whose POS is further apart are no pairs, and only blocks of neighbouring places meet: the work then grows
    with the markers, not with their square.  Measures that are not defined (a marker that does not vary among the shared
    samples) are left out.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    s = g.filter("GT_BIN is not null")
    if window is None:
        markers = indexed(s, "MARKERS", BLOCK, key).withColumn("__pos", F.lit(None).cast("long"))
    else:
        markers = placed_blocks(s.select(key, "MARKERS", F.col("POS").cast("long").alias("__pos")).distinct(), key)
    markers = markers.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key, "block")))
    samples = indexed(s, "INDIVIDUALS", SLICE).select("INDIVIDUALS", F.col("block").alias("slice"), F.col("at").alias("j"))
    called = s.select(key, "MARKERS", "INDIVIDUALS", "GT_BIN").join(samples, "INDIVIDUALS")
    calls = called.groupBy(key, "MARKERS", "slice").agg(F.collect_list(F.struct("j", F.col("GT_BIN").cast("byte").alias("d"))).alias("x"))
    own = calls.join(markers, [key, "MARKERS"]).select(key, "slice", "block", "MARKERS", "at", "size", "__pos", F.transform("x", lambda v: v["j"]).alias("js"), F.transform("x", lambda v: v["d"]).alias("ds"))
    if window is None:
        count = markers.groupBy(key).agg((F.max("block") + 1).alias("blocks"))
        own = own.join(count, key).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "c")).withColumn("hi", F.greatest("block", "c"))
    else:
        own = own.join(near_blocks(markers, key, window), [key, "block"])
    dealt = own.select(F.col(key).cast("string").alias("key"), "lo", "hi", "slice", "block", "MARKERS", "at", "size", "__pos", "js", "ds")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "slice")
    t = dealt.mapInPandas(_solve(method, least, window), "MARKERS_A string, MARKERS_B string, LD double")
    return t.select("MARKERS_A", "MARKERS_B", F.round("LD", 6).alias("LD")).filter(F.col("LD") >= least)


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted segments: each marker that is not blocked stays unless an earlier one that stays is linked with it."""
    now, kept, out = None, set(), []
    for segment, n, blocked, earlier in _rows(batches):
        if segment != now:
            now, kept = segment, set()
        stays = not blocked and not (earlier is not None and any(e in kept for e in earlier))
        if stays:
            kept.add(n)
        out.append((segment, n, stays))
        if len(out) == 20_000:
            yield pd.DataFrame(out, columns=["segment", "n", "KEEP"])
            out = []
    yield pd.DataFrame(out, columns=["segment", "n", "KEEP"])


def prune_by_window(markers: DataFrame, links: DataFrame, segment: int = 5000) -> DataFrame:
    """(MARKERS, KEEP): markers in the order of (CHROM, POS, MARKERS); one stays unless it is linked with an earlier one that stays.

    ``markers`` has CHROM, MARKERS and POS; ``links`` (MARKERS_A, MARKERS_B) only pairs over the threshold within the window.
    Segments of ``segment`` neighbours are decided side by side, as if nothing of earlier segments stayed; then what stays there
    blocks its links beyond the seam, and segments whose blocked markers changed are decided again, until none does.  The first
    segment is right at once and each round makes the next one right at least, so the result is the sequential one for any
    segments; chains seldom reach over more than one seam.
    """
    own = markers.select("CHROM", "MARKERS", F.col("POS").cast("long").alias("__pos")).distinct()
    order = checkpointed(numbered(own, "n", "CHROM", "__pos", "MARKERS").select("MARKERS", "n", F.floor((F.col("n") - 1) / segment).cast("int").alias("segment")))
    a = order.select(F.col("MARKERS").alias("MARKERS_A"), F.col("n").alias("na"), F.col("segment").alias("sa"))
    b = order.select(F.col("MARKERS").alias("MARKERS_B"), F.col("n").alias("nb"), F.col("segment").alias("sb"))
    late, first = F.col("na") > F.col("nb"), F.least("na", "nb").alias("early")
    e = checkpointed(links.select("MARKERS_A", "MARKERS_B").join(a, "MARKERS_A").join(b, "MARKERS_B").select(first, F.greatest("na", "nb").alias("n"), F.when(late, F.col("sa")).otherwise(F.col("sb")).alias("segment"), (F.col("sa") != F.col("sb")).alias("seam")))
    inside = e.filter(~F.col("seam")).groupBy("n").agg(F.collect_list("early").alias("earlier"))
    seams = e.filter("seam").select("early", "n", "segment")
    rows = checkpointed(order.join(inside, "n", "left").select("segment", "n", "earlier"))

    def decide(todo: DataFrame, blocked: DataFrame) -> DataFrame:
        x = todo.join(blocked.select("n", F.lit(True).alias("b")), "n", "left").select("segment", "n", F.coalesce("b", F.lit(False)).alias("blocked"), "earlier")
        return x.repartition("segment").sortWithinPartitions("segment", "n").mapInPandas(_greedy, "segment int, n int, KEEP boolean")

    blocked = checkpointed(seams.select("n", "segment").limit(0))
    state = checkpointed(decide(rows, blocked))
    while True:
        now = checkpointed(seams.join(state.filter("KEEP").select(F.col("n").alias("early")), "early").select("n", "segment").distinct())
        changed = checkpointed(now.exceptAll(blocked).unionByName(blocked.exceptAll(now)).select("segment").distinct())
        if changed.isEmpty():
            break
        again = decide(rows.join(changed, "segment", "left_semi"), now)
        state = checkpointed(state.join(changed, "segment", "left_anti").unionByName(again))
        blocked = now
    return order.join(state, "n").select("MARKERS", "KEEP")


def sliding_window(g: DataFrame, threshold: float = 0.2, window: int = 500_000, method: str = "r2", segment: int = 5000) -> DataFrame:
    """(MARKERS, KEEP): pruning of markers by linkage over ``threshold`` within ``window`` bases of one chromosome."""
    links = linkage(g, least=threshold, window=window, method=method).filter(F.col("LD") > threshold)
    return prune_by_window(g, links, segment)
