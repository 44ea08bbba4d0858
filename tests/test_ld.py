"""Linkage by every method against scalar programs; pruning by a sliding window against a sequential one."""

import math
import random

import pytest

from snpweave.operators import ld, models, pairs, stats

SCHEMA = "CHROM string, POS string, MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int"


def _grid(spark, n_markers=40, n_samples=60, chroms=2, seed=7, step=100):
    rng, rows = random.Random(seed), []
    for c in range(chroms):
        last = [rng.choice((0, 1, 2)) for _ in range(n_samples)]
        for m in range(n_markers):
            last = [x if rng.random() < 0.7 else rng.choice((0, 0, 1, 2)) for x in last]
            for s, x in enumerate(last):
                rows.append((str(c + 1), str((m + 1) * step), f"{c + 1}__l__{(m + 1) * step}", f"s{s}", "p", None if rng.random() < 0.1 else x))
        rows += [(str(c + 1), "5", f"{c + 1}__one__5", f"s{s}", "p", 1) for s in range(n_samples)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def _scalar(x, y, method):
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    n = len(both)
    if not n:
        return None
    if method in ("r2", "corr", "composite"):
        ma, mb = sum(a for a, _ in both) / n, sum(b for _, b in both) / n
        va, vb = sum((a - ma) ** 2 for a, _ in both), sum((b - mb) ** 2 for _, b in both)
        if va < 1e-9 or vb < 1e-9:
            return None
        r = sum((a - ma) * (b - mb) for a, b in both) / math.sqrt(va * vb)
        return r * r if method == "r2" else abs(r)
    count = {}
    for g in both:
        count[g] = count.get(g, 0) + 1
    pa, pb = 1 - sum(a for a, _ in both) / (2 * n), 1 - sum(b for _, b in both) / (2 * n)
    h = [pa * pb, pa * (1 - pb), (1 - pa) * pb, (1 - pa) * (1 - pb)]
    for _ in range(500):
        new = [0.0] * 4
        for (a, b), k in count.items():
            if (a, b) == (1, 1):
                p, q = h[0] * h[3], h[1] * h[2]
                f = p / (p + q) if p + q else 0.5
                for i, w in ((0, f), (3, f), (1, 1 - f), (2, 1 - f)):
                    new[i] += k * w
            else:  # at least one side is a homozygote: both haplotypes are known
                first, second = (0 if a < 2 else 1, 0 if b < 2 else 1), (0 if a == 0 else 1, 0 if b == 0 else 1)
                new[2 * first[0] + first[1]] += k
                new[2 * second[0] + second[1]] += k
        h = [x / (2 * n) for x in new]
    d = h[0] - pa * pb
    if method == "r":
        v = pa * (1 - pa) * pb * (1 - pb)
        return abs(d) / math.sqrt(v) if v > 1e-12 else None
    most = min(pa * (1 - pb), (1 - pa) * pb) if d > 0 else min(pa * pb, (1 - pa) * (1 - pb))
    return abs(d) / most if most > 1e-12 else None


def _expected(rows, method, window=None, least=0.0):
    calls, chrom, pos = {}, {}, {}
    for c, p, m, s, _, x in rows:
        calls.setdefault(m, {})[s] = x
        chrom[m], pos[m] = c, int(p)
    out, names = {}, sorted(calls)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if chrom[a] == chrom[b] and (window is None or abs(pos[a] - pos[b]) <= window):
                ids = sorted(calls[a])
                v = _scalar([calls[a][s] for s in ids], [calls[b][s] for s in ids], method)
                if v is not None and v >= least:
                    out[a, b] = v
    return out


@pytest.mark.parametrize("method", ld.METHODS)
def test_methods(spark, monkeypatch, method):
    monkeypatch.setattr(ld, "BLOCK", 8)
    monkeypatch.setattr(ld, "SLICE", 17)
    rows, g = _grid(spark, 14, 60)
    want = _expected(rows, method)
    got = {(r[0], r[1]): r[2] for r in ld.linkage(g, method=method).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6
    some = {(r[0], r[1]) for r in ld.linkage(g, method=method, least=0.2, window=450).collect()}
    assert some == {k for k in _expected(rows, method, 450) if got[k] >= 0.2}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        ld.linkage(_grid(spark, 2, 3)[1], method="r3")


def test_dense_places_stay_in_bounded_blocks(spark):
    """All markers within one window: blocks follow their number, not their places."""
    m = spark.createDataFrame([("1", f"m{k:04}", k) for k in range(1000)] + [("2", f"n{k}", 10**6 * k) for k in range(30)], "CHROM string, MARKERS string, __pos long")
    b = ld.placed_blocks(m, "CHROM", 64)
    assert max(r[0] for r in b.groupBy("CHROM", "block").count().select("count").collect()) <= 64
    met = {tuple(r) for r in ld.near_blocks(b, "CHROM", 100).select("CHROM", "lo", "hi").distinct().collect()}
    own = {}
    for r in b.collect():
        own.setdefault((r["CHROM"], r["block"]), []).append(r["__pos"])
    want = {(c, x, y) for (c, x), p in own.items() for (d, y), q in own.items() if c == d and x <= y and min(q) - max(p) <= 100 and min(p) - max(q) <= 100}
    assert met == want


def _sequential(markers, linked):
    kept = []
    for m in sorted(markers, key=lambda m: (m[0], m[1], m[2])):
        if not any((m[2], k) in linked for k in kept):
            kept.append(m[2])
    return set(kept)


@pytest.mark.parametrize("segment", [1, 37, 250, 5000])
def test_pruning_equals_a_sequential_program(spark, segment):
    if segment == 1:  # as many rounds as a chain is long
        markers = [("1", k, f"m{k}") for k in range(6)]
        edges = [(f"m{k}", f"m{k + 1}") for k in range(5)]
    else:
        rng = random.Random(segment)
        markers = [(str(c), p, f"{c}_{p}") for c in range(2) for p in range(0, 10_000, 10)]
        edges = [(f"{c}_{p}", f"{c}_{p + 10 * d}") if rng.random() < 0.5 else (f"{c}_{p + 10 * d}", f"{c}_{p}") for c in range(2) for p in range(0, 10_000, 10) for d in range(1, 12) if p + 10 * d < 10_000 and rng.random() < 0.15]
        edges += [(f"1_{p}", f"1_{p + 10}") for p in range(4000, 6000, 10)]  # one chain over many seams
    linked = set(edges) | {(b, a) for a, b in edges}
    got = ld.prune_by_window(spark.createDataFrame(markers, "CHROM string, POS long, MARKERS string"), spark.createDataFrame(edges, "MARKERS_A string, MARKERS_B string"), segment).collect()
    assert len(got) == len(markers)
    assert {r["MARKERS"] for r in got if r["KEEP"]} == _sequential(markers, linked)


def test_sliding_window(spark):
    rows, g = _grid(spark, 30, 50)
    markers = {(c, int(p), m) for c, p, m, *_ in rows}
    linked = {k for k, v in _expected(rows, "corr", 500).items() if round(v, 6) > 0.35}
    kept = {r["MARKERS"] for r in ld.sliding_window(g, 0.35, 500, "corr", segment=7).collect() if r["KEEP"]}
    assert kept == _sequential(markers, linked | {(b, a) for a, b in linked}) and len(kept) < len(markers)


def test_methods_reach_the_reports(spark):
    rows, g = _grid(spark, 10, 40)
    got = {(r["CHROM"], r["THRESHOLD"]): (r["LINKED_PAIRS"], r["PAIRS"]) for r in models.ld_by_chromosome(g, method="dprime").collect()}
    v = _expected(rows, "dprime")
    for c in ("1", "2"):
        own = [round(x, 6) for (a, _), x in v.items() if a.startswith(c)]
        assert got[c, 0.5] == (sum(x > 0.5 for x in own), len(own))
    box = stats.tibble_stats(pairs.linkage(g, method="corr").selectExpr("1 - LD AS v"), "v", "ld").collect()
    assert len(box) == 1
