"""Pairs of samples against plain loops: by blocks and slices, under a threshold, and as groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.operators import pairs


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 3, (40, 30))
    x[20:30] = x[5]  # a group of copies
    rows = [(f"m{m:02d}", f"s{s:02d}", "p" if s % 3 else "q", None if x[s, m] < 0 else int(x[s, m])) for s in range(40) for m in range(30)]
    return x, spark.createDataFrame(rows, "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int").cache()


def plain(x):
    out = {}
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            both = (x[a] >= 0) & (x[b] >= 0)
            if both.any():
                u, v = x[a][both], x[b][both]
                out[f"s{a:02d}", f"s{b:02d}"] = (int(both.sum()), int((u == v).sum()), int(np.abs(u - v).sum()))
    return out


@pytest.mark.parametrize(("block", "size", "strip"), [(2048, 8192, 1024), (7, 9, 4)])
def test_counts_by_blocks_and_slices(grid, monkeypatch, block, size, strip):
    x, g = grid
    for k, v in (("BLOCK", block), ("SLICE", size), ("STRIP", strip)):
        monkeypatch.setattr(pairs, k, v)
    got = pairs.pair_counts(g)
    assert {(r["ID1"], r["ID2"]): (r["COMMON"], r["IDENTICAL"], r["ABSDIFF"]) for r in got.collect()} == plain(x)
    top = 2 * max(v[2] for v in plain(x).values())
    near = {k: 2.0 * v[2] for k, v in plain(x).items() if 2 * v[2] / top < 0.6}
    assert {(r["ID1"], r["ID2"]): r["DISTANCE"] for r in pairs.distance(g, below=0.6).collect()} == near
    links = [(r["ID1"], r["ID2"]) for r in pairs.near_samples(g, 0.3).collect()]
    want = [k for k, v in plain(x).items() if 2 * v[2] / top < 0.3]
    spark = g.sparkSession
    groups = lambda e: {tuple(r) for r in pairs.closure(spark.createDataFrame(e, "ID1 string, ID2 string"), "ID1", "ID2").collect()}
    assert groups(links) == groups(want) and (block < 2048 or len(links) < len(want))


def test_first_names_come_in_runs(grid, monkeypatch):
    """What a task writes of two blocks has each first name once in a run (stored in little), and blocks are full."""
    for k, v in (("BLOCK", 7), ("SLICE", 9)):
        monkeypatch.setattr(pairs, k, v)
    own = pairs.pair_counts(grid[1]).select(F.spark_partition_id().alias("p"), "ID1", "ID2").collect()
    runs = sum(a["p"] != b["p"] or a["ID1"] != b["ID1"] for a, b in zip(own, own[1:], strict=False)) + 1
    assert len(own) == 40 * 39 // 2 and runs <= 40 * 6


def test_pairs_are_not_shuffled(grid):
    plan = pairs.pair_counts(grid[1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "Aggregate" not in plan.split("MapInArrow")[0]


def test_no_pairs(spark):
    g = spark.createDataFrame([("m", "a", "p", None), ("m", "b", "p", 1)], "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int")
    assert pairs.pair_counts(g).count() == pairs.distance(g).count() == pairs.near_samples(g, 0.5).count() == 0
    assert pairs.distance(g.filter("GT_BIN > 5"), below=0.5).count() == 0


def test_units_are_dealt_evenly(grid, monkeypatch):
    """Each pair of blocks has a task of its own where there are as many tasks: none waits for two while another has none."""
    for k, v in (("BLOCK", 7), ("SLICE", 9)):
        monkeypatch.setattr(pairs, k, v)
    assert pairs.pair_counts(grid[1]).select(F.spark_partition_id()).distinct().count() == 6 * 7 // 2


def test_largest_distance_straight_from_the_counts():
    rng = np.random.default_rng(5)
    pack = lambda v: (v.reshape(-1, 4).astype(np.uint8) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()
    x = rng.integers(0, 4, (9, 12))
    x[2], x[3, :11] = 3, 3
    for same in (True, False):
        unit = pairs._Unit((9, 9), same, ("absdiff",))
        for side in (0, 1):
            for i in range(9):
                unit.take(side, i, f"{'s' if same or not side else 't'}{i // 2}", "p", pack(x[i]))
        unit.add()
        for method in ("manhattan", "ibs"):
            want = [unit.distances(method, i, j).max() for i, j in unit.pairs() if len(i)]
            assert unit.top(method) == max(want)
    assert pairs._Unit((3, 3), True).top("ibs") is None and not unit.identical.size
