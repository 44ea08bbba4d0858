"""All pairs are the result: what a task writes comes in runs of equal counts, which are stored in little, with no pair lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave import catalog
from snpweave.operators import pairs


@pytest.fixture(scope="module")
def grid(spark):
    x = np.random.default_rng(8).integers(-1, 3, (40, 30))
    return x, spark.createDataFrame([(f"m{m:02d}", f"s{s:02d}", "p", None if x[s, m] < 0 else int(x[s, m])) for s in range(40) for m in range(30)], "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int").cache()


def runs(df, *columns):
    """Runs of equal values within partitions, and what they could be at least in one batch; the rows."""
    rows = df.withColumn("p", F.spark_partition_id()).collect()
    key = [(r["p"], *(r[c] for c in columns)) for r in rows]
    return 1 + sum(a != b for a, b in zip(key, key[1:], strict=False)), len(set(key)), rows


def plain(x):
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            both = (x[a] >= 0) & (x[b] >= 0)
            u, v = x[a][both], x[b][both]
            yield (f"s{a:02d}", f"s{b:02d}"), (int(both.sum()), int((u == v).sum()), 2.0 * float(np.abs(u - v).sum()))


def test_similarity_comes_in_runs(grid):
    x, g = grid
    n, least, rows = runs(pairs.genome_similarity(g), "MARKERS_COMMON", "IDENTICAL")
    assert len(rows) == 780 and n == least
    assert {(r["ID1"], r["ID2"]): (r["MARKERS_COMMON"], r["IDENTICAL"]) for r in rows} == {k: v[:2] for k, v in plain(x)}


def test_distances_come_in_runs(grid):
    x, g = grid
    n, least, rows = runs(pairs.matrix_to_pairs(catalog._square(g)), "DISTANCE")
    assert len(rows) == 780 and n == least
    assert {(r["ID1"], r["ID2"]): r["DISTANCE"] for r in rows} == {k: v[2] for k, v in plain(x)}


def test_similarity_takes_no_strata_along(spark):
    """Whether strata are the same is told in the task: of ID1, ID2 and two counts nothing else leaves it.  A missing stratum is like no other."""
    rows = [("m", "a", None, 1), ("m", "b", None, 1), ("m", "c", "p", 0), ("m", "d", "p", 2), ("m", "e", "q", 2)]
    own = pairs.genome_similarity(spark.createDataFrame(rows, "MARKERS string, INDIVIDUALS string, STRATA string, GT_BIN int"))
    assert "ID1_STRATA" not in own._jdf.queryExecution().executedPlan().toString()
    assert {r["ID1"] + r["ID2"]: r["POP_COMP"] for r in own.collect()} == {a + b: "same pop" if a + b == "cd" else "different pop" for a, b in ("ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce", "de")}


def test_tibble_computes_pairs_once(spark, grid):
    """No cell of the square matrix is made, nor the pairs a second time for their maximum; the rows are those of the matrix."""
    g = grid[1]
    own = catalog.QUERIES["distance2tibble"](spark, "/root/testdata/sf0.001")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(array(" not in plan and plan.count("MapInArrow") == 1
    key = lambda df: sorted((r["ID1"], r["ID2"], r["DISTANCE"], r["DISTANCE_RELATIVE"]) for r in df.collect())
    assert key(pairs.distance_pairs(g)) == key(pairs.matrix_to_pairs(catalog._square(g)))
