"""Work that follows the number of partitions or rounds, not the rows: the fewest rounds and jobs that do."""

import pytest

from snpweave.llm import components as comps
from snpweave.llm import decontaminate, staging


@pytest.fixture
def names(monkeypatch):
    """Names of the tables that components() stages."""
    seen = []

    def staged(df, name, most):
        seen.append(name)
        return staging.stage_distinct(df, name, most)

    monkeypatch.setattr(comps, "stage_distinct", staged)
    return seen


@pytest.mark.parametrize(("edges", "want", "rounds"), [
    ([(1, 5), (6, 1), (1, 7), (2, 8), (3, 3)], {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 8: 2}, 0),
    ([(1, 5), (2, 5)], {1: 1, 5: 1, 2: 1}, 1),
    ([], {}, 0),
])
def test_rounds_end_at_stars(spark, names, edges, want, rounds):
    got = comps.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert dict(map(tuple, got.collect())) == want and names.count("large") == rounds


def test_stars_only(spark):
    star = lambda e: comps._stars_only(spark.createDataFrame(e, "u long, v long"))
    assert star([]) and star([(5, 1), (6, 1), (8, 2)])
    assert not star([(5, 1), (5, 2)]) and not star([(5, 4), (4, 1)])


def test_few_distinct_rows_take_few_files(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = staging.stage_distinct(spark.range(3000).selectExpr("id % 1000 as u", "id % 500 as v"), "few", 3000)
        assert got.count() == 1000 and len(got.inputFiles()) <= staging.LEAST < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filter_comes_in_few_jobs(spark):
    """Whatever the number of partitions, the benchmark's filter is the same and takes about ``LOTS`` jobs."""
    words = " ".join(f"word{i}" for i in range(3000))
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    seeds = bench.mapInArrow(decontaminate._items, "item_id long, words binary").mapInArrow(decontaminate._item_seeds(8), "seed long, item_id long, at int")
    n, sc, old = seeds.count(), spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    few = decontaminate._bit_table(seeds, n)
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("bit-table", "")
    try:
        many = decontaminate._bit_table(seeds, n)
        jobs = len(sc.statusTracker().getJobIdsForGroup("bit-table"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert few.any() and (few == many).all() and 0 < jobs <= decontaminate.LOTS + 4
