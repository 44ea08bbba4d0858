"""Registered queries against their SQL, and helpers of the catalog that must not replace each other."""

import collections
import re
from pathlib import Path

import duckdb
import pytest

from snpweave import catalog

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def same(spark, name):
    """Whether a query's rows are those of its SQL."""
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = catalog.QUERIES[name](spark, SF).select(*[f"`{c}`" for c in columns]).collect()
    flat = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    return flat(tuple(r) for r in got) == flat(want)


def test_helpers_of_the_catalog_have_names_of_their_own():
    named = collections.Counter(re.findall(r"^(_\w+) = lambda", (ROOT / "snpweave/catalog.py").read_text(), re.M))
    assert [n for n, k in named.items() if k > 1] == []


@pytest.mark.parametrize("name", ["import_dart_geno__1row", "filter_het__summary_haplotype"])
def test_query_equals_its_sql(spark, name):
    assert same(spark, name)


def test_dimensions_collapse_before_they_are_sorted(spark):
    from snpweave import adapter
    from snpweave.model import Dataset

    d = Dataset.from_tidy(adapter.tidy(spark, SF))
    for dim in (d.individuals, d.markers):
        plan = dim._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan.rsplit("SortAggregate", 1)[1]  # below the sort that picks a row for each key
    assert d.individuals.count() == 10 and d.markers.count() == 200


@pytest.mark.parametrize("name", ["extract_individuals_metadata", "extract_markers_metadata"])
def test_metadata_equals_its_sql(spark, name):
    assert same(spark, name)
