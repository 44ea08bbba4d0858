"""The pipeline's stages, each on its own input, against plain programs over the same rows."""

import collections

import duckdb
import pytest
from test_llm import line_reference, shingle_set

import corpus_pipeline as cp
from snpweave.llm import decontaminate, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before and after each stage."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, f in cp.STAGES:
        docs.append(f(spark, docs[-1], SF).persist())
        docs[-1].count()
    return docs


def ids(df):
    return collections.Counter(r[0] for r in df.select("doc_id").collect())


def test_columns_and_run(spark, kept):
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "minhash_dedup", "decontaminate", "source_mixing"]
    for k in range(1, len(kept) - 1):
        assert kept[k].columns == kept[0].columns and not ids(kept[k]) - ids(kept[k - 1]) and kept[k].count() > 0
    got = cp.run(spark, SF).collect()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, kept[-1].collect()))


def test_quality_stage_keeps_what_scores(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(kept[0], labels).collect() if r["predicted"]}
    assert set(ids(kept[1])) == good


def test_line_stage(kept):
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in kept[1:3])
    want = collections.Counter(k[0] for k in line_reference(list(before.items())).elements() if k[2])
    assert set(before) == set(after) and {i for i in before if (before[i] or "") != (after[i] or "")} == set(want)


def test_near_duplicate_stage(kept):
    text = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    sets = {i: shingle_set(t, 5) for i, t in text.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert set(ids(kept[3])) == {i for i in sets if top(i) == i}


def test_benchmark_stage(spark, kept):
    leaky = {r["doc_id"] for r in decontaminate.leaks(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(ids(kept[4])) == set(ids(kept[3])) - leaky


def test_mix_stage(kept, tmp_path):
    kept[4].write.parquet(str(tmp_path / "documents"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW kept AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rel = c.execute(queries.mixing_sql("kept"))
    names = [d[0] for d in rel.description]
    show = lambda v: None if v is None else round(float(v), 7)
    want = sorted([tuple(show(r[names.index(k)]) for k in kept[5].columns) for r in rel.fetchall()], key=str)
    assert sorted([tuple(map(show, r)) for r in kept[5].collect()], key=str) == want


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
