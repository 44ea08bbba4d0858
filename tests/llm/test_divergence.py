"""Source divergence against its SQL and a plain program."""

from collections import Counter, defaultdict

import pytest

from snpweave.llm import divergence as dv
from snpweave.llm import queries


def _plain(rows, least, top):
    import re

    count, seen, sources = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        count[lang, source].update(words)
        seen.update((lang, w) for w in set(words))
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in names}
        v = len(kept)
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in names}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in names) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names if o != s))
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(pairs)} | {(lang, s, "term", o, -x, k + 1) for k, (x, _, o) in enumerate(terms)}
    return out


def _same(spark, rows, least=2, top=3, **options):
    docs = spark.createDataFrame([(k % 3, *r, "x", 0) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, shard string, n int")
    got = [tuple(r) for r in dv.divergence(docs, least, top, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _plain(rows, least, top)


def test_plain_cases(spark):
    rows = [
        ("Ab ab cd. EF", "en", "a"), ("ab CD gh-ij", "en", "b"), ("ef ef ef", "en", "b"), ("", "en", "c"), (None, "en", "d"), ("ab", None, "a"), ("AB ab", None, None), ("ab É é ÉCOLE", "fr", "a"),
        ("é École É", "fr", None), ("É école", "fr", ""), ("1 2 3", "xx", "only"), ("ab ab cd. EF", "en", "a"), ("cd 語 語", "en", "c"), ("語", "en", "a"), ("lone", "yy", "p"), ("other", "yy", "q"),
    ]
    _same(spark, rows)
    _same(spark, rows, least=1, top=100, shards=3)
    _same(spark, rows, least=99)


def test_long_texts_ties_and_empty(spark):
    long = "wort " * 400_000 + "ende Ende"
    _same(spark, [(long, "de", "a"), ("wort " * 3, "de", "b"), ("ende x y z", "de", "b"), ("z y x ende", "de", "c"), ("x" * 300_000, "de", "c"), ("x" * 300_000, "de", "a")], least=1, top=2)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert dv.divergence(docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP13_SQL})").fetchall()}
    got = [tuple(r) for r in queries.op13_source_divergence(spark, f"/root/testdata/{sf}").select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_labels_go_one_to_each_partition(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 12, 211):
        labels = dv._labels(spark, n)
        df = spark.createDataFrame([(x,) for x in labels], "label int").repartition(n, "label")
        assert len(labels) == n and df.select(F.spark_partition_id()).distinct().count() == n


def test_small_holdings_are_sent_in_parts(spark, monkeypatch):
    counts = dv._counts([3, 9])
    import pyarrow as pa

    rows = [("a b c d e f", "x", "s"), ("a b c", "x", "t"), ("a", "x", "s")] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["text", "lang", "source"])
    monkeypatch.setattr(dv, "HELD", 4)
    monkeypatch.setattr(dv, "CHUNK", 8)
    n = Counter()
    for rb in counts([batch]):
        for r in rb.to_pylist():
            assert r["shard"] in (3, 9)
            for source, terms, ks in zip(r["source"], r["terms"], r["n"], strict=True):
                n.update({(source, t): k for t, k in zip(terms.split(" "), ks, strict=True)})
    assert n == Counter({("s", "a"): 10, ("t", "a"): 5} | {("s", t): 5 for t in "bcdef"} | {("t", t): 5 for t in "bc"})
