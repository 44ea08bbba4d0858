"""Source divergence audit: how far the sources of a language stand apart, by their terms.

Terms are counted and pairs are summed by DuckDB inside the tasks, by shards of (language, term); Spark shuffles the
shards, merges their sums and ranks.

1. Each task splits its texts into terms and lets DuckDB count them by (shard, language, source, term).  What it sends
   is columnar: a row for each shard, which lists its sources, and for each its terms joined by blanks (a term holds none).
2. A shard holds all rows of its terms, so it alone decides which terms a language keeps.  Their counts are staged.
3. Spark sums N by (language, source) and V by language.
4. With f(p, q) = floor((p - q)^2 / (p + q)), the sum over all kept terms for sources a and b is taken without the terms
   that one of them lacks: with z the p of a count of 0,

       sum_a f(p_a, z_b) + sum_b f(z_a, p_b) + (V - |a| - |b|) f(z_a, z_b) + sum_ab [f(p_a, p_b) - f(p_a, z_b) - f(z_a, p_b) + f(z_a, z_b)]

   where sum_a runs over the terms of a.  Shards sum the last part over the terms that both hold, and count the terms
   by their count; the first parts need only those histograms, which Spark joins with the sources of the language.
5. Shards return the ten best terms of each source; Spark ranks these.

All arithmetic is of integers: quotients of counts in 128 bits, the rest in 64 (p is at most 10^9 + 1).  Rows that are
alike but for their place in the input count as often as they occur.  The pair part has a row for each ordered pair of
sources of a language, as the contract says; only it grows with the square of anything.

Defined results
* null text, language or source: the empty string.  A language may be the empty string.
* documents without terms still make their (language, source) group; with no kept term all values are 0 and V is 0.
* repeated rows (equal doc_id or not) are documents of their own; doc_id is not read.
* ties: the item's UTF-8 bytes, ascending.  Long texts are split in blocks.  An empty table gives an empty result;
  further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import drop_stage, stage
from .tokens import LOWER, lean, text_buffers

UNIT = 1_000_000_000
#: bytes of letters and of all that is not ASCII
TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: bytes of text that a task counts at once, and distinct (source, term) pairs after which it sends what it has
CHUNK, HELD = 4 << 20, 600_000


@functools.cache
def _duck():
    """A database in memory, one for each process of Python."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
    con.execute("SET preserve_insertion_order = false")
    return con


def _query(sql: str, **tables: pa.Table) -> pa.Table:
    con = _duck()
    for name, t in tables.items():
        con.register(name, t)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of a block of texts, lower-cased, and the row of each."""
    data = data[off[0] : off[-1]]
    off = off - off[0]
    tok = TERM[data]
    new, last = tok.copy(), tok.copy()
    new[1:] &= ~tok[:-1]
    last[:-1] &= ~tok[1:]
    cut = off[(off > 0) & (off < len(data))]
    new[cut] = tok[cut]
    last[cut - 1] = tok[cut - 1]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    chars = LOWER[data[tok]]
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars)))
    return terms, np.searchsorted(off, start, "right") - 1


_COUNT = """
SELECT g, term, sum(n)::BIGINT AS n, count(*) AS docs FROM (SELECT doc, any_value(g) AS g, term, count(*) AS n FROM found GROUP BY doc, term) GROUP BY g, term
"""
_PACK = """
SELECT s.label AS shard, list(lang) AS lang, list(source) AS source, list(terms) AS terms, list(n) AS n, list(docs) AS docs
FROM (
  SELECT (hash(lang || ' ' || term) % (SELECT count(*) FROM labels))::BIGINT AS place, lang, source, string_agg(term, ' ') AS terms, list(n) AS n, list(docs) AS docs
  FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held JOIN groups USING (g) GROUP BY ALL) GROUP BY ALL
) JOIN labels s USING (place) GROUP BY s.label
"""
_COUNTED = "shard int, lang array<string>, source array<string>, terms array<string>, n array<array<long>>, docs array<array<long>>"


def _labels(spark: SparkSession, shards: int) -> list[int]:
    """Names of the shards that Spark's hash deals to as many partitions, one to each."""
    found: dict[int, int] = {}
    tries = 32 * shards
    while len(found) < shards:
        got = spark.range(tries).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(shards)).alias("place")).agg(F.min("label").alias("label"))
        found, tries = {r["place"]: r["label"] for r in got.collect()}, 4 * tries
    return [found[k] for k in range(shards)]


def _counts(labels: list[int]):
    """Partial counts of a task by shard, language and source."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, held, size = {}, [], 0
        names_of = pa.table({"place": pa.array(range(len(labels)), pa.int64()), "label": pa.array(labels, pa.int32())})

        def send():
            nonlocal held, size, ids
            if held:
                keys = list(ids)
                groups = pa.table({"g": pa.array(range(len(keys)), pa.int32()), "lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([k[1] for k in keys], pa.string())})
                yield from _query(_PACK, groups=groups, labels=names_of, held=pa.concat_tables(held)).to_batches(max_chunksize=64)
            held, size, ids = [], 0, {}

        for rb in batches:
            data, off = text_buffers(rb.column(0))
            names = list(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True))
            lo = 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
                g = np.array([ids.setdefault(k, len(ids)) for k in names[lo:hi]], np.int32)
                if off[hi] > off[lo]:
                    terms, row = _terms(data, off[lo : hi + 1])
                    held.append(_query(_COUNT, found=pa.table({"doc": row, "g": g[row], "term": terms})))
                    size += held[-1].num_rows
                lo = hi
                if size > HELD:
                    yield from send()
        yield from send()

    return run


_KEPT = """
WITH packed AS (SELECT unnest(lang) AS lang, unnest(source) AS source, unnest(terms) AS terms, unnest(n) AS n, unnest(docs) AS docs FROM t),
one AS (SELECT lang, source, unnest(string_split(terms, ' ')) AS term, unnest(n) AS n, unnest(docs) AS docs FROM packed),
summed AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM one GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS whole FROM summed GROUP BY ALL HAVING sum(docs) >= {least})
SELECT s.lang, s.source, s.term, s.n, k.whole, row_number() OVER (PARTITION BY s.lang, s.term ORDER BY s.source) = 1 AS first FROM summed s JOIN kept k USING (lang, term)
"""


def _kept(least: int):
    """Counts of the terms of a shard that their language keeps."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        out = _query(_KEPT.format(least=least), t=t)
        return pa.table({"shard": pa.array([key[0].as_py()] * out.num_rows, pa.int32()), **{c: out.column(c) for c in out.column_names}})

    return run


def _p(n: str, total: str, v: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({n} + 2)) // ({total}::HUGEINT + 2 * {v}))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"


_PARTS = f"""
WITH kept AS (
  SELECT lang, source, term, dense_rank() OVER (ORDER BY lang, term) AS id, n, {_p("n", "total", "v")} AS p, {_p("0", "total", "v")} AS z, {_p("whole", "lang_total", "v")} AS q FROM t
), shared AS (
  SELECT a.lang, a.source, b.source AS item, sum({_f("a.p", "b.p")} - {_f("a.p", "b.z")} - {_f("a.z", "b.p")} + {_f("a.z", "b.z")})::BIGINT AS value
  FROM kept a JOIN kept b ON a.id = b.id AND a.source < b.source GROUP BY ALL
), best AS (
  SELECT lang, source, term AS item, {_f("p", "q")} AS value FROM kept WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{top}}
)
SELECT 'both' AS part, lang, source, item, value FROM shared
UNION ALL SELECT 'both', lang, item, source, value FROM shared
UNION ALL SELECT 'term', lang, source, item, value FROM best
UNION ALL SELECT 'held', lang, source, n::VARCHAR, count(*) FROM kept GROUP BY lang, source, n
"""


def _parts(top: int):
    """Sums of a shard over the terms that two sources hold, its best terms, and how many terms have which count."""

    def run(t: pa.Table) -> pa.Table:
        return _query(_PARTS.format(top=top), t=t)

    return run


def _ratio(n, total, v):
    """p of a count, in integers."""
    wide = "decimal(38,0)"
    return F.expr(f"cast(1 + (cast({UNIT} as {wide}) * (cast({n} as {wide}) + 2)) div (cast({total} as {wide}) + 2 * cast({v} as {wide})) as bigint)")


def _gap(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``.

    ``shards`` (the number of shuffle partitions by default) sets how much of the counts a task holds.
    """
    spark = docs.sparkSession
    labels = _labels(spark, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = own.mapInArrow(lean(_counts(labels)), _COUNTED)
    kept = stage(counted.groupBy("shard").applyInArrow(_kept(min_docs), "shard int, lang string, source string, term string, n long, whole long, first boolean"), "divergence")

    # N by group, V and N by language; groups without terms come from the documents
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    groups = stage(groups.drop("firsts").join(whole, "lang"), "divergence-groups")

    shard = "shard int, lang string, source string, term string, n long, whole long, total long, lang_total long, v long".split(", ")
    numbered = kept.drop("first").join(groups, ["lang", "source"]).select(*[c.split()[0] for c in shard])
    parts = stage(numbered.groupBy("shard").applyInArrow(_parts(top), "part string, lang string, source string, item string, value long"), "divergence-parts")
    drop_stage(kept)

    def ranked(df: DataFrame, part: str) -> DataFrame:
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))

    terms = ranked(parts.filter("part = 'term'"), "term").filter(F.col("rank") <= top)

    live = groups.filter("v > 0").select("lang", "source", "v", "total", _ratio("0", "total", "v").alias("z"))
    other = live.select("lang", F.col("source").alias("item"), F.col("z").alias("oz"))
    held = parts.filter("part = 'held'").groupBy("lang", "source", F.col("item").cast("long").alias("count")).agg(F.sum("value").alias("m"))
    held = held.join(live, ["lang", "source"]).withColumn("p", _ratio("count", "total", "v"))
    # each source's own terms against a count of 0 of each other source, its row for V, and what shards summed
    mine = held.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(_gap("p", "oz") * F.col("m")).alias("value"), F.sum("m").alias("n_held"))
    each = live.join(other, "lang").filter("source <> item").join(mine, ["lang", "source", "item"], "left").na.fill(0, ["value", "n_held"]).withColumn("zero", _gap("z", "oz"))
    there = each.select("lang", "source", "item", (F.col("value") + F.col("zero") * (F.col("v") - F.col("n_held"))).alias("value"))
    back = each.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("value") - F.col("zero") * F.col("n_held")).alias("value"))
    both = parts.filter("part = 'both'").select("lang", "source", "item", "value")
    names = groups.select("lang", "source")
    none = groups.filter("v = 0").select("lang", "source").join(names.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = there.unionByName(back).unionByName(both).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs, "pair").unionByName(terms)
