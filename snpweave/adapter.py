"""The genotypes that queries derive from sales tables.

A supplier is a sample, its region the stratum; ``l_partkey % 200`` is a marker; all ordered pairs of bases occur as alleles.  A line item is a read of the
alternate allele if its quantity is at most ``marker % 26``, else of the reference allele.  The grid is
suppliers by markers; a cell without reads is a missing genotype.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.genotypes import gt_bin_from_depth

N_MARKERS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, stratum: str = "n_regionkey") -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col(stratum).alias("r"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("INDIVIDUALS"), F.col("r").cast("string").alias("STRATA"))


def markers(spark: SparkSession) -> DataFrame:
    return spark.range(N_MARKERS).select(F.col("id").cast("int").alias("m")).select("m", *marker_columns())


def base(i) -> Column:
    return F.substring(F.lit("ACGT"), (i + 1).cast("int"), F.lit(1))


def marker_columns() -> list:
    text = lambda c: c.cast("string")
    chrom, locus, pos = text(F.col("m") % 5), text(F.floor(F.col("m") / 3)), text(F.col("m") * 100)
    return [F.concat_ws("__", chrom, locus, pos).alias("MARKERS"), chrom.alias("CHROM"), locus.alias("LOCUS"), pos.alias("POS"), (F.col("m") % 90).cast("int").alias("COL"), base(F.col("m") % 4).alias("REF"), base((F.col("m") + 1 + F.floor(F.col("m") / 4) % 3) % 4).alias("ALT")]


def tidy(spark: SparkSession, sf_dir: str, stratum: str = "n_regionkey") -> DataFrame:
    """The long genotype table."""
    part = F.col("l_partkey") % N_MARKERS
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("INDIVIDUALS"), part.cast("int").alias("m"), (F.col("l_quantity") <= part % 26).alias("alt"))
    reads = item.groupBy("INDIVIDUALS", "m").agg(F.count_if(~F.col("alt")).alias("rd"), F.count_if("alt").alias("ad"))
    grid = samples(spark, sf_dir, stratum).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(N_MARKERS - 1))))
    cell = grid.join(reads, ["INDIVIDUALS", "m"], "left")
    total = F.col("rd") + F.col("ad")
    return cell.select(*marker_columns(), "INDIVIDUALS", "STRATA", gt_bin_from_depth(F.col("rd"), F.col("ad")).alias("GT_BIN"),
                       total.alias("READ_DEPTH"), F.nullif("rd", F.lit(0)).alias("ALLELE_REF_DEPTH"), F.nullif("ad", F.lit(0)).alias("ALLELE_ALT_DEPTH"))


#: the same relation in DuckDB SQL: common table expressions ``samples``, ``mk`` and ``g``
BASE_SQL = """WITH samples AS (
  SELECT s_suppkey::VARCHAR AS INDIVIDUALS, n_regionkey::VARCHAR AS STRATA, n_nationkey::VARCHAR AS NATION FROM supplier JOIN nation ON s_nationkey = n_nationkey
), mk AS (
  SELECT m, (m % 5)::VARCHAR || '__' || (m // 3)::VARCHAR || '__' || (m * 100)::VARCHAR AS MARKERS, (m % 5)::VARCHAR AS CHROM, (m // 3)::VARCHAR AS LOCUS, (m * 100)::VARCHAR AS POS, (m % 90)::INT AS COL, substr('ACGT', m % 4 + 1, 1) AS REF, substr('ACGT', (m + 1 + (m // 4) % 3) % 4 + 1, 1) AS ALT
  FROM (SELECT unnest(range(200))::INT AS m)
), reads AS (
  SELECT l_suppkey::VARCHAR AS INDIVIDUALS, l_partkey % 200 AS m, count(*) FILTER (WHERE l_quantity > (l_partkey % 200) % 26) AS rd, count(*) FILTER (WHERE l_quantity <= (l_partkey % 200) % 26) AS ad FROM lineitem GROUP BY ALL
), g AS (
  SELECT mk.MARKERS, mk.CHROM, mk.LOCUS, mk.POS, mk.COL, mk.REF, mk.ALT, s.INDIVIDUALS, s.STRATA,
    CASE WHEN rd > 0 AND ad = 0 THEN 0 WHEN rd > 0 AND ad > 0 THEN 1 WHEN rd = 0 AND ad > 0 THEN 2 END AS GT_BIN,
    rd + ad AS READ_DEPTH, nullif(rd, 0) AS ALLELE_REF_DEPTH, nullif(ad, 0) AS ALLELE_ALT_DEPTH
  FROM samples s CROSS JOIN mk LEFT JOIN reads r ON r.INDIVIDUALS = s.INDIVIDUALS AND r.m = mk.m
)"""


def _word(m: int, i: int) -> str:
    """The ``i``-th allele of a part with that remainder by 12: of letters by 4, of places that differ by 3."""
    return "".join("ACGT"[(m + p + (i if (m + p) % 3 < i else 0)) % 4] for p in range(5))


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of words with two to four alleles; the markers are the parts, so they grow with the table.

    A supplier is a sample, its region the stratum.  A line item is a read of one allele of its part: of seven order keys four
    read the first allele, two the second, one another (the second, where there are two).  The two alleles with most reads
    are the call (ties to the first); a cell without reads has no row.  Alleles are words of five bases that differ at one
    to five places.  Items are dealt by marker once, as narrow rows: what is then asked by marker finds its rows together.
    """
    part, n = F.col("l_partkey"), 2 + F.col("l_partkey") % 3
    k = F.col("l_orderkey") % 7
    read = F.when(k < 4, 0).when((k < 6) | (n == 2), 1).otherwise(2 + F.floor("l_quantity") % (n - 2)).cast("byte")
    text = lambda c: c.cast("string")
    item = table(spark, sf_dir, "lineitem").select(F.concat_ws("__", text(part % 5), text(part), text(part * 10)).alias("MARKERS"), part.cast("long").alias("m"), "l_suppkey", read.alias("a"))
    # of all partitions: merged ones would make a task's memory follow the size of what is shuffled
    cell = item.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "MARKERS").groupBy("MARKERS", "m", "l_suppkey").agg(*[F.count_if(F.col("a") == i).alias(f"d{i}") for i in range(4)])
    # plain expressions throughout: the functions that take a lambda are interpreted for every cell, with all that they are given
    depths = [F.col(f"d{i}") for i in range(4)]
    cell = cell.withColumn("most", F.sort_array(F.array(*[4 * d + (3 - i) for i, d in enumerate(depths)]), asc=False))
    most, next_ = F.get("most", F.lit(0)), F.get("most", F.lit(1))
    # words repeat with twelve parts: they are looked up
    at, many = (F.col("m") % 12).cast("int"), (2 + F.col("m") % 3).cast("int")
    looked = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), i)
    refs, alts = [_word(m, 0) for m in range(12)], [",".join(_word(m, i) for i in range(1, 2 + m % 3)) for m in range(12)]
    calls = [f"{_word(m, min(i, j))}/{_word(m, max(i, j))}" for m in range(12) for i in (3, 2, 1, 0) for j in (3, 2, 1, 0)]
    out = cell.select("l_suppkey", "MARKERS", text(F.col("m") % 5).alias("CHROM"), text(F.col("m")).alias("LOCUS"), text(F.col("m") * 10).alias("POS"), looked(refs, at).alias("REF"), looked(alts, at).alias("ALT"),
        looked(calls, 16 * at + (4 * (most % 4) + F.when(next_ >= 4, next_).otherwise(most) % 4).cast("int")).alias("GT_VCF_NUC"), F.slice(F.array(*depths), F.lit(1), many).alias("AD"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    region = table(spark, sf_dir, "nation").select("n_nationkey", text(F.col("n_regionkey")).alias("STRATA"))
    # first the suppliers, then their nations: both are seen to be small where they are
    named = out.join(s, out["l_suppkey"] == s["s_suppkey"]).join(region, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(text(F.col("l_suppkey")).alias("INDIVIDUALS"), "MARKERS", "CHROM", "LOCUS", "POS", "REF", "ALT", "GT_VCF_NUC", "AD", "STRATA")


#: the same relation in DuckDB SQL: ``samples`` and ``h``
HAPLOTYPE_SQL = """WITH samples AS (
  SELECT s_suppkey::VARCHAR AS INDIVIDUALS, n_regionkey::VARCHAR AS STRATA FROM supplier JOIN nation ON s_nationkey = n_nationkey
), item AS (
  SELECT l_suppkey::VARCHAR AS INDIVIDUALS, l_partkey::BIGINT AS m, 2 + l_partkey % 3 AS n, CASE WHEN l_orderkey % 7 < 4 THEN 0 WHEN l_orderkey % 7 < 6 OR l_partkey % 3 = 0 THEN 1 ELSE 2 + floor(l_quantity)::BIGINT % (l_partkey % 3) END AS a FROM lineitem
), depths AS (
  SELECT INDIVIDUALS, m, n, a, count(*) AS d FROM item GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY INDIVIDUALS, m ORDER BY d DESC, a) AS k, count(*) OVER (PARTITION BY INDIVIDUALS, m) AS seen FROM depths
), top AS (
  SELECT INDIVIDUALS, m, n, min(a) FILTER (WHERE k <= 2) AS x, max(a) FILTER (WHERE k <= 2) AS y, list({'a': a, 'd': d}) AS e FROM ranked GROUP BY ALL
), called AS (
  SELECT INDIVIDUALS, m, n, x, y, list_transform(range(n), lambda i: coalesce(list_sum([z.d for z in e if z.a = i]), 0)::BIGINT) AS AD FROM top
), words AS (
  SELECT m, n, list_transform(range(n), lambda i: list_reduce([substr('ACGT', ((m + p + (CASE WHEN (m + p) % 3 < i THEN i ELSE 0 END)) % 4 + 1)::INT, 1) for p in range(5)], lambda u, v: u || v)) AS w FROM (SELECT DISTINCT m, n FROM item)
), h AS (
  SELECT (m % 5)::VARCHAR || '__' || m || '__' || m * 10 AS MARKERS, (m % 5)::VARCHAR AS CHROM, m::VARCHAR AS LOCUS, (m * 10)::VARCHAR AS POS, w[1] AS REF, array_to_string(w[2:], ',') AS ALT, INDIVIDUALS, STRATA, w[x + 1] AS A1, w[y + 1] AS A2, w, AD
  FROM called JOIN words USING (m, n) JOIN samples USING (INDIVIDUALS)
), hc AS (
  SELECT MARKERS, INDIVIDUALS, STRATA, unnest([A1, A2]) AS ALLELES FROM h
)"""
