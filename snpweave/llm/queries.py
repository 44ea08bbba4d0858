"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment as al
from . import ann
from . import decontaminate as dc
from . import divergence as dv
from . import language_id as li
from . import license_scan as ls
from . import line_dedup as ld
from . import minhash_dedup as md
from . import mixing as mx
from . import pii
from . import quality as qc
from . import token_counts as tc
from . import toxicity as tx


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from labels whose crc32 modulo 4 is not 2."""
    return qc.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose vec_id is divisible by 50."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return ls.scan(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document's restored text; learnt from labels whose crc32 modulo 5 is not 0."""
    return tx.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak items of the benchmark, with the items."""
    return dc.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 80 of 100 on sets of 2-word shingles, and their components."""
    return md.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP6_SQL = None


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1; 150% of all words; no source over twice its size."""
    return mx.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)


def _position_sql(knots, due: str) -> str:
    area = mx.integral(knots)
    out = "1.0"
    for k in range(len(knots) - 2, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = f"(y - {area[k]!r})"
        t = f"{rest} / {w0!r}" if slope == 0 else f"(sqrt(greatest({w0 * w0!r} + {2 * slope!r} * {rest}, 0.0)) - {w0!r}) / {slope!r}"
        out = f"CASE WHEN y < {area[k + 1]!r} THEN {t0!r} + {t} ELSE {out} END"
    return f"(SELECT {out} FROM (SELECT ({due} * {area[-1]!r})::DOUBLE AS y))"


def mixing_sql(table: str = "documents") -> str:
    """DuckDB SQL of ``op7_source_mixing`` over a table."""
    pos, again = (" ".join(f"WHEN place % 3 = {k} THEN {_position_sql(s, due)}" for k, s in enumerate((mx.FADE, mx.STEADY, mx.RISE))) for due in ("due", "due_again"))
    return f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM {table}
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS want FROM placed
), levels AS (
  SELECT *, (want - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed
), level AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, place LIMIT 1
), goal AS (
  SELECT w.source, place, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level) * weight, cap::DOUBLE)) AS target FROM weighed w
), laid AS (
  SELECT b.doc_id, b.size, g.place, g.source_size, g.target,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source
), cut AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start))::BIGINT AS once, greatest(0, least(size, floor(target)::BIGINT - start - source_size))::BIGINT AS again,
    start::DOUBLE / nullif(target, 0) AS due, (start + source_size)::DOUBLE / nullif(target, 0) AS due_again FROM laid
)
SELECT doc_id, size, source_size, target, once + again AS taken, CASE WHEN once > 0 THEN round(CASE {pos} END, 9) END AS position, CASE WHEN again > 0 THEN round(CASE {again} END, 9) END AS repeat_position FROM cut
"""


OP7_SQL = mixing_sql()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by sentence; a token on a boundary belongs to the sentence of most of its bytes."""
    return tc.section_tokens(_table(spark, sf_dir, "documents"), rule="most", sections=tc.sentences)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 20 code points or more that 3 documents hold stay in the largest doc_id only."""
    return ld.line_digest(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.line, a.pos, c.k IS NOT NULL AND a.doc_id < c.top AS gone FROM keyed a LEFT JOIN common c ON a.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and best links of two public tokenizers in every document."""
    return al.align_tokenizers(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from documents whose crc32 modulo 5 is not 0."""
    return li.identify(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language stand apart, and the terms that mark each."""
    return dv.divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


OP13_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
  SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(w) AS term FROM base) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS whole FROM found GROUP BY ALL HAVING count(*) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM base
), counts AS (
  SELECT f.lang, f.source, f.term, sum(f.n) AS n FROM found f SEMI JOIN kept k USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), langs AS (
  SELECT lang, sum(whole)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0)::HUGEINT + 2)) // (s.total + 2 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.whole::HUGEINT + 2)) // (l.total + 2 * l.v))::BIGINT AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    found = {k: globals().get(f"{k.split('_')[0].upper()}_SQL") for k in queries()}
    return {k: v for k, v in found.items() if v}
