"""The data model: one long genotype table with sample and marker dimensions.

``genotypes`` has a row for each sample and marker; a missing genotype has a null ``GT_BIN``.
Optional columns are nullable; operators decide by ``df.columns``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITELIST = "whitelist"
MARKER_COLUMNS = ("MARKERS", "CHROM", "LOCUS", "POS", "COL", "REF", "ALT", "FILTER", "REP_AVG")
SAMPLE_COLUMNS = ("INDIVIDUALS", "STRATA")
CALL_COLUMNS = ("GT_BIN", "READ_DEPTH", "ALLELE_REF_DEPTH", "ALLELE_ALT_DEPTH")


@dataclass(frozen=True)
class Dataset:
    """Genotypes with both dimensions; each dimension row has the filter that removed it, or ``whitelist``."""

    genotypes: DataFrame
    markers: DataFrame
    individuals: DataFrame
    ledger: tuple[dict, ...] = ()
    source: str = "tidy"
    info: dict = field(default_factory=dict)

    @staticmethod
    def from_tidy(tidy: DataFrame, source: str = "tidy") -> Dataset:
        """Split a long table into the fact and its dimensions."""
        have = set(tidy.columns)
        m = [c for c in MARKER_COLUMNS if c in have]
        s = [c for c in SAMPLE_COLUMNS if c in have]
        calls = ["MARKERS", "INDIVIDUALS", *[c for c in tidy.columns if c not in MARKER_COLUMNS and c not in SAMPLE_COLUMNS]]
        markers = _dimension(tidy.select(*m), "MARKERS").withColumn("FILTERS", F.lit(WHITELIST))
        people = _dimension(tidy.select(*s), "INDIVIDUALS").withColumn("FILTERS", F.lit(WHITELIST))
        return Dataset(tidy.select(*calls), markers, people, source=source)

    def live(self) -> DataFrame:
        """The long table of whitelisted markers and samples, dimensions joined in."""
        m = self.markers.filter(F.col("FILTERS") == WHITELIST).drop("FILTERS")
        s = self.individuals.filter(F.col("FILTERS") == WHITELIST).drop("FILTERS")
        return self.genotypes.join(m, "MARKERS").join(s, "INDIVIDUALS")

    def blacklist_markers(self, bad: DataFrame, name: str) -> Dataset:
        """Tag the markers of ``bad`` (a column MARKERS) with the filter's name; earlier tags stay."""
        return replace(self, markers=tag(self.markers, bad, "MARKERS", name))

    def blacklist_individuals(self, bad: DataFrame, name: str) -> Dataset:
        return replace(self, individuals=tag(self.individuals, bad, "INDIVIDUALS", name))


def _dimension(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key`` of a long table.

    Equal rows go first, in a hash table of the task that reads them: picking a row for each key sorts what it gets, which must not be the
    whole table.  A plain ``distinct`` before it would be optimised away; the filter, which is always true, keeps it.
    """
    own = rows.groupBy(*rows.columns).agg(F.max(F.lit(1)).alias("__one")).filter("__one = 1").drop("__one")
    return own.dropDuplicates([key])


def tag(dim: DataFrame, bad: DataFrame, key: str, name: str) -> DataFrame:
    """``dim`` with FILTERS = ``name`` where a whitelisted key is in ``bad``."""
    hit = bad.select(F.col(key)).distinct().withColumn("__bad", F.lit(True))
    status = F.when(F.col("__bad") & (F.col("FILTERS") == WHITELIST), F.lit(name)).otherwise(F.col("FILTERS"))
    cols = dim.columns
    return dim.join(hit, key, "left").withColumn("FILTERS", status).select(*cols)
