"""Statistics of markers with any number of alleles: single bases, haplotypes, sites with several alternates.

Alleles are words.  A marker has a dictionary: its alleles with a count (and depth) for each, in place of the three counts of
dosages that two alleles need.  One aggregate over allele copies makes it, combined on the map side; everything else works on a row
for each marker (and stratum) and allele.

Calls are ``GT_VCF_NUC`` (``AC/AT``, phased or not; ``./.`` is missing).  ``REF`` and ``ALT`` (a comma between alleles), where they
are, say which alleles a marker has and in which order; ``AD`` holds depths in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "OVERALL"


def sides(call: Column) -> Column:
    """The alleles of a call as an array; none where one is missing."""
    a = F.split(F.translate(call, "|", "/"), "/")
    return F.when(~F.arrays_overlap(a, F.array(F.lit("."), F.lit(""), F.lit("NA"))), a)


def copies(g: DataFrame, *keys: str) -> DataFrame:
    """A row for each copy of an allele of ``g``'s calls: (``keys``, MARKERS, ALLELES)."""
    return g.select(*keys, "MARKERS", F.explode(sides(F.col("GT_VCF_NUC"))).alias("ALLELES"))


def _declared(g: DataFrame) -> Column:
    return F.array_distinct(F.concat(F.array("REF"), F.filter(F.split("ALT", ","), lambda x: ~x.isin(".", ""))))


def _counted(g: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, MARKERS, ALLELES, N): copies of each allele where it occurs; two equal copies of a call are one row until then."""
    x = g.select(*keys, "MARKERS", sides(F.col("GT_VCF_NUC")).alias("__a"))
    same = (F.size("__a") == 2) & (F.get("__a", F.lit(0)) == F.get("__a", F.lit(1)))
    x = x.select(*keys, "MARKERS", F.when(same, 2).otherwise(1).alias("__w"), F.explode(F.when(same, F.slice("__a", 1, 1)).otherwise(F.col("__a"))).alias("ALLELES"))
    return x.groupBy(*keys, "MARKERS", "ALLELES").agg(F.sum("__w").alias("N"))


def allele_table(g: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, MARKERS, ALLELES, N): copies of each allele; with ``keys``, alleles that a key lacks have 0 there.

    A marker's alleles and keys meet in its own row, so that what lies together by marker is not dealt again.
    """
    n = _counted(g, *keys)
    if not keys:
        return n
    each = n.groupBy("MARKERS").agg(F.collect_list(F.struct(F.struct(*keys).alias("k"), F.col("ALLELES").alias("a"), F.col("N").alias("n"))).alias("v"))
    each = each.select("MARKERS", F.map_from_entries(F.transform("v", lambda x: F.struct(F.struct(x["k"], x["a"]), x["n"]))).alias("v"), F.array_distinct(F.transform("v", lambda x: x["a"])).alias("a"), F.array_distinct(F.transform("v", lambda x: x["k"])).alias("k"))
    each = each.select("MARKERS", "v", "k", F.explode("a").alias("ALLELES")).select("MARKERS", "v", "ALLELES", F.explode("k").alias("k"))
    return each.select("k.*", "MARKERS", "ALLELES", F.coalesce(F.try_element_at("v", F.struct("k", F.col("ALLELES").alias("a"))), F.lit(0)).cast("long").alias("N"))


def dictionary(g: DataFrame, depth: bool = False) -> DataFrame:
    """(MARKERS, ALLELES, COUNTS[, DEPTHS]), arrays in one order: that of REF and ALT, else the commonest first, ties by name.

    Alleles that are declared and never called have 0; those that are called and not declared come last, by name.  Depths are sums
    of ``AD`` over samples.
    """
    n = allele_table(g)
    if "REF" not in g.columns:
        x = n.groupBy("MARKERS").agg(F.array_sort(F.collect_list(F.struct((-F.col("N")).alias("o"), F.col("ALLELES").alias("a"), F.col("N").alias("n")))).alias("x"))
        return x.select("MARKERS", F.transform("x", lambda v: v["a"]).alias("ALLELES"), F.transform("x", lambda v: v["n"]).alias("COUNTS"))
    # calls of a marker are counted, then its alleles in them: one pass over the genotypes
    calls = g.groupBy("MARKERS", "GT_VCF_NUC").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("REF", "ALT")).alias("s"))
    x = calls.groupBy("MARKERS").agg(F.min("s").alias("s"), F.collect_list(F.when(sides(F.col("GT_VCF_NUC")).isNotNull(), F.struct(sides(F.col("GT_VCF_NUC")).alias("a"), "n"))).alias("v"))
    x = x.select("MARKERS", "v", "s.REF", "s.ALT")
    x = x.select("MARKERS", "v", F.coalesce(_declared(x), F.array().cast("array<string>")).alias("own"))
    called = F.array_distinct(F.flatten(F.transform("v", lambda c: c["a"])))
    x = x.select("MARKERS", "v", F.size("own").alias("of"), F.concat("own", F.array_sort(F.array_except(called, "own"))).alias("ALLELES")).filter(F.size("ALLELES") > 0)
    copies_of = lambda a: F.aggregate("v", F.lit(0).cast("long"), lambda t, c: t + c["n"] * F.size(F.filter(c["a"], lambda b: b == a)))
    x = x.select("MARKERS", "ALLELES", "of", F.transform("ALLELES", copies_of).alias("COUNTS"))
    if not depth:
        return x.drop("of")
    d = g.filter("AD is not null").select("MARKERS", F.posexplode("AD").alias("o", "d")).groupBy("MARKERS", "o").agg(F.sum("d").cast("long").alias("D"))
    d = d.groupBy("MARKERS").agg(F.map_from_entries(F.collect_list(F.struct("o", "D"))).alias("d"))
    at = lambda a, i: F.when(i < F.col("of"), F.coalesce(F.try_element_at("d", i), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return x.join(d, "MARKERS", "left").select("MARKERS", "ALLELES", "COUNTS", F.transform("ALLELES", at).alias("DEPTHS"))


def maf(g: DataFrame) -> DataFrame:
    """Local and global counts and frequencies of each allele by stratum, and its role.

    The commonest allele of all is REF, the rarest of the others MAF, the rest are ALT; ties go to the smaller name.
    """
    n = _counted(g, "STRATA").groupBy("MARKERS").agg(F.collect_list(F.struct(F.col("STRATA").alias("s"), F.col("ALLELES").alias("a"), F.col("N").alias("n"))).alias("v"), F.sum("N").alias("g"))
    each = lambda f: F.array_distinct(F.transform("v", lambda x: x[f]))
    total = lambda f, of: F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + F.when(x[f] == of, x["n"]).otherwise(0))
    # in a marker's own row: its alleles, the commonest first, its strata, and the copies of each
    n = n.select("MARKERS", "g", F.map_from_entries(F.transform("v", lambda x: F.struct(F.struct(x["s"], x["a"]), x["n"]))).alias("at"),
                 F.array_sort(F.transform(each("a"), lambda a: F.struct((-total("a", a)).alias("o"), a.alias("a")))).alias("x"), F.transform(each("s"), lambda s: F.struct(s.alias("s"), total("s", s).alias("n"))).alias("l"))
    least = F.array_min(F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda y: F.struct((-y["o"]).alias("n"), y["a"].alias("a"))))["a"]
    t = n.select("MARKERS", "g", "at", "l", least.alias("least"), F.posexplode("x").alias("p", "x")).select("*", F.explode("l").alias("k"))
    local, both = F.coalesce(F.try_element_at("at", F.struct("k.s", "x.a")), F.lit(0)).cast("long"), -F.col("x.o")
    role = F.when(F.col("p") == 0, "REF").when(F.col("x.a") == F.col("least"), "MAF").otherwise("ALT")
    return t.select("MARKERS", F.col("k.s").alias("STRATA"), F.col("x.a").alias("HAPLOTYPES"), local.alias("ALT_LOCAL"), F.try_divide(local, F.col("k.n")).alias("MAF_LOCAL"), both.alias("ALT_GLOBAL"), F.try_divide(both, F.col("g")).alias("MAF_GLOBAL"), role.alias("REF"))


def minor_alleles(g: DataFrame, calibrate: str = "count", biallelic: bool = False) -> DataFrame:
    """Minor allele statistics of each marker, all alternate alleles together.

    ``ALT_N`` alleles, ``ALT_COUNTS`` copies of each alternate one, ``MAC_GLOBAL`` their sum and ``MAF_GLOBAL`` its share.  Unless the
    reference is the ancestral state (``calibrate="ancestral"``), the ``_CORR`` columns have the rarer side instead; ``depth`` adds the
    same by read depths (MAD).  FILTERS says why a marker is left out of minor allele filters: nothing but alternate alleles
    (``monomorphic``), or, where ``biallelic`` is asked for, more than two alleles (``multi-allelic``).
    """
    if calibrate not in ("count", "depth", "ancestral"):
        raise ValueError(f"no such calibration: {calibrate}")
    d = dictionary(g, calibrate == "depth")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    ref, alt = F.get("COUNTS", F.lit(0)), total(rest("COUNTS"))
    why = F.when(F.lit(biallelic) & (F.size("ALLELES") > 2), "multi-allelic").when(ref == 0, "monomorphic").otherwise("whitelist")
    out = [F.size("ALLELES").alias("ALT_N"), rest("COUNTS").alias("ALT_COUNTS"), alt.alias("MAC_GLOBAL"), F.try_divide(alt, ref + alt).alias("MAF_GLOBAL"), why.alias("FILTERS")]
    if calibrate != "ancestral":
        out += [(alt >= ref).alias("INVERSION_COUNT"), F.least(alt, ref).alias("MAC_GLOBAL_CORR"), F.try_divide(F.least(alt, ref), ref + alt).alias("MAF_GLOBAL_COUNT_CORR")]
    if calibrate == "depth":
        rd, ad = F.get("DEPTHS", F.lit(0)), total(rest("DEPTHS"))
        out += [(ad >= rd).alias("INVERSION_DEPTH"), ad.alias("MAD_GLOBAL"), F.least(ad, rd).alias("MAD_GLOBAL_CORR"), F.try_divide(F.least(ad, rd), rd + ad).alias("MAF_GLOBAL_DEPTH_CORR")]
    return d.select("MARKERS", *out)


def roles(g: DataFrame, calibrate: str = "count", ancestral: DataFrame | None = None) -> DataFrame:
    """(MARKERS, REF, ALT, INVERSION): the reference anew, by count, by depth, or from a table (MARKERS, ANCESTRAL); ALT keeps its order.

    Ties leave the reference as it is, then go to the earlier alternate; an ancestral allele that the marker lacks changes nothing.
    """
    d = dictionary(g, calibrate == "depth")
    if calibrate == "ancestral":
        d = d.join(ancestral.select("MARKERS", "ANCESTRAL").dropDuplicates(["MARKERS"]), "MARKERS", "left")
        at = F.greatest(F.coalesce(F.array_position("ALLELES", F.col("ANCESTRAL")), F.lit(0)), F.lit(1))
    else:
        values = "DEPTHS" if calibrate == "depth" else "COUNTS"
        at = F.array_position(F.col(values), F.array_max(values))
    d = d.withColumn("__at", at.cast("int"))
    own = F.element_at("ALLELES", F.col("__at"))
    return d.select("MARKERS", own.alias("REF"), F.array_join(F.filter("ALLELES", lambda x: x != own), ",").alias("ALT"), (F.col("__at") > 1).alias("INVERSION"))


def recalibrate(g: DataFrame, calibrate: str = "count", ancestral: DataFrame | None = None) -> DataFrame:
    """``g`` with REF and ALT by ``roles``, GT_BIN the copies of alternate alleles (all of them), and AD in the new order."""
    new = roles(g, calibrate, ancestral).select("MARKERS", F.col("REF").alias("__ref"), F.col("ALT").alias("__alt"))
    x = g.withColumn("__old", _declared(g)).join(new, "MARKERS")
    order = F.concat(F.array("__ref"), F.filter(F.split("__alt", ","), lambda a: a != ""))
    a = sides(F.col("GT_VCF_NUC"))
    out = {"REF": F.col("__ref"), "ALT": F.col("__alt"), "GT_BIN": F.when(F.size(a) == 2, F.size(F.filter(a, lambda v: v != F.col("__ref")))).cast("int")}
    if "AD" in g.columns:
        out["AD"] = F.when(F.col("AD").isNotNull(), F.transform(order, lambda v: F.get("AD", (F.array_position("__old", v) - 1).cast("int"))))
    return x.select(*[out[c].alias(c) if c in out else F.col(c) for c in g.columns], *[c.alias(n) for n, c in out.items() if n not in g.columns])


def hamming(a: Column, b: Column) -> Column:
    """Places at which two words differ; of words of unequal length, places beyond the shorter one differ."""
    apart = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    return F.when(a == b, 0).otherwise(apart)  # most words are equal: they are not taken apart


def pi_markers(g: DataFrame, read_length: int, *keys: str) -> DataFrame:
    """Nucleotide diversity of each marker (and key): sum over pairs of alleles a < b of f_a f_b differences / length.

    Pairs are those of one marker's alleles, counted in its row; a marker with one allele has 0.
    """
    n = _counted(g, *keys).groupBy("MARKERS", *keys).agg(F.collect_list(F.struct(F.col("ALLELES").alias("a"), F.col("N").cast("double").alias("n"))).alias("v"), F.sum("N").cast("double").alias("t"))
    pair = lambda x, y: F.when(x["a"] < y["a"], x["n"] * y["n"] * hamming(x["a"], y["a"])).otherwise(0.0)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: F.aggregate("v", s, lambda u, y: u + pair(x, y)))
    return n.select("MARKERS", *keys, (F.when(F.size("v") > 1, total).otherwise(0.0) / (F.col("t") * F.col("t")) / read_length).alias("PI"))


def pi_pop(g: DataFrame, read_length: int) -> DataFrame:
    """Mean of the markers' diversity by stratum, and OVERALL over all samples; rounded to 9."""
    a = pi_markers(g, read_length, "STRATA").groupBy("STRATA").agg(F.round(F.avg("PI"), 9).alias("PI"))
    return a.unionByName(pi_markers(g, read_length).agg(F.round(F.avg("PI"), 9).alias("PI")).select(F.lit(OVERALL).alias("STRATA"), "PI"))


def pi_individuals(g: DataFrame, read_length: int) -> DataFrame:
    """Mean over its called markers of the differences between a sample's two alleles / length, rounded to 9."""
    a = sides(F.col("GT_VCF_NUC"))
    # of other calls nothing is averaged; a filter would work out every call twice
    apart = F.when(F.size("__a") == 2, hamming(F.get("__a", F.lit(0)), F.get("__a", F.lit(1))))
    x = g.select("INDIVIDUALS", "STRATA", a.alias("__a")).select("INDIVIDUALS", "STRATA", apart.alias("__d"))
    return x.groupBy("INDIVIDUALS", "STRATA").agg(F.round(F.avg("__d") / read_length, 9).alias("PI")).filter("PI is not null")


def heterozygosity(g: DataFrame) -> DataFrame:
    """(MARKERS, STRATA, N, N_ALLELES, HET_OBS, HET_EXP): calls with two alleles, and 1 - the sum of squared frequencies; to 9."""
    a = sides(F.col("GT_VCF_NUC"))
    o = g.withColumn("__a", a).filter("size(__a) = 2").groupBy("MARKERS", "STRATA").agg(F.count(F.lit(1)).alias("N"), F.round(F.avg((F.get("__a", F.lit(0)) != F.get("__a", F.lit(1))).cast("int")), 9).alias("HET_OBS"))
    n = _counted(g, "STRATA")
    e = n.groupBy("MARKERS", "STRATA").agg(F.count(F.lit(1)).alias("N_ALLELES"), F.round(1 - F.sum(F.col("N") * F.col("N")) / F.pow(F.sum("N"), F.lit(2)), 9).alias("HET_EXP"))
    return o.join(e, ["MARKERS", "STRATA"]).select("MARKERS", "STRATA", "N", "N_ALLELES", "HET_OBS", "HET_EXP")
