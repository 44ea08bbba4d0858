"""Pairs of samples: genome similarity, distances; groups of linked markers and of duplicates.

Pairs are inherent here (every pair is the result).  They come from products of blocks: a pair of blocks of samples is a unit of
work, which meets the markers in slices, one after the other, and adds up its counts.  A task holds the counts of two blocks and one slice of
their genotypes, whatever the size of the data; only packed genotypes are shuffled, never a row for a cell or a pair.  What is asked of the pairs
(the largest distance, those under a threshold, the groups that they link) is taken in the task.  Linkage of markers is in ``ld``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ld import indexed, linkage  # noqa: F401  linkage is this module's too
from .order import checkpointed, numbered

#: samples in a block, and markers in a slice
BLOCK, SLICE = 2048, 8192
#: blocks at least, where there are as many slices and samples; markers of one product; pairs that leave a task at once
SPREAD, STRIP, BATCH = 12, 1024, 65_536

_LOW = np.array([[b >> s & 3 for s in (0, 2, 4, 6)] for b in range(256)], np.int8)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places and dosages of a row's called genotypes as two bits for each place; 3 is missing."""
    for pdf in batches:
        out = []
        for js, ds in zip(pdf["js"], pdf["ds"], strict=True):
            x = np.full(-4 * (-(1 + int(js.max())) // 4), 3, np.uint8)
            x[js] = ds
            out.append((x.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes())
        yield pdf.drop(columns=["js", "ds"]).assign(x=out)


def _dosages(rows: list[bytes]) -> np.ndarray:
    width = max(len(r) for r in rows)
    return _LOW[np.frombuffer(b"".join(r.ljust(width, b"\xff") for r in rows), np.uint8)].reshape(len(rows), 4 * width)


def _signs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of dosages: called or not, and 1 or -1 for a first and a second copy or none (0 where not called)."""
    c = (v < 3).astype(np.float32)
    return c, np.where(v > 0, c, -c), np.where(v > 1, c, -c)


class _Unit:
    """A pair of blocks: its samples and their counts, filled slice by slice; only what is in ``counts`` is counted besides markers in common."""

    def __init__(self, size: tuple[int, int], same: bool, counts: tuple[str, ...] = ("identical", "absdiff")):
        self.same, self.size, self.held, self.counts = same, size, ({}, {}), counts
        self.ids, self.pops = ([""] * size[0], [""] * size[1]), ([None] * size[0], [None] * size[1])
        self.common, self.identical, self.absdiff = (np.zeros(size if c == "common" or c in counts else (0, 0), np.int32) for c in ("common", "identical", "absdiff"))

    def take(self, side: int, at: int, name: str, pop: str | None, x: bytes) -> None:
        self.ids[side][at], self.pops[side][at], self.held[side][at] = name, pop, x

    def add(self) -> None:
        """The counts of the slice that is held.

        A call is two signs, whether it has a first and a second copy.  The product of two samples' signs tells how many copies differ,
        and that of the product of both signs whether it is one: |a - b| and equality take three products besides markers in common.
        """
        if self.held[0] and self.held[1]:
            at = tuple(np.array(sorted(h)) for h in self.held)
            x = [_dosages([h[i] for i in k]) for h, k in zip(self.held, at, strict=True)]
            width = min(x[0].shape[1], x[1].shape[1])
            place = ... if tuple(map(len, at)) == self.size else np.ix_(*at)
            for k in range(0, width, STRIP):
                (c, a1, a2), (d, b1, b2) = (_signs(y[:, k : min(k + STRIP, width)]) for y in x)
                both = c @ d.T
                turned = np.hstack([a1, a2]) @ np.hstack([b1, b2]).T
                self.common[place] += both.astype(np.int32)
                if "identical" in self.counts:
                    self.identical[place] += ((both + turned + (a1 * a2) @ (b1 * b2).T) / 4).astype(np.int32)
                if "absdiff" in self.counts:
                    self.absdiff[place] += (both - turned / 2).astype(np.int32)
        self.held = ({}, {})

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of pairs with markers in common, some rows of the first block at a time; each pair once."""
        if self.same:
            order = np.unique(self.ids[0], return_inverse=True)[1]
        step = max(1, BATCH // max(1, self.size[1]))
        for r in range(0, self.size[0], step):
            want = self.common[r : r + step] > 0
            if self.same:
                want = want & (order[r : r + step, None] < order[None, :])
            i, j = np.nonzero(want)
            yield i + r, j

    def top(self, method: str) -> float | None:
        """The largest distance of a pair with markers in common, straight from the counts."""
        want = self.common > 0
        if self.same:
            order = np.unique(self.ids[0], return_inverse=True)[1]
            want &= order[:, None] != order[None, :]
        if not want.any():
            return None
        if method == "manhattan":
            return 2.0 * float(self.absdiff.max(where=want, initial=0))
        return float(max((self.absdiff[r] / (2.0 * np.maximum(self.common[r], 1))).max(where=want[r], initial=0.0) for r in range(len(want))))

    @functools.cached_property
    def _names(self) -> tuple[pa.Array, pa.Array, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Names, strata, the places of the names in order, and strata as numbers (a missing one is like no other), when the samples are taken."""
        ids, pops, seen = self.ids[0] + self.ids[1], self.pops[0] + self.pops[1], {}
        codes = tuple(np.array([-1 - side if s is None else seen.setdefault(s, len(seen)) for s in own], int) for side, own in enumerate(self.pops))
        return pa.array(ids, pa.string()), pa.array(pops, pa.string()), np.unique(ids, return_inverse=True)[1], codes

    def named(self, i: np.ndarray, j: np.ndarray, strata: bool = True) -> list[pa.Array]:
        """ID1, ID2, and their strata if wanted: the smaller name first."""
        n, (ids, pops, order, _) = self.size[0], self._names
        turn = order[i] > order[n + j]
        a, b = pa.array(np.where(turn, n + j, i)), pa.array(np.where(turn, i, n + j))
        return [ids.take(a), ids.take(b), *([pops.take(a), pops.take(b)] if strata else [])]

    def pop_comp(self, i: np.ndarray, j: np.ndarray) -> pa.Array:
        first, second = self._names[3]
        return pa.array(["different pop", "same pop"]).take(pa.array((first[i] == second[j]).astype(np.int8)))

    def distances(self, method: str, i=..., j=None) -> np.ndarray:
        at = i if j is None else (i, j)
        return 2.0 * self.absdiff[at] if method == "manhattan" else self.absdiff[at] / (2.0 * self.common[at])


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """An order by ``columns``, the first one first; of few different values by their number, in time that grows with the rows only."""
    low, spans = [int(c.min()) for c in columns], [int(c.max()) - int(c.min()) + 1 for c in columns]
    if math.prod(spans) > 1 << 16:
        return np.lexsort(columns[::-1])
    key = 0
    for c, least, span in zip(columns, low, spans, strict=True):
        key = key * span + (c - least)
    return np.argsort(key.astype(np.uint16), kind="stable")


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in names.split(", ")])


def _units(finish: Callable[[_Unit], Iterator[pa.RecordBatch]], counts: tuple[str, ...]):
    """What ``finish`` makes of each unit of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now, part = None, None, None
        for batch in batches:
            for lo, hi, m, b, at, n_lo, n_hi, name, pop, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lo, hi) != now:
                    if unit is not None:
                        unit.add()
                        yield from finish(unit)
                    unit, now, part = _Unit((n_lo, n_hi), lo == hi, counts), (lo, hi), m
                if m != part:
                    unit.add()
                    part = m
                for side in (0, 1):
                    if b == (lo, hi)[side]:
                        unit.take(side, at, name, pop, x)
        if unit is not None:
            unit.add()
            yield from finish(unit)

    return run


class _Dealt:
    """The called genotypes of ``g``, packed and staged, and the pairs of blocks that they are dealt to."""

    def __init__(self, g: DataFrame):
        called = g.filter("GT_BIN is not null")
        markers = indexed(called, "MARKERS", SLICE).withColumnRenamed("block", "m").withColumnRenamed("at", "j")
        rows = called.join(markers, "MARKERS").groupBy("m", "INDIVIDUALS", "STRATA").agg(F.collect_list(F.struct("j", F.col("GT_BIN").cast("byte").alias("d"))).alias("v"))
        rows = rows.select("m", "INDIVIDUALS", "STRATA", F.transform("v", lambda v: v["j"]).alias("js"), F.transform("v", lambda v: v["d"]).alias("ds"))
        own = checkpointed(rows.mapInPandas(_packed, "m int, INDIVIDUALS string, STRATA string, x binary"))
        samples = own.select("INDIVIDUALS", "STRATA").distinct()
        n, slices = samples.count(), own.agg(F.max("m")).first()[0]
        blocks = max(1, -(-n // BLOCK), min(SPREAD, n, 0 if slices is None else slices))
        self.blocks, self.partitions = blocks, min(blocks * (blocks + 1) // 2, 1024)
        w = Window.partitionBy("b")
        # blocks by name: the first name of the pairs that a task writes stays for long runs, the second repeats, and both are stored in little
        names = samples.select("INDIVIDUALS").distinct()
        rank = numbered(names, "r", "INDIVIDUALS").withColumn("b", F.floor((F.col("r") - 1).cast("long") * blocks / max(n, 1)).cast("int")).drop("r")
        samples = samples.join(rank, "INDIVIDUALS")
        samples = samples.select("*", (F.row_number().over(w.orderBy("INDIVIDUALS", "STRATA")) - 1).alias("at"), F.count(F.lit(1)).over(w).cast("int").alias("n"))
        sizes = samples.select(F.col("b").alias("c"), F.col("n").alias("n_c")).distinct()
        at = samples.select(F.col("INDIVIDUALS").alias("i"), F.col("STRATA").alias("s"), "b", "at", "n")
        dealt = own.join(at, (F.col("INDIVIDUALS") == F.col("i")) & F.col("STRATA").eqNullSafe(F.col("s"))).crossJoin(F.broadcast(sizes))
        size = lambda first: F.when((F.col("b") <= F.col("c")) == F.lit(first), F.col("n")).otherwise(F.col("n_c"))
        self.rows = dealt.select(F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "m", "b", "at", size(True).alias("n_lo"), size(False).alias("n_hi"), "INDIVIDUALS", "STRATA", "x")

    def solved(self, finish: Callable[[_Unit], Iterator[pa.RecordBatch]], schema: str, counts: tuple[str, ...] = ("absdiff",)) -> DataFrame:
        # units are dealt in turn, so that no task has two of them before each has one
        lo, hi = F.col("lo").cast("long"), F.col("hi").cast("long")
        unit = (lo * (2 * self.blocks - 1 - lo) / 2).cast("long") + hi
        return self.rows.repartitionById(self.partitions, F.pmod(unit, F.lit(self.partitions)).cast("int")).sortWithinPartitions("lo", "hi", "m").mapInArrow(_units(finish, counts), schema)

    def largest(self, method: str) -> float | None:
        """The largest distance: a number for each unit leaves the tasks."""

        def finish(unit: _Unit):
            top = unit.top(method)
            if top is not None:
                yield _batch([[top]], "d")

        return self.solved(finish, "d double").agg(F.max("d")).first()[0]


_NAMED = "ID1 string, ID2 string, ID1_STRATA string, ID2_STRATA string"


def pair_counts(g: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(ID1, ID2, ID1_STRATA, ID2_STRATA, COMMON, IDENTICAL, ABSDIFF) of each pair of samples with markers in common; ID1 < ID2.

    Samples are dealt in blocks of about ``BLOCK``, markers in slices of about ``SLICE``.  With ``by``, some of ``common``,
    ``identical`` and ``absdiff``, the pairs of a batch leave their task by these counts: columns that follow from them
    come in runs, which are stored in little.
    """
    schema = f"{_NAMED}, COMMON long, IDENTICAL long, ABSDIFF long"

    def finish(unit: _Unit):
        for i, j in unit.pairs():
            if len(i):
                if by:
                    order = _runs([getattr(unit, c)[i, j] for c in by])
                    i, j = i[order], j[order]
                yield _batch([*unit.named(i, j), *[c[i, j].astype(np.int64) for c in (unit.common, unit.identical, unit.absdiff)]], schema)

    return _Dealt(g).solved(finish, schema, ("identical", "absdiff"))


def _pop_comp():
    return F.when(F.col("ID1_STRATA") == F.col("ID2_STRATA"), "same pop").otherwise("different pop").alias("POP_COMP")


def genome_similarity(g: DataFrame) -> DataFrame:
    """Markers in common, identical and different of each pair, and their proportions.

    A batch of pairs leaves its task by its counts, with nothing but what the result shows.
    """
    n = g.select("MARKERS").distinct().count()
    total, c, i = F.lit(n).cast("long"), F.col("COMMON"), F.col("IDENTICAL")
    schema = "ID1 string, ID2 string, POP_COMP string, COMMON long, IDENTICAL long"

    def finish(unit: _Unit):
        for i, j in unit.pairs():
            if len(i):
                order = _runs([unit.common[i, j], unit.identical[i, j]])
                i, j = i[order], j[order]
                yield _batch([*unit.named(i, j, strata=False), unit.pop_comp(i, j), unit.common[i, j].astype(np.int64), unit.identical[i, j].astype(np.int64)], schema)

    return _Dealt(g).solved(finish, schema, ("identical",)).select("ID1", "ID2", "POP_COMP", total.alias("MARKERS_TOTAL"), c.alias("MARKERS_COMMON"), (c / total).alias("MARKERS_COMMON_PROP"), (total - c).alias("MARKERS_MISSING"),
                                 "IDENTICAL", (c - i).alias("DIFFERENT"), (i / c).alias("IDENTICAL_PROP"), (i / total).alias("IDENTICAL_PROP_TOTAL"))


def distance(g: DataFrame, method: str = "manhattan", below: float | None = None) -> DataFrame:
    """Distance of each pair: ``manhattan`` over both allele counts (2 |a - b|) or ``ibs`` (mean of |a - b| / 2), also relative to the largest.

    With ``below``, pairs whose relative distance is under it; others never leave their task.
    """
    dealt = _Dealt(g)
    top = dealt.largest(method)
    schema = f"{_NAMED}, DISTANCE double"

    def finish(unit: _Unit):
        for i, j in unit.pairs():
            d = unit.distances(method, i, j)
            if below is not None:
                near = d / top < below if top else np.zeros(len(d), bool)
                i, j, d = i[near], j[near], d[near]
            if len(i):
                yield _batch([*unit.named(i, j), d], schema)

    p = dealt.solved(finish, schema).select("ID1", "ID2", F.col("ID1_STRATA").alias("ID1_POP"), F.col("ID2_STRATA").alias("ID2_POP"), _pop_comp(), "DISTANCE")
    return p.withColumn("DISTANCE_RELATIVE", F.try_divide("DISTANCE", F.lit(top).cast("double")))


def distance_pairs(g: DataFrame) -> DataFrame:
    """What ``matrix_to_pairs`` makes of the square matrix of distances (2 |a - b|), without its cells: each pair once, in batches by distance, the largest from a number for each unit."""
    dealt = _Dealt(g)
    top = dealt.largest("manhattan")
    schema = "ID1 string, ID2 string, DISTANCE double"

    def finish(unit: _Unit):
        for i, j in unit.pairs():
            if len(i):
                order = _runs([unit.absdiff[i, j]])
                i, j = i[order], j[order]
                yield _batch([*unit.named(i, j, strata=False), unit.distances("manhattan", i, j)], schema)

    return dealt.solved(finish, schema).withColumn("DISTANCE_RELATIVE", F.try_divide("DISTANCE", F.lit(top).cast("double")))


def near_samples(g: DataFrame, threshold: float, method: str = "manhattan") -> DataFrame:
    """(ID1, ID2): links of samples nearer than the threshold (relative to the largest distance), as few as keep linked samples linked.

    Of each pair of blocks, a group of samples that near pairs connect is told by links with one of them: fewer than its samples.
    The groups are those of all near pairs.
    """
    dealt = _Dealt(g)
    top = dealt.largest(method)

    def finish(unit: _Unit):
        near = np.zeros(unit.size, bool)
        for i, j in unit.pairs():
            near[i, j] = unit.distances(method, i, j) / top < threshold if top else False
        if unit.same:
            near |= near.T
        i, j = _stars(near)
        if len(i):
            yield _batch(unit.named(i, j)[:2], "ID1, ID2")

    return dealt.solved(finish, "ID1 string, ID2 string").filter("ID1 <> ID2")


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links that connect what ``near`` (rows by columns) connects: a breadth-first search, each place taken once."""
    rows, cols = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start in np.flatnonzero(near.any(axis=1)):
        if rows[start]:
            continue
        rows[start], front = True, np.array([start])
        while len(front):
            new = np.flatnonzero(near[front].any(axis=0) & ~cols)
            cols[new] = True
            out.append((front[near[np.ix_(front, new)].argmax(axis=0)], new))
            more = np.flatnonzero(near[:, new].any(axis=1) & ~rows)
            rows[more] = True
            out.append((more, new[near[np.ix_(more, new)].argmax(axis=1)] if len(more) else new[:0]))
            front = more
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, int) for k in (0, 1))


def relative(p: DataFrame) -> DataFrame:
    """DISTANCE_RELATIVE = distance / the largest; the maximum is one row."""
    top = p.agg(F.max("DISTANCE").alias("top"))
    return p.crossJoin(F.broadcast(top)).withColumn("DISTANCE_RELATIVE", F.try_divide("DISTANCE", "top")).drop("top")


def matrix_to_pairs(m: DataFrame, remove_diagonal: bool = True, remove_lower: bool = True) -> DataFrame:
    """A long square matrix (ID1, ID2, DISTANCE) as pairs with relative distances."""
    if remove_lower:
        m = m.filter("ID1 <= ID2")
    return relative(m.filter("ID1 <> ID2") if remove_diagonal else m)


def _star(e: DataFrame) -> DataFrame:
    """``e`` has rows (u, v): with the smallest of u and its neighbours as m."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(low, "u")


def closure(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, grp): the smallest node that edges reach, by alternating large and small stars until nothing changes.

    Rounds grow with the logarithm of the longest path.  Each round's edges, never more than before, are written
    to the shared checkpoint folder, which cuts the lineage.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    cur = e.filter("u <> v")
    after, before = mark(cur), None
    while after != before:
        large = checkpointed(_star(cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        s = _star(large)
        small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v")))
        cur = checkpointed(small.filter("u <> v").distinct())
        after, before = mark(cur), after
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return nodes.join(cur, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("grp"))


def ld_pruning(ld: DataFrame, stats: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Linked groups (LD over the threshold); the best genotyped marker of each stays, ties to the smaller name.

    ``stats`` has (MARKERS, MISSING_PROP); the result lists the markers of the groups with their status.
    """
    grp = closure(ld.filter(F.col("LD") > threshold), "MARKERS_A", "MARKERS_B").withColumnRenamed("node", "MARKERS")
    best = F.row_number().over(Window.partitionBy("grp").orderBy("MISSING_PROP", "MARKERS"))
    return grp.join(stats.select("MARKERS", "MISSING_PROP"), "MARKERS").withColumn("KEEP", best == 1).select("MARKERS", F.col("grp").alias("GROUP"), "KEEP")


def remove_duplicates(pairs: DataFrame, stats: DataFrame, threshold: float | None = None, diff_pop_remove: bool = True) -> DataFrame:
    """Groups of samples nearer than the threshold: the best genotyped stays; groups over several strata go whole.

    ``pairs`` has distances, or links of ``near_samples``, for which no threshold is wanted.
    """
    near = pairs if threshold is None else pairs.filter(F.col("DISTANCE_RELATIVE") < threshold)
    grp = closure(near, "ID1", "ID2").withColumnRenamed("node", "INDIVIDUALS").join(stats.select("INDIVIDUALS", "STRATA", "MISSING_PROP"), "INDIVIDUALS")
    own = grp.groupBy("grp").agg((F.min("STRATA") != F.max("STRATA")).alias("mixed"), F.min(F.struct("MISSING_PROP", "INDIVIDUALS")).alias("best"))
    first = F.col("INDIVIDUALS") == F.col("best.INDIVIDUALS")
    return grp.join(own, "grp").select("INDIVIDUALS", F.col("grp").alias("GROUP"), (first & ~(F.col("mixed") & F.lit(diff_pop_remove))).alias("KEEP"))


def allele_counts(g: DataFrame) -> DataFrame:
    """Copies of each allele by sample and marker, zeros filled in."""
    r = F.struct(F.col("REF").alias("ALLELES"), (2 - F.col("GT_BIN")).alias("COUNT"))
    a = F.struct(F.col("ALT").alias("ALLELES"), F.col("GT_BIN").alias("COUNT"))
    return g.filter("GT_BIN is not null").select("INDIVIDUALS", "MARKERS", F.explode(F.array(r, a)).alias("x")).select("INDIVIDUALS", "MARKERS", "x.*")
