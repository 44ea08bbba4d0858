"""MinHash near-duplicate detection with exact confirmation and star components.

1. Each document becomes its distinct word shingles (64-bit hashes).  Documents with equal sets share
   a 128-bit set fingerprint and collapse to one class (its smallest doc_id) by a map-side combined
   aggregate, so thousands of copies cost one row from here on.
2. Class representatives get ``bands * rows`` universal hash minima; each band's minima make a bucket key.  Only ids
   are dealt by key: the smallest class in a bucket leads it, and a bucket of one class goes no further.
3. Stars: every class meets the leaders of its buckets, signatures (a byte of each minimum) first.  Only pairs whose
   signatures agree fetch their full sets and are confirmed.  Their components join most copies of a group at once.
4. Across: buckets that still hold several components are searched for links between them, for ids and signatures
   first again.  The members outside a bucket's largest component are held in blocks of about ``BLOCK``; all members
   stream past them, in lots of about ``BLOCK``.  Pairs within a component need no look: they change nothing.
5. Alternating large-star and small-star joins find the components of the confirmed edges.

A leader with more than ``BLOCK`` followers is copied to several tasks that share them.  So every pair that shares a
bucket is either compared or known to be connected, nothing is capped, and the sets of a group of m copies travel about
once each, not m times.

A pair at similarity s shares no bucket with probability (1 - s^rows)^bands: 5e-6 at 0.8 with the
defaults, less above.

Defined results
* null or empty text, or no word: empty set, linked with nothing, kept.
* fewer words than a shingle has: the whole sequence is the only shingle.
* null ``doc_id``: takes no part; component null, kept true.
* rows that repeat a ``doc_id``: each is answered by its own text, under the shared id; ``keep_one`` keeps one of
  those that repeat the text as well.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import components
from .staging import drop_stage, stage, stage_distinct

BLOCK, SALTS = 512, 16
#: rows of a broadcast list of hot keys: at most 16 bytes each
FEW = 1_000_000
U64 = np.uint64


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash ``a * x + b`` (its high 32 bits count) over the set."""
    out = np.full(len(a), np.iinfo(U64).max, U64)
    for i in range(0, len(s), 512):
        h = np.multiply.outer(a, s[i : i + 512])
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out >> U64(32)


def _sets(rb, shingle: int):
    """(row, distinct shingles in order) of each row with words."""
    for blk in tk.blocks(rb.column(1)):
        h, ptr = tk.shingle_hashes(blk, shingle)
        for r in range(blk.hi - blk.lo):
            if ptr[r + 1] > ptr[r]:
                yield blk.lo + r, np.unique(h[ptr[r] : ptr[r + 1]])


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches):
        a, b = universal(bands * rows)
        coef = tk.mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
        salt = tk.mix(np.arange(1, bands + 1, dtype=U64) + U64(77))
        for rb in batches:
            n = np.zeros(rb.num_rows, np.int64)
            fp = np.zeros((rb.num_rows, 2), U64)
            keys = np.zeros((rb.num_rows, bands), U64)
            sig = [b""] * rb.num_rows
            for r, s in _sets(rb, shingle):
                n[r] = len(s)
                fp[r] = s.sum(dtype=U64), tk.mix(s + U64(0x5851F42D4C957F2D)).sum(dtype=U64)
                m = minima(s, a, b)
                keys[r] = tk.mix((m.reshape(bands, rows) * coef).sum(axis=1, dtype=U64) + salt)
                sig[r] = (m & U64(255)).astype(np.uint8).tobytes()
            key_list = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
            f = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), key_list, pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "keys", "sig"])

    return run


def _full_sets(shingle: int):
    def run(batches):
        for rb in batches:
            ids, out = rb.column(0).to_pylist(), []
            for r, s in _sets(rb, shingle):
                out.append((ids[r], s.tobytes()))
                if len(out) >= 500:
                    yield _sets_batch(out)
                    out = []
            yield _sets_batch(out)

    return run


def _sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary())], ["cls", "items"])


class Alike:
    """Signatures of ``hashes`` bytes that may belong to sets at ``percent`` or more.

    The floor is five and a half standard deviations under the threshold; 1 in 256 bytes agrees by chance.
    """

    def __init__(self, percent: int, hashes: int):
        s = percent / 100
        self.percent, self.floor = percent, int(hashes * s - 5.5 * (hashes * s * (1 - s)) ** 0.5)

    def __call__(self, sigs: np.ndarray, n: np.ndarray, sig: np.ndarray, k: int) -> np.ndarray:
        near = 100 * np.minimum(n, k) >= self.percent * np.maximum(n, k)
        if near.any():
            near[near] = (sigs[near] == sig).sum(axis=1) >= self.floor
        return near


def _linked(percent: int, a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pairs(rows: list[tuple], names=("a", "b")) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64())], list(names))


def _stars(link):
    """Rows (lead, lot, asks, cls, ...) sorted so that the leader's own come first; (lead, cls) of the followers that ``link`` finds."""

    def run(batches):
        key, own, out = None, [], []
        for rb in batches:
            lead, lot, asks, cls = (rb.column(i).to_pylist() for i in range(4))
            rest = rb.columns[4:]
            for r in range(rb.num_rows):
                if (lead[r], lot[r]) != key:
                    key, own = (lead[r], lot[r]), []
                x = [c[r] for c in rest]
                if not asks[r]:
                    own.append(x)
                elif any(link(y, x) for y in own):
                    out.append((lead[r], cls[r]))
            if len(out) > 1000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _by_signature(alike: Alike):
    def link(a, b):
        n = np.array([a[0].as_py()])
        return bool(alike(np.frombuffer(a[1].as_buffer(), np.uint8)[None, :], n, np.frombuffer(b[1].as_buffer(), np.uint8), b[0].as_py())[0])

    return link


def _by_set(percent: int):
    return lambda a, b: _linked(percent, np.frombuffer(a[0].as_buffer(), U64), np.frombuffer(b[0].as_buffer(), U64))


def _held(batches, row, index, look):
    """Rows that lead with (key, b, v, asks), those of a block first: ``look`` of ``index(held rows)`` and each row that asks."""
    place, held, block, out = None, [], None, []
    for rb in batches:
        k, b, v, asks = (rb.column(i).to_pylist() for i in range(4))
        for r, x in enumerate(row(rb)):
            if (k[r], b[r], v[r]) != place:
                place, held, block = (k[r], b[r], v[r]), [], None
            if not asks[r]:
                held.append(x)
            elif held:
                if block is None:
                    block = index(held)
                out += look(k[r], block, *x)
        if len(out) > 1000:
            yield out
            out = []
    yield out


def _suspects(alike: Alike):
    """(key, cls) of all whose signature (cls, comp, n, sig) may be linked with that of another component."""

    def row(rb):
        x, comp, n = (rb.column(i).to_pylist() for i in (4, 5, 6))
        return ((x[r], comp[r], n[r], np.frombuffer(rb.column(7)[r].as_buffer(), np.uint8)) for r in range(rb.num_rows))

    def index(held):
        return [h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.stack([h[3] for h in held])

    def look(key, block, x, comp, n, sig):
        ids, comps, ns, sigs = block
        near = np.flatnonzero(alike(sigs, ns, sig, n) & (comps != comp))
        return [(key, ids[y]) for y in near] + [(key, x)] * bool(len(near))

    def run(batches):
        for out in _held(batches, row, index, look):
            yield _pairs(sorted(set(out)), ("key", "cls"))

    return run


class _Block:
    """Members (cls, comp, set) of one block, indexed by shingle."""

    def __init__(self, held: list[tuple], percent: int):
        self.percent = percent
        self.ids, comps, self.sets = zip(*held, strict=True)
        self.comps, self.n = np.array(comps), np.array([len(s) for s in self.sets])
        every, own = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.n)
        order = np.argsort(every, kind="stable")
        self.items, at = np.unique(every[order], return_index=True)
        self.at, self.own = np.append(at, len(every)), own[order]

    def match(self, x, comp, items):
        """An edge from ``x`` to each component of the block, but its own, that it is linked with."""
        n, k = self.n, len(items)
        j = np.flatnonzero((100 * np.minimum(n, k) >= self.percent * np.maximum(n, k)) & (self.comps != comp))
        if not len(j):
            return []
        if len(j) <= 4:
            both = np.array([len(np.intersect1d(items, self.sets[y], assume_unique=True)) for y in j])
        else:
            p = np.searchsorted(self.items, items)
            p = p[p < len(self.items)] if len(p) and p[-1] >= len(self.items) else p
            p = p[self.items[p] == items[: len(p)]]
            s, c = self.at[p], self.at[p + 1] - self.at[p]
            idx = np.repeat(s - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum())) if len(p) else np.zeros(0, np.int64)
            both = np.bincount(self.own[idx], minlength=len(self.ids))[j]
        j = j[100 * both >= self.percent * (n[j] + k - both)]
        _, first = np.unique(self.comps[j], return_index=True)
        return [(x, self.ids[y]) for y in j[first]]


def _confirm(percent: int):
    """The edges between components, from rows that end with (cls, comp, set)."""

    def row(rb):
        x, comp = rb.column(4).to_pylist(), rb.column(5).to_pylist()
        return ((x[r], comp[r], np.frombuffer(rb.column(6)[r].as_buffer(), U64)) for r in range(rb.num_rows))

    def run(batches):
        for out in _held(batches, row, lambda held: _Block(held, percent), lambda _, block, *x: block.match(*x)):
            yield _pairs(out)

    return run


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast where the rows are counted and few."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _meet(stars: DataFrame, data: DataFrame, link, parts: int) -> DataFrame:
    """The (a, b) of ``stars`` (lead, cls) whose ``data`` (cls, ...) ``link`` joins, some more than once; hot leaders are shared out in lots."""
    hot = stars.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("lead", F.ceil(F.col("m") / BLOCK).alias("lots"))
    mine = stars.join(_few(hot), "lead", "left").select("lead", F.pmod(F.xxhash64("cls"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"), F.lit(True).alias("asks"), "cls")
    leads = mine.select("lead", "lot").distinct().select("lead", "lot", F.lit(False).alias("asks"), F.col("lead").alias("cls"))
    rows = mine.unionByName(leads).join(data, "cls").select("lead", "lot", "asks", "cls", *[c for c in data.columns if c != "cls"])
    dealt = rows.repartition(parts, "lead", "lot").sortWithinPartitions("lead", "lot", "asks")
    return dealt.mapInArrow(tk.lean(_stars(link)), "a long, b long")


def _visits(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, b, v, asks, cls, comp): in each bucket with several components, besides its leader, the blocks of members outside the largest and, in lots, who visits them."""
    e = entries.filter("cls <> lead and n > 2").join(comp, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    mixed = e.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")).filter("lo <> hi")
    # buckets of the same members are one
    mixed = mixed.groupBy("m", "who", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    e = stage(e.join(mixed, "key", "left_semi"), "mixed")
    top = e.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
    lots = lambda n: F.ceil(n / BLOCK).cast("int")
    top = top.select("key", F.col("top.comp").alias("main"), lots(F.col("m") - F.col("top.c")).alias("blocks"), lots(F.col("m")).alias("lots"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    x = e.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(top, ["key", "salt"])
    x = x.withColumn("own", F.when(F.col("comp") != F.col("main"), F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int")))
    held = x.filter("own is not null").select("key", F.col("own").alias("b"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("v"), F.lit(False).alias("asks"), "cls", "comp")
    # a held member visits its own block and those after it, as the members of earlier ones visit it
    goes = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("own").isNull() | (b >= F.col("own")))
    return held.unionByName(x.select("key", F.explode(goes).alias("b"), F.pmod(F.xxhash64("key", "cls"), F.col("lots")).cast("int").alias("v"), F.lit(True).alias("asks"), "cls", "comp"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` of their shingle sets.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = Alike(percent, bands * rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stage(own.mapInArrow(tk.lean(_signatures(shingle, bands, rows)), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig binary"), "signatures")
    real = base.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("m")), "fingerprints")
    reps = real.join(classes.select("f1", "f2", F.col("cls").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").dropDuplicates(["f1", "f2", "doc_id"])
    reps = stage(reps.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), "sig", "keys"), "classes")
    keyed = reps.select("cls", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = stage(keyed.join(leaders, "key").select("key", "lead", "n", "cls"), "buckets")
    signs = reps.select("cls", "n", "sig")

    def sets(ids: DataFrame) -> DataFrame:
        # one plan at every size: the texts of all documents meet the ids by a shuffle
        used = ids.select(F.col("cls").alias("doc_id")).distinct()
        return stage(own.join(used.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(tk.lean(_full_sets(shingle)), "cls long, items binary"), "sets")

    stars = stage_distinct(entries.filter("lead < cls").select("lead", "cls"), "stars", entries.count())
    likely = stage_distinct(_meet(stars, signs, _by_signature(alike), parts).select(F.col("a").alias("lead"), F.col("b").alias("cls")), "likely", stars.count())
    full = sets(likely.select("cls").unionByName(likely.select(F.col("lead").alias("cls"))))
    edges = stage_distinct(_meet(likely, full, _by_set(percent), parts), "edges", likely.count())
    drop_stage(stars, likely, full)
    comp = stage_distinct(components(edges, "a", "b"), "components", 2 * edges.count())
    visits = stage(_visits(entries, comp), "visits")
    if visits.limit(1).count():
        order = ["key", "b", "v", "asks", "cls"]
        seen = visits.join(signs, "cls").select(*order, "comp", "n", "sig").repartition(parts, "key", "b", "v").sortWithinPartitions(*order)
        some = stage_distinct(seen.mapInArrow(tk.lean(_suspects(alike)), "key long, cls long"), "suspects", visits.count())
        full = sets(some.select("cls"))
        dealt = visits.join(some, ["key", "cls"], "left_semi").join(full, "cls").select(*order, "comp", "items").repartition(parts, "key", "b", "v").sortWithinPartitions(*order)
        more = stage_distinct(dealt.mapInArrow(tk.lean(_confirm(percent)), "a long, b long"), "edges", visits.count())
        if more.limit(1).count():
            # what is known is stars by now; only ``more`` is followed further
            both = comp.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)
            comp, old = stage_distinct(components(both, "a", "b"), "components", 2 * both.count()), comp
            drop_stage(old)
        drop_stage(some, full, more)
    drop_stage(entries, edges, visits, reps)
    known = stage(classes.join(comp, classes["cls"] == comp["node"], "left").select("f1", "f2", "m", F.coalesce("component", "cls").alias("comp")), "known")
    drop_stage(classes, comp)
    # classes of many copies find them without a shuffle of the copies to one task; there are at most documents / BLOCK
    hot, cold = _few(known.filter(F.col("m") > BLOCK).drop("m")), known.filter(F.col("m") <= BLOCK).drop("m")
    rows = base.select("doc_id", "n_shingles", "f1", "f2")
    out = rows.join(hot, ["f1", "f2"]).unionByName(rows.join(hot, ["f1", "f2"], "left_anti").join(cold, ["f1", "f2"], "left"))
    c = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    c = F.when(F.col("doc_id").isNotNull(), c)
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id."""
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("__d")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["__d"], "left_anti")
    again = docs.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __d is not null").select("__d")
    if not again.limit(1).count():
        return left
    again = stage(again, "repeated")
    once = left.join(again, left["doc_id"].cast("long") == again["__d"], "left_anti")
    return once.unionByName(left.join(again, left["doc_id"].cast("long") == again["__d"], "left_semi").dropDuplicates(["doc_id", "text"]))
