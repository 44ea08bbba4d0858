"""Benchmark decontamination by spaced seeds with substitution-tolerant verification.

Words are runs of letters and digits; capitals of ASCII and Latin-1 count as small letters.  A seed is the hash of
the words at the marked positions of a fixed mask; the other positions are ignored, so a passage with replaced words
still shares seeds.  One plan serves every size of benchmark:

1. The benchmark's seeds are a table (seed, item, position).  A Bloom filter of them (``PROBES`` bits a seed in a table
   of at most ``MOST_BITS``, 1 in 10^7 others pass) goes to all tasks; documents are read once, and one without a
   passing seed goes no further.
2. The others are kept as hashes of their words, and their seeds are joined with the benchmark's by a shuffle on the
   seed.  A seed with over ``HOT`` hits is split on the document's side, a task for each ``HOT`` of them; hits are salted
   before they meet the list of such seeds, so that no join has all of them in one task.
3. A hit names an item and a diagonal.  Distinct ones (combined before their shuffle) meet the items' words and the
   documents' words again; the item is laid along the document on the diagonal, matching words count for, others
   against, and the best stretch decides.

A document leaks an item when the best stretch holds at least ``share`` of the item's words, or
``long`` words, and at least ``min_words``.  Items of fewer than ``min_words`` words count only where all
their words stand in a row.

Defined results
* null or empty texts and items without words match nothing; null item ids take no part.
* ``leaks``: null doc_ids take no part; ``drop_leaks`` judges rows without an id by their text.
* items with the same words are looked for once; a document that leaks one leaks them all, and all are named.
* one row for each distinct (doc_id, text) that leaks, whatever the benchmark's size; rows that repeat both are one.
* an empty benchmark or table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .staging import drop_stage, stage

U64 = np.uint64
MASKS = ("111011", "1101011", "110010011", "10110101")
#: the filter's bits for a seed, and at most: 64 MB; a benchmark of more than 8 million seeds lets more through to the join
BITS_PER_SEED, MOST_BITS, PROBES = 64, 1 << 29, 8
SALTS, MOST_SALTS, HOT = 64, 4096, 4096
#: parts in which the filter reaches the driver: at most 8 MB each
LOTS = 8
#: documents whose ids are sent to all tasks: at most 16 bytes each
FEW = 1_000_000
_COEF = tk.mix(np.arange(201, 233, dtype=U64)) | U64(1)


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, len(mask), U64)
    for j, c in enumerate(mask):
        if c == "1":
            h += words[j : j + n] * _COEF[j]
    return tk.mix(h)


def _items(batches):
    for rb in batches:
        for b in tk.blocks(rb.column(1), tk.ALNUM, fold=True):
            ids = rb.column(0)[b.lo : b.hi]
            words = [b.hashes[b.ptr[i] : b.ptr[i + 1]].tobytes() for i in range(b.hi - b.lo)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.binary())], ["item_id", "words"])


def _masks(n: int, min_words: int) -> list[str]:
    """The masks of an item of ``n`` words: a short item is sought whole, and by masks where it need not be."""
    if n < max(min_words, max(map(len, MASKS))):
        return ["1" * n] + [m for m in MASKS if n >= min_words and len(m) <= n]
    return list(MASKS)


def _item_seeds(min_words: int):
    def run(batches):
        for rb in batches:
            seed, item, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, raw in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                w = np.frombuffer(raw, U64)
                for m in _masks(len(w), min_words):
                    s = _seeds(w, m)
                    seed.append(s)
                    item.append(np.full(len(s), i))
                    at.append(np.arange(len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed).view(np.int64)), pa.array(np.concatenate(item)), pa.array(np.concatenate(at).astype(np.int32))], ["seed", "item_id", "at"])

    return run


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th bit of each seed."""
    return ((h + U64(k) * (tk.mix(h) | U64(1))) & U64(bits - 1)).astype(np.int64)


def _bits(bits: int):
    """Set bits of a task's seeds, in pieces of 4096 bytes."""

    def run(batches):
        some: dict[int, np.ndarray] = {}
        for rb in batches:
            h = rb.column(0).to_numpy().view(U64)
            at = np.sort(np.concatenate([_probe(h, k, bits) for k in range(PROBES)]))
            pieces, cut = np.unique(at >> 15, return_index=True)
            for p, own in zip(pieces.tolist(), np.split(at & 32767, cut[1:]), strict=True):
                some.setdefault(p, np.zeros(32768, bool))[own] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in some.values()], pa.binary())], ["piece", "set"])

    return run


def _either(batches):
    some: dict[int, np.ndarray] = {}
    for rb in batches:
        for p, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            some[p] = some[p] | np.frombuffer(x, np.uint8) if p in some else np.frombuffer(x, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.array([x.tobytes() for x in some.values()], pa.binary())], ["piece", "set"])


def _bit_table(seeds: DataFrame, n: int) -> np.ndarray:
    bits = 1 << 15
    while bits < min(n * BITS_PER_SEED, MOST_BITS):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    schema = "piece long, set binary"
    # pieces come a part of the table after the other, each a job of its own: as many as LOTS, whatever the partitions
    for r in seeds.select("seed").mapInArrow(_bits(bits), schema).repartition("piece").coalesce(LOTS).mapInArrow(_either, schema).toLocalIterator():
        out[r[0] * 4096 : (r[0] + 1) * 4096] = np.frombuffer(r[1], np.uint8)
    return out


def _hits(table, short: list[int]):
    """Of each document that shows a set bit: its words' hashes, and the seeds with their positions."""
    masks = [*MASKS, *("1" * n for n in short)]

    def run(batches):
        bits = table.value
        for rb in batches:
            out = []
            for b in tk.blocks(rb.column(2), tk.ALNUM, fold=True):
                row = np.repeat(np.arange(b.hi - b.lo), np.diff(b.ptr))
                found = []
                for m in masks:
                    h = _seeds(b.hashes, m)
                    if not len(h):
                        continue
                    p = np.arange(len(h))
                    for k in range(PROBES):
                        at = _probe(h[p], k, len(bits) * 8)
                        p = p[((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
                    p = p[row[p] == row[p + len(m) - 1]]
                    found.append((p, h[p]))
                if not any(len(p) for p, _ in found):
                    continue
                at, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                cut = np.searchsorted(at, b.ptr)
                for r in np.unique(row[at]):
                    own = slice(cut[r], cut[r + 1])
                    words = b.hashes[b.ptr[r] : b.ptr[r + 1]]
                    out.append((rb.column(0)[b.lo + r].as_py(), rb.column(1)[b.lo + r].as_py(), words.tobytes(), h[own].view(np.int64), (at[own] - b.ptr[r]).astype(np.int32)))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.list_(pa.int64())), pa.array(c[4], pa.list_(pa.int32()))], ["doc_id", "rid", "words", "seeds", "ats"])

    return run


def best_stretch(same: np.ndarray) -> int:
    """Matching words in the stretch of the largest (matches - mismatches)."""
    s = np.where(same, 1, -1)
    c = np.concatenate([[0], np.cumsum(s)])
    low = np.minimum.accumulate(c[:-1])
    end = int(np.argmax(c[1:] - low)) + 1
    start = int(np.argmin(c[:end]))
    return int(same[start:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, share: float, long: int) -> float:
    """The share of the item's words that the best stretch on a diagonal holds, or 0 where that is no leak."""
    n = len(item)
    s, e = max(diagonal, 0), min(diagonal + n, len(doc))
    same = doc[s:e] == item[s - diagonal : e - diagonal]
    if not len(same):
        return 0.0
    got = best_stretch(same)
    whole = n < min_words and len(same) == n and bool(same.all())
    return got / n if whole or (n >= min_words and got >= min_words and (got >= share * n or got >= long)) else 0.0


def _verify(min_words: int, share: float, long: int):
    def run(batches):
        for rb in batches:
            out = []
            for doc, item, diagonals in zip(rb.column("words").to_pylist(), rb.column("item_words").to_pylist(), rb.column("diagonals").to_pylist(), strict=True):
                d, w = np.frombuffer(doc, U64), np.frombuffer(item, U64)
                out.append(max(overlap(d, w, x, min_words, share, long) for x in diagonals))
            keep = pa.array([x > 0 for x in out], pa.bool_())
            cols = [rb.column(n) for n in ("doc_id", "rid", "item_id")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.float64())], ["doc_id", "rid", "item_id", "overlap"]).filter(keep)

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, min_words: int, share: float, long: int) -> DataFrame | None:
    """(doc_id, rid, item_ids, overlap) of the distinct (doc_id, text) that leak; ``rid`` is the hash of the text.  None: no item has words."""
    spark = docs.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    every = stage(own.mapInArrow(_items, "item_id long, words binary").filter("length(words) > 0"), "every-item")
    items = stage(every.groupBy("words").agg(F.min("item_id").alias("item_id")), "items")
    members = stage(every.join(items.withColumnRenamed("item_id", "leader"), "words").select("leader", "item_id").distinct(), "members")
    seeds = stage(items.select("item_id", "words").mapInArrow(_item_seeds(min_words), "seed long, item_id long, at int"), "item-seeds")
    n = seeds.count()
    if not n:
        drop_stage(every, items, members, seeds)
        return None
    limit = max(min_words, max(map(len, MASKS)))
    short = [r[0] for r in items.select((F.length("words") / 8).cast("int").alias("n")).filter(F.col("n") < limit).distinct().orderBy("n").collect()]  # fewer than ``limit``
    table = spark.sparkContext.broadcast(_bit_table(seeds, n))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text"))
    near = stage(text.mapInArrow(tk.lean(_hits(table, short)), "doc_id long, rid long, words binary, seeds array<long>, ats array<int>").dropDuplicates(["doc_id", "rid"]), "seed-hits")
    hits = near.select("doc_id", "rid", F.explode(F.arrays_zip(F.col("seeds").alias("s"), F.col("ats").alias("p"))).alias("x")).select("doc_id", "rid", F.col("x.s").alias("seed"), F.col("x.p").alias("p"))
    # seeds that many documents hold are dealt to a task for each HOT hits; there are as many as hits over HOT at most
    hot = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("seed", F.least(F.ceil(F.col("n") / HOT), F.lit(MOST_SALTS)).cast("long").alias("salts"))
    h = F.xxhash64("doc_id", "rid", "p")
    spread = hot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    left = hits.withColumn("part", F.pmod(h, F.lit(SALTS)).cast("long")).join(spread, ["seed", "part"], "left").withColumn("salt", F.pmod(h, F.coalesce("salts", F.lit(1).cast("long")))).drop("part")
    right = seeds.join(hot, "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)))
    found = left.drop("salts").join(right.drop("salts"), ["seed", "salt"]).select("doc_id", "rid", "item_id", (F.col("p") - F.col("at")).alias("d"))
    lots = found.groupBy("doc_id", "rid", "item_id").agg(F.collect_set("d").alias("diagonals"))
    named = items.select("item_id", F.col("words").alias("item_words"))
    same = lots["doc_id"].eqNullSafe(near["doc_id"]) & (lots["rid"] == near["rid"])
    pairs = lots.join(named, "item_id").join(near.select("doc_id", "rid", "words"), same).select(lots["doc_id"], lots["rid"], "item_id", "diagonals", "words", "item_words")
    got = pairs.mapInArrow(_verify(min_words, share, long), "doc_id long, rid long, item_id long, overlap double")
    got = got.withColumnRenamed("item_id", "leader").join(members, "leader")
    out = stage(got.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("overlap")), "leaks")
    drop_stage(every, items, members, seeds, near)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, share: float = 0.6, long: int = 13) -> DataFrame:
    """(doc_id, item_ids, overlap) of the documents that leak: the items, and the largest share of one that was found."""
    out = _leaks(docs.filter(F.col("doc_id").cast("long").isNotNull()), benchmark, min_words, share, long)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_ids array<long>, overlap double")
    return out.select("doc_id", "item_ids", "overlap")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 8, share: float = 0.6, long: int = 13) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; texts are not shuffled while at most ``FEW`` documents leak."""
    out = _leaks(docs, benchmark, min_words, share, long)
    if out is None:
        return docs
    gone = out.select(F.col("doc_id").alias("__d"), F.col("rid").alias("__r"))
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__r")), "left_anti")
