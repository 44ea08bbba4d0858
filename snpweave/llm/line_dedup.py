"""Line deduplication over whole corpora, by range-partitioned line hashes.

Every line's normalised key is hashed on the executors; to find the lines that go, only (hash, document,
position) rows are shuffled, never text.  They are range-partitioned by (hash, document) and sorted by hash, document
(largest first) and position, so that a stream over a partition meets the document that keeps a key
first and can decide all later ones with constant memory.  The range includes the document: a line
that a third of all documents share spreads over several partitions.  Only the first and the last
key of a partition can continue in another one; their counts (two rows a partition) are added up
and sent back.  The result is a compressed keep bitmap for each document (``keep_bitmaps``).

Where kept text is wanted (``line_digest``, ``line_dedup``) the bitmaps meet their documents again by a join on
(doc_id, hash of the text), which shuffles each text once: the bitmaps of a corpus have no size that could be broadcast.

Texts are read in pieces of whole lines of about ``2 * BLOCK`` bytes, and a longer line is hashed piece by piece, so
memory does not follow the length of a text or a line.

Defined results
* null or empty text: one empty line, kept.
* null ``doc_id``: the row keeps all its lines and counts for no key.
* rows that repeat a ``doc_id`` are one document for counting; each gets its own bitmap.
* a key that one document holds many times counts once; in the keeping document all its lines stay.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .staging import drop_stage, stage

_SUB2 = tk.mix(np.arange(1001, 1257, dtype=np.uint64))[tk.LOWER]
_POW2 = 0xD1342543DE82EF95


def _pieces(data: np.ndarray, off: np.ndarray):
    """(first row, byte offsets of its rows, number of the first row's lines before): rows of about 2 * BLOCK bytes together, a longer one in pieces of whole lines."""
    n, lo, most = len(off) - 1, 0, 2 * tk.BLOCK
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        if off[hi] - off[lo] <= most:
            yield lo, off[lo : hi + 1], 0
        else:
            a, b, before = int(off[lo]), int(off[hi]), 0
            while True:
                cut = b if b - a <= most else _line_end(data, a, a + most, b)
                yield lo, np.array([a, cut]), before
                if cut == b:
                    break
                before += int(np.count_nonzero(data[a:cut] == 10)) + 1
                a = cut + 1
        lo = hi


def _line_end(data: np.ndarray, a: int, want: int, b: int) -> int:
    """The last newline of ``data[a:want]``, else the first from there to ``b``, else ``b``."""
    if len(found := np.flatnonzero(data[a:want] == 10)):
        return a + int(found[-1])
    while want < b:
        if len(found := np.flatnonzero(data[want : min(b, want + tk.BLOCK)] == 10)):
            return want + int(found[0])
        want += tk.BLOCK
    return b


def _long_line(d: np.ndarray, min_chars: int):
    """Hashes of the key of one long line (two arrays of one), or none; piece by piece."""
    step, lo, hi = tk.BLOCK, 0, len(d)
    while lo < hi and not len(f := np.flatnonzero(tk.NON_WHITE[d[lo : lo + step]])):
        lo += step
    if lo >= hi:
        return None
    lo += int(f[0])
    while not len(f := np.flatnonzero(tk.NON_WHITE[d[max(lo, hi - step) : hi]])):
        hi -= step
    hi = max(lo, hi - step) + int(f[-1]) + 1
    if sum(int(np.count_nonzero((d[i : min(hi, i + step)] & 0xC0) != 0x80)) for i in range(lo, hi, step)) < min_chars:
        return None
    return tuple(tk.long_hash(d[lo:hi], sub) for sub in (tk.SUB_LOWER, _SUB2))


def _line_rows(min_chars: int):
    def run(batches):
        for rb in batches:
            data, off = tk.text_buffers(rb.column(1))
            ids, rid = rb.column(0), rb.column(2).to_numpy(zero_copy_only=False)
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for first, offsets, before in _pieces(data, off):
                got = _keys(data, offsets, known[first : first + len(offsets) - 1], min_chars)
                if got is not None:
                    h1, h2, row, pos = got
                    row += first
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[row]), pa.array(rid[row]), pa.array((pos + before).astype(np.int32))], ["h1", "h2", "doc_id", "rid", "pos"])

    return run


def _keys(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, min_chars: int):
    """(h1, h2, row, position) of the lines of the rows that ``offsets`` part, whose keys are long enough."""
    a, b = int(offsets[0]), int(offsets[-1])
    d = data[a:b]
    if len(d) > 2 * tk.BLOCK:  # one long row; if no line ends in it, one long line
        if not known[0]:
            return None
        if not (d == 10).any():
            h = _long_line(d, min_chars)
            return None if h is None else (*h, np.zeros(1, np.int64), np.zeros(1, np.int64))
    rows_at = offsets - a
    n = len(rows_at) - 1
    nl = np.flatnonzero(d == 10)
    # a row's newline that ends its last byte starts an empty line at the next row's offset
    row = np.concatenate([np.arange(n), np.searchsorted(rows_at, nl, "right") - 1])
    at = np.concatenate([rows_at[:-1], nl + 1])
    order = np.lexsort((at, row))
    starts, row = at[order], row[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends = np.empty(len(row), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = rows_at[row[last] + 1]
    pos = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    nz = np.flatnonzero(tk.NON_WHITE[d])
    i, j = np.searchsorted(nz, starts), np.searchsorted(nz, ends) - 1
    full = (j >= i) & known[row]
    i, j, row, pos = i[full], j[full], row[full], pos[full]
    s, e = nz[i], nz[j] + 1
    cp = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
    long = cp[e] - cp[s] >= min_chars
    s, e, row, pos = s[long], e[long], row[long], pos[long]
    if not len(s):
        return None
    return tk.range_hash(d, s, e, tk.SUB_LOWER), tk.range_hash(d, s, e, _SUB2), row, pos


_OUT = "kind int, h1 long, h2 long, doc_id long, rid long, pos int, n_docs long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _emit(kind: int, h1, h2, doc, rid, pos, n_docs=0):
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(h1), pa.array(h2), pa.array(doc), pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(np.full(n, n_docs, np.int64))], _NAMES)


class _Run:
    """The run of equal keys that the stream is in: rows are held only while fewer than ``copies`` documents are known."""

    def __init__(self, key, first: bool):
        self.key, self.first, self.n, self.top, self.doc, self.held = key, first, 0, None, None, []

    def add(self, h1, h2, doc, rid, pos, copies: int):
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        if self.doc is not None:
            new[0] = doc[0] != self.doc
        if self.top is None:
            self.top = doc[0]
        self.n += int(new.sum())
        self.doc = doc[-1]
        rows = (h1, h2, doc, rid, pos)
        if self.first:
            yield _emit(1, *rows)
        elif self.n >= copies:
            for r in [*self.held, rows]:
                k = r[2] != self.top
                if k.any():
                    yield _emit(0, *(x[k] for x in r))
            self.held = []
        else:
            self.held.append(rows)

    def close(self, final: bool):
        if self.first or final:
            z = [np.array([x], np.int64) for x in (*self.key, self.top, 0)]
            yield _emit(2, *z, np.zeros(1, np.int32), self.n)
            for r in self.held:
                yield _emit(1, *r)


def _stream(copies: int):
    def run(batches):
        cur: _Run | None = None
        for rb in batches:
            if not rb.num_rows:
                continue
            h1, h2, doc, rid, pos = (rb.column(c).to_numpy() for c in range(5))
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(h1)]])
            part = lambda a, b: (h1[a:b], h2[a:b], doc[a:b], rid[a:b], pos[a:b])
            lo = 0
            if cur is not None and cur.key == (h1[0], h2[0]):
                yield from cur.add(*part(0, bounds[1]), copies)
                lo = 1
            if lo == len(bounds) - 1:
                continue
            began = cur is None
            if cur is not None:
                yield from cur.close(False)
            if began:  # the partition's first run
                cur = _Run((h1[0], h2[0]), True)
                yield from cur.add(*part(0, bounds[1]), copies)
                lo = 1
                if lo == len(bounds) - 1:
                    continue
                yield from cur.close(False)
            a, b = bounds[lo], bounds[-2]
            if b > a:  # runs that begin and end here
                s = bounds[lo:-2] - a
                x = part(a, b)
                new = np.ones(b - a, bool)
                new[1:] = x[2][1:] != x[2][:-1]
                new[s] = True
                n = np.add.reduceat(new.astype(np.int64), s)
                size = np.diff(np.concatenate([s, [b - a]]))
                drop = np.repeat(n >= copies, size) & (x[2] != np.repeat(x[2][s], size))
                if drop.any():
                    yield _emit(0, *(v[drop] for v in x))
            cur = _Run((h1[b], h2[b]), False)
            yield from cur.add(*part(b, len(h1)), copies)
        if cur is not None:
            yield from cur.close(True)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, rid, pos) of every line to drop; ``rid`` is ``xxhash64(text)``, ``pos`` counts lines from 0."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("rid"))
    rows = stage(own.mapInArrow(tk.lean(_line_rows(min_chars)), "h1 long, h2 long, doc_id long, rid long, pos int"), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    found = stage(dealt.mapInArrow(tk.lean(_stream(min_docs)), _OUT), "line-runs")
    # at most two summary rows a partition: small enough to send to every task
    totals = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("doc_id").alias("top"))
    late = found.filter("kind = 1").join(F.broadcast(totals), ["h1", "h2"]).filter((F.col("all_docs") >= min_docs) & (F.col("doc_id") < F.col("top")))
    drop_stage(rows)
    cols = ["doc_id", "rid", "pos"]
    return found.filter("kind = 0").select(*cols).unionByName(late.select(*cols))


def _bitmaps(batches):
    for rb in batches:
        out = []
        for pos in rb.column(2).to_pylist():
            bits = np.zeros(max(pos) + 1, np.uint8)
            bits[pos] = 1
            out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.binary())], ["doc_id", "rid", "drops"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, rid, drops) for documents that lose lines: a zlib-compressed bitmap, bit 1 where a line goes.

    Documents that are absent keep everything; lines beyond the bitmap are kept.
    """
    d = dropped_lines(docs, min_chars, min_docs)
    return d.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("pos")).mapInArrow(tk.lean(_bitmaps), "doc_id long, rid long, drops binary")


def kept_text(text: str | None, drops: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, its number of lines before, and the number dropped."""
    text = text or ""
    if not drops:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drops), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits).tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _digests(batches):
    for rb in batches:
        got = [kept_text(a, b) for a, b in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True)]
        sha = pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in got], pa.string())
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), sha], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _cut_text(batches):
    for rb in batches:
        i = rb.schema.get_field_index("text")
        new = [a if a is None else kept_text(a, b)[0] for a, b in zip(rb.column(i).to_pylist(), rb.column(rb.num_columns - 1).to_pylist(), strict=True)]
        cols = [pa.array(new, pa.string()) if k == i else rb.column(k) for k in range(rb.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(cols, rb.schema.names[:-1])


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """``docs`` with a last column ``__drops`` (null: nothing goes)."""
    m = maps.select(F.col("doc_id").alias("__d"), F.col("rid").alias("__r"), F.col("drops").alias("__drops"))
    return docs.join(m, (docs["doc_id"].cast("long") == m["__d"]) & (F.xxhash64(docs["text"]) == m["__r"]), "left").select(*[docs[c] for c in docs.columns], "__drops")


def line_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the kept lines joined by newlines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    j = with_bitmaps(own, keep_bitmaps(own, min_chars, min_docs))
    return j.mapInArrow(tk.lean(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with dropped lines removed from ``text`` (a null text stays null), the other columns as they were."""
    return with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).mapInArrow(tk.lean(_cut_text), docs.schema)
