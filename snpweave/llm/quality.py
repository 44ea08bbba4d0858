"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Words are maximal runs of one character class (small letters, capitals, digits, signs), so that shape
survives; each falls in one of a fixed number of buckets, split by class, so that words share a vector only where
a corpus has more of them than ``SHARES`` (rare words then share with others: what they add to a document's mean is
small).  Random indexing adds, for every occurrence in every document, the sparse random index vectors of the
neighbouring words to the word's context vector.  The sums are integers, so any dealing of the rows gives the same
vectors, and each task sends at most ``BUCKETS`` rows whatever it reads; as many reducers as there are shuffle
partitions add them up.  The finished matrix has a fixed size (``BUCKETS * DIM`` numbers, 8 MB as float32) and is broadcast.

A document is the mean and the spread of its words' vectors, its length, and the share of words that
repeat one of the three before.  A network with one hidden layer is fitted
with numpy on a bounded sample of labelled rows (``max_train``, the smallest hashes of doc_id), and a
temperature fitted on a part set aside calibrates its probabilities.

Defined results
* null or empty text: scored as a document without words (the network's value at the zero vector).
* labels that are null do not count; a document with several labels has their mean as target.
* no labelled row at all: every score is 0.5; labels of one kind only: their smoothed share.
* null ``doc_id``: scored, never used for training, held_out false.
* repeated rows are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

DIM, WINDOW, ONES = 64, 2, 4
#: buckets by class: small letters, capitals, digits, signs
SHARES = (24576, 4096, 1024, 3072)
BUCKETS = sum(SHARES)
U64 = np.uint64
CLASS = np.array([0 if b in (32, 9, 10, 11, 12, 13) else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 4 for b in range(256)], np.uint8)
_BASE = np.array([0, 0, *np.cumsum(SHARES)[:-1]], np.int64)
_SIZE = np.array([1, *SHARES], np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, the places of its ones and their signs."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :ONES]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, ONES))


def _buckets(col):
    """(block, buckets of its words)."""
    data, _ = tk.text_buffers(col)
    for b in tk.blocks(col, CLASS, tk._SUB):
        k = CLASS[data[b.starts]] if len(b.starts) else np.zeros(0, np.uint8)
        yield b, _BASE[k] + (b.hashes % _SIZE[k].astype(U64)).astype(np.int64)


def _contexts(batches):
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for rb in batches:
        for b, w in _buckets(rb.column(0)):
            row = np.repeat(np.arange(b.hi - b.lo), np.diff(b.ptr))
            keys, weights = [], []
            for gap in range(1, WINDOW + 1):
                if len(w) <= gap:
                    continue
                same = row[gap:] == row[:-gap]
                left, right = w[:-gap][same], w[gap:][same]
                for x, y in ((left, right), (right, left)):
                    keys.append(((x * DIM)[:, None] + places[y]).ravel())
                    weights.append(signs[y].ravel())
            if keys:
                total += np.bincount(np.concatenate(keys), weights=np.concatenate(weights), minlength=BUCKETS * DIM)
    # whole numbers: exact in doubles up to 2^53 and sent as 4 bytes each where they fit
    m = total.reshape(BUCKETS, DIM)
    m = m.astype(np.int32 if np.abs(m).max() < 1 << 31 else np.int64)
    some = np.flatnonzero(m.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([m[i].tobytes() for i in some], pa.binary())], ["bucket", "vec"])


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for rb in batches:
        for k, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            x = np.frombuffer(v, np.int32 if len(v) == 4 * DIM else np.int64)
            sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["bucket", "vec"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of the buckets, from all documents; a matrix of fixed size."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tk.lean(_contexts), "bucket int, vec binary")
    rows = parts.repartition("bucket").mapInArrow(tk.lean(_add_up), "bucket int, vec binary").collect()
    m = np.zeros((BUCKETS, DIM))
    for r in rows:
        m[r["bucket"]] = np.frombuffer(r["vec"], np.int64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.maximum(norm, 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 2


def _pooled(col, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(col), FEATURES), np.float32)
    data, _ = tk.text_buffers(col)
    for b, w in _buckets(col):
        letters = CLASS[data[b.starts]] == 1 if len(w) else np.zeros(0, bool)
        echo = np.zeros(len(w), bool)
        for gap in (1, 2, 3):  # a word that one of the last three repeats
            echo[gap:] |= b.hashes[gap:] == b.hashes[:-gap]
        echoes = np.concatenate([[0], np.cumsum(echo & letters)])
        n = np.diff(b.ptr)
        row = np.repeat(np.arange(b.hi - b.lo), n)
        sums = np.zeros((b.hi - b.lo, 2 * DIM))
        for i in range(0, len(w), 1 << 15):
            r, v = row[i : i + (1 << 15)], vectors[w[i : i + (1 << 15)]]
            first = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
            sums[r[first], :DIM] += np.add.reduceat(v, first, axis=0)
            sums[r[first], DIM:] += np.add.reduceat(v * v, first, axis=0)
        m = sums / np.maximum(n, 1)[:, None]
        out[b.lo : b.hi, :DIM] = m[:, :DIM]
        out[b.lo : b.hi, DIM : 2 * DIM] = np.sqrt(np.maximum(m[:, DIM:] - m[:, :DIM] ** 2, 0))
        out[b.lo : b.hi, -2] = np.log1p(n)
        out[b.lo : b.hi, -1] = (echoes[b.ptr[1:]] - echoes[b.ptr[:-1]]) / np.maximum(n, 1)
    return out


def _features(vectors):
    def run(batches):
        for rb in batches:
            x = _pooled(rb.column(1), vectors.value)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    return run


class Network:
    """Two layers, tanh inside; probabilities are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if len(y) < 20 or len({*np.round(y[~aside])}) < 2:
            self.flat = (y.sum() + 1) / (len(y) + 2)
            return
        self.flat = None
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.std
        zt, yt = z[~aside], y[~aside]
        d = z.shape[1]
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(yt))
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                h = np.tanh(zt[k] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt[k]) / len(k)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [zt[k].T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for j, q in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * q
                    v[j] = 0.999 * v[j] + 0.001 * q * q
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.p, self.t = p, 1.0
        if aside.sum() >= 10:
            logit = self._logit(x[aside])
            heats = np.exp(np.linspace(-2, 3, 101))
            loss = [np.mean(np.logaddexp(0, logit / t) - y[aside] * logit / t) for t in heats]
            self.t = float(heats[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.std) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), float(self.flat))
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.t, -30, 30)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled(labels: DataFrame, column: str, parts: int, out: int, max_train: int) -> DataFrame:
    """At most ``max_train`` (doc_id, y) of the rows that may be learnt from: those with the smallest hashes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    one = own.filter("doc_id is not null and y is not null").filter(fold(F.col("doc_id"), parts) != out).groupBy("doc_id").agg(F.avg("y").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", parts: int = 4, out: int = 2, max_train: int = 16000) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, a network from at most ``max_train`` labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    held = spark.sparkContext.broadcast(vectors)
    some = labelled(labels, column, parts, out, max_train)  # bounded by max_train
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(some), "doc_id").select("doc_id", "text", "y").mapInArrow(tk.lean(_features(held)), "doc_id long, y double, x binary").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), FEATURES)
    return vectors, Network(x, np.array([r[1] for r in rows]))


def _scores(model, at: int):
    def run(batches):
        vectors, net = model.value
        for rb in batches:
            s = net(_pooled(rb.column(at), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s)], [*rb.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def slim(batches):
        for rb in _scores(model, 1)(batches):
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2)], ["doc_id", "score"])

    parts, out = options.get("parts", 4), options.get("out", 2)
    held = F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(False))
    return own.mapInArrow(tk.lean(slim), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns; no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    at = docs.columns.index("text")

    def keep(batches):
        for rb in _scores(model, at)(batches):
            good = pa.compute.greater_equal(rb.column(rb.num_columns - 1), threshold)
            yield pa.RecordBatch.from_arrays(list(rb.columns[:-1]), rb.schema.names[:-1]).filter(good)

    return docs.mapInArrow(tk.lean(keep), docs.schema)
