"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

A character trigram model over bytes (26 letters, a word's edge, and the bytes of other letters) is
counted over the words of every document; tasks send their counts, which grow with what they read, and
the sum has a fixed upper size (155^3 numbers).  Suspicious spans (signs or digits among letters, single
letters set apart, a letter three or more times in a row) become character lattices: a sign may stand for
letters, a repeated letter or a separator for nothing.  Words with such a row are not counted into the
model, so elongations never become the corpus's own habit; a single letter's row and Roman numerals stay.
Viterbi decoding finds the cheapest reading under channel and model, and the text with these readings is
what is scored.

Features are words and the beginnings of words; those that mark toxic rows are chosen, and a logistic
model is fitted, on a bounded sample of labelled rows (``max_train``, the smallest hashes of doc_id).

Defined results
* null or empty text: no feature, so the model's base rate.
* no labelled row: every score is 0.5; labels of one kind only: their smoothed share.
* null ``doc_id``: scored, never learnt from, held_out false.
* spans of any length are read and the whole text is scored; letters set apart are joined over the narrowest
  gap of their row, a wider gap or a line's end (in a row not set line by line) parts words.
* repeated rows are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .quality import fold, labelled
from .staging import stage

U64 = np.uint64
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: symbols of the model: 0 a word's edge, 1-26 letters, 27-154 bytes from 128
SYMBOL = np.array([b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256)], np.int64)
N = 155
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: what a sign or digit may stand for
STANDS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in STANDS]] = True
SEPARATORS = " .-_*,/:;"
COST_SIGN, COST_KEPT, COST_REPEAT, COST_SEPARATOR, COST_SPACE = 0.5, 6.0, 0.6, 0.2, 2.5
STARTS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in range(256)])
_TAIL = b"!$%&*#@|.,;:?)\"'+]}"
_HEAD = b"%&*#|.,;:?(\"'+[{!"
_IS_TAIL, _IS_HEAD, _IS_APART, _IS_LINE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (_TAIL, _HEAD, b".-_*,/:;|", b"\n\r"))


def _threes(d: np.ndarray) -> np.ndarray:
    """Where a letter (of one to three bytes) begins that stands three times in a row; small and capital alike in ASCII."""
    low, out = _LOWER[d], np.zeros(len(d), bool)
    out[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & LETTER[d[:-2]] & (d[:-2] < 128)
    if (d >= 0xC0).any():
        for k, lead, after in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0)):
            n = len(d) - 3 * k + 1
            if n > 0:
                same = np.concatenate([[0], np.cumsum(d[:-k] == d[k:], dtype=np.int64)])
                out[:n] |= (d[:n] >= lead) & (d[:n] < after) & (same[2 * k : 2 * k + n] - same[:n] == 2 * k)
    return out


def _trigrams(batches):
    total = np.zeros(N**3, np.int64)
    for rb in batches:
        data, _ = tk.text_buffers(rb.column(0))
        for b in tk.blocks(rb.column(0), LETTER):
            if not len(b.starts):
                continue
            lo, hi = int(b.starts[0]), int(b.ends[-1])
            three = np.concatenate([[0], np.cumsum(_threes(data[lo:hi]), dtype=np.int64)])
            own = three[b.ends - lo] == three[b.starts - lo]
            if not own.any():
                continue
            starts, ends = b.starts[own], b.ends[own]
            inside = _mask(starts, ends, lo, hi)
            # words side by side, with two edges between them
            n = ends - starts
            at = np.cumsum(n + 2) - n
            line = np.zeros(int(at[-1] + n[-1] + 1), np.int64)
            where = np.repeat(at - (starts - lo), n) + np.flatnonzero(inside)
            line[where] = SYMBOL[data[lo:hi][inside]]
            key = (line[:-2] * N + line[1:-1]) * N + line[2:]
            total += np.bincount(key, minlength=N**3)
    some = np.flatnonzero(total)
    for i in range(0, len(some), 10000):
        k = some[i : i + 10000]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["gram", "n"])


def _mask(starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
    m = np.zeros(hi - lo + 1, np.int8)
    np.add.at(m, starts - lo, 1)
    np.add.at(m, ends - lo, -1)
    return np.cumsum(m[:-1], dtype=np.int8) > 0


class CharModel:
    """-log P(symbol | two before), interpolated."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(N, N, N).astype(np.float64)
        tri, bi = c.sum(axis=2, keepdims=True), c.sum(axis=0)
        uni = bi.sum(axis=0)
        p1 = (uni + 1) / (uni.sum() + N)
        p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
        self.cost = -np.log((c + 20 * p2) / (tri + 20)).astype(np.float32)


def char_model(docs: DataFrame) -> CharModel:
    """Counts over all words of all documents."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    c = np.zeros(N**3, np.int64)
    for r in rows:
        c[r[0]] = r[1]
    return CharModel(c)


def decode(span: str, model: CharModel) -> str:
    """The cheapest reading of a suspicious span, in time and memory linear in its length."""
    text = span.lower()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    cost, symbol = model.cost.item, SYMBOL.tolist()
    for i, c in enumerate(text):
        raw = c.encode()
        if c in STANDS:
            arcs = [(COST_SIGN, x.encode()) for x in STANDS[c]] + [(COST_KEPT, raw)]
        elif c in SEPARATORS:
            arcs = [(COST_SEPARATOR, b""), (COST_SPACE, b" ")]
        else:
            arcs = [(0.0, raw)]
            if LETTER[raw[0]] and (i and text[i - 1] == c or i > 1 and text[i - 2] == c and text[i - 1] in SEPARATORS):
                arcs.append((COST_REPEAT, b""))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (v, back) in best.items():
            for w, out in arcs:
                k, x = (p, q), v + w
                if out and LETTER[out[0]]:
                    for s in out:
                        x += cost(*k, symbol[s])
                        k = (k[1], symbol[s])
                elif out:  # a kept sign or a space ends the word
                    k, x = (0, 0), x + (cost(p, q, 0) if q else 0.0)
                if k not in new or x < new[k][0]:
                    new[k] = (x, (back, out) if out else back)
        best = new
    _, back = min(((v + (cost(p, q, 0) if q else 0.0), t) for (p, q), (v, t) in best.items()), key=lambda x: x[0])
    parts = []
    while back:
        back, out = back
        parts.append(out)
    return b"".join(reversed(parts)).decode(errors="replace")


_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def _elongated(word: str) -> bool:
    """Whether a word of letters has one three times in a row that it would lose nothing without."""
    low = word.lower()
    return bool(_TRIPLE.search(low)) and len(set(low)) > 1 and not _ROMAN.fullmatch(low)
_ONE = "(?:[^\\W_]|[@$!|+])"
_DOTTED = re.compile(rf"^{_ONE}(?:[.\-_*,/:;|]{_ONE}){{2,}}$")
#: a bar may stand for a letter, but not where it stands between all letters
_BARRED = re.compile(r"^[^\W\d_](?:\|[^\W\d_]){2,}$")
#: signs at which a token falls into parts that are read by themselves
_PARTS = re.compile(r"([.:/=\",;&?#\-_*~'()\[\]{}<>%]+)")
_MAIL = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")


def _spelt(part: str) -> bool:
    """Whether signs stand among the letters of a part."""
    signs, alike = sum(c in STANDS for c in part), sum(c.isalpha() for c in part)
    return alike >= 2 and 0 < signs <= 1.5 * alike


class Restorer:
    """Finds suspicious spans and reads them; readings are remembered up to a bound."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def read(self, span: str) -> str:
        if len(span) > 256:  # too long to remember
            return decode(span, self.model)
        if (got := self.memo.get(span)) is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self.memo[span] = decode(span, self.model)
        return got

    def parts(self, text: str) -> str:
        """A token with signs between its parts: each part with signs among its letters is read, others lose repeated letters; addresses stay."""
        if _MAIL.fullmatch(text):
            return text
        out = []
        for part in _PARTS.split(text):
            if _spelt(part):
                out.append(self.read(part))
            else:
                out.append(_LETTERS.sub(lambda m: self.read(m[0]) if _elongated(m[0]) else m[0], part) if _TRIPLE.search(part.lower()) else part)
        return "".join(out)

    def spans(self, col):
        """(row, start, end, tokens set apart or none) in bytes of suspicious spans, in order; rows without any are passed over in numpy."""
        data, _ = tk.text_buffers(col)
        for b in tk.blocks(col, tk.NON_WHITE):
            n = len(b.starts)
            if not n:
                continue
            lo = int(b.starts[0])
            d = data[lo : int(b.ends[-1])]
            s, e = b.starts - lo, b.ends - lo
            size = e - s
            letters, signs = LETTER[d], SIGNS[d]
            count = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
            within = lambda c, a=s, z=e: c[z] - c[a]
            nl, ns, first, apart = (within(count(m)) for m in (letters, signs, STARTS[d], _IS_APART[d]))
            ct = count(_threes(d))
            nt = ct[e] - ct[s]
            row = np.repeat(np.arange(b.hi - b.lo), np.diff(b.ptr))
            odd = (nl >= 2) & ((nt > 0) | (ns > 0) | (first >= 2) & (apart >= 2) & (first <= apart + 1))
            found = [(int(row[x]) + b.lo, int(s[x]) + lo, int(e[x]) + lo, None) for x in np.flatnonzero(odd)]
            # a token of one letter or sign; before it, only the first of a row has more, and after it, the last
            tail, head = count(_IS_TAIL[d]), count(_IS_HEAD[d])
            sign = (nl == 0) & (ns > 0)
            left = (first == 1) & letters[e - 1] & (nl + within(head) == size) | sign & signs[e - 1] & (within(head, s, e - 1) == size - 1)
            right = (first == 1) & letters[s] & (nl + within(tail) == size) | sign & signs[s] & (within(tail, s + 1, e) == size - 1)
            joint = left[:-1] & right[1:] & (row[1:] == row[:-1])
            edge = np.diff(np.concatenate([[False], joint, [False]]).astype(np.int8))
            i, j = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            lettered = count(nl > 0)
            long = (j - i >= 2) & (lettered[j + 1] - lettered[i] >= 2)
            i, j = i[long], j[long]
            if len(i):
                gap = s[1:] - e[:-1]
                lines = count(_IS_LINE[d])
                gap = np.where(lines[s[1:]] > lines[e[:-1]], gap + len(d), gap)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    g = gap[x:y]
                    cut = [x - 1, *(x + np.flatnonzero(g > g.min())).tolist(), y]
                    for a, z in zip(cut[:-1], cut[1:], strict=True):
                        if z - a >= 3:
                            own = (int(row[x]) + b.lo, int(s[a + 1]) + lo, int(e[z]) + lo)
                            found.append((*own, [(int(p) + lo, int(q) + lo) for p, q in zip(s[a + 1 : z + 1], e[a + 1 : z + 1], strict=True)]))
            yield from sorted(found, key=lambda x: x[:3])

    def restore(self, col: pa.Array) -> pa.Array:
        """The column with suspicious spans replaced by their readings."""
        data, off = tk.text_buffers(col)
        new: dict[int, list] = {}
        for row, s, e, apart in self.spans(col):
            core = data[s:e].tobytes().rstrip(_TAIL)
            head = len(core) - len(core.lstrip(_HEAD))
            s, e = s + head, s + len(core)
            if apart:
                text = " ".join(data[max(p, s) : min(q, e)].tobytes().decode(errors="replace") for p, q in apart if q > s and p < e)
            else:
                text = data[s:e].tobytes().decode(errors="replace")
            signs = sum(c in STANDS for c in text)
            alike = sum(c.isalpha() for c in text)
            if apart:
                if text.count(" ") < 2 or not 2 <= alike or signs > 1.5 * alike or len(set(text.lower())) < 3:
                    continue
            else:
                if _BARRED.match(text):
                    text = text.replace("|", ".")
                parted = not _DOTTED.match(text) and (re.search(r"[.:/=\"]", text) or any(len(x) > 2 and _spelt(x) for x in _PARTS.split(text)[::2]) and _PARTS.search(text))
                whole = not parted and 2 <= alike and signs <= 1.5 * alike and (signs > 0 or _DOTTED.match(text))
                if not whole:
                    got = self.parts(text)
                    if got != text:
                        new.setdefault(row, []).append((s, e, got))
                    continue
            got = self.read(text)
            if got != text.lower():
                new.setdefault(row, []).append((s, e, got))
        if not new:
            return col
        out = col.to_pylist()
        for row, cuts in new.items():
            parts, at = [], int(off[row])
            for s, e, got in cuts:
                if s >= at:
                    parts += [data[at:s].tobytes().decode(errors="replace"), got]
                    at = e
            parts.append(data[at : int(off[row + 1])].tobytes().decode(errors="replace"))
            out[row] = "".join(parts)
        return pa.array(out, pa.large_string())


BEGINNINGS = (3, 4, 5, 6, 7)
_POWER = tk.mix(np.arange(1, 8, dtype=U64) + U64(3)) | U64(1)


def _word_features(col):
    """(block, list of (token index, hash)) of words and the beginnings of longer words."""
    data, _ = tk.text_buffers(col)
    for b in tk.blocks(col, LETTER):
        out = []
        if len(b.starts):
            n = b.ends - b.starts
            h = np.zeros(len(n), U64)
            idx = np.arange(len(n))
            starts = b.starts
            for j in range(max(BEGINNINGS)):
                longer = n > j
                if not longer.all():
                    idx, starts, h, n = idx[longer], starts[longer], h[longer], n[longer]
                h = h + tk.SUB_LOWER[data[starts + j]] * _POWER[j]
                if j + 1 in BEGINNINGS:
                    m = n > j + 1
                    out.append((idx[m], tk.mix(h[m] + U64(j + 1))))
            out.append((np.arange(len(b.starts)), b.hashes))
        yield b, out


def _row_features(col):
    for b, parts in _word_features(col):
        row = np.repeat(np.arange(b.hi - b.lo), np.diff(b.ptr))
        r = np.concatenate([row[i] for i, _ in parts]) if parts else np.zeros(0, np.int64)
        h = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, U64)
        order = np.argsort(r, kind="stable")
        r, h = r[order], h[order]
        ptr = np.searchsorted(r, np.arange(b.hi - b.lo + 1))
        for k in range(b.hi - b.lo):
            yield b.lo + k, np.unique(h[ptr[k] : ptr[k + 1]])


def _counts(model):
    def run(batches):
        fix = Restorer(model.value)
        for rb in batches:
            y = rb.column(2).to_numpy()
            feats, ones = [], []
            for r, f in _row_features(fix.restore(rb.column(1))):
                feats.append(f)
                ones.append(np.full(len(f), y[r]))
            if feats:
                u, inv = np.unique(np.concatenate(feats), return_inverse=True)
                n = np.bincount(inv)
                t = np.bincount(inv, weights=np.concatenate(ones))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n)], ["f", "t", "n"])

    return run


def _members(model, chosen):
    def run(batches):
        fix, known = Restorer(model.value), np.array(chosen, np.int64).view(U64)
        for rb in batches:
            out = [b""] * rb.num_rows
            for r, f in _row_features(fix.restore(rb.column(1))):
                k = np.searchsorted(known, f)
                k = k[(k < len(known)) & (known[np.minimum(k, len(known) - 1)] == f)] if len(known) else k[:0]
                out[r] = k.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    return run


class Lexicon:
    """A logistic model over chosen features."""

    def __init__(self, known: np.ndarray, sets: list[np.ndarray], y: np.ndarray, steps: int = 1500):
        self.known, self.flat = known, None
        self.w, self.b = np.zeros(len(known)), 0.0
        if not len(known) or len(set(np.round(y))) < 2:
            self.flat = (y.sum() + 1) / (len(y) + 2)
        else:
            rng = np.random.default_rng(3)
            rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
            self.b = math.log(rate / (1 - rate))
            m, v, step = np.zeros(len(known) + 1), np.zeros(len(known) + 1), 0
            epochs = -(-steps // -(-len(y) // 256))
            for epoch in range(epochs):
                order = rng.permutation(len(y))
                for i in range(0, len(order), 256):
                    k = order[i : i + 256]
                    x = np.zeros((len(k), len(known)), np.float32)
                    for a, s in enumerate(k):
                        x[a, sets[s]] = 1
                    p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
                    g = np.append(x.T @ (p - y[k]) / len(k) + 1e-4 * self.w, np.mean(p - y[k]))
                    step += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    d = 0.02 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    self.w, self.b = self.w - d[:-1], self.b - d[-1]
        self.table = np.zeros(1 << 20, bool)
        self.table[(known & U64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, col: pa.Array) -> np.ndarray:
        z = np.full(len(col), self.b)
        if self.flat is not None:
            return np.full(len(col), float(self.flat))
        for b, parts in _word_features(col):
            row = np.repeat(np.arange(b.lo, b.hi), np.diff(b.ptr))
            seen = []
            for i, h in parts:
                q = self.table[(h & U64((1 << 20) - 1)).astype(np.int64)]
                i, h = i[q], h[q]
                k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                q = self.known[k] == h
                seen.append(row[i[q]] * len(self.known) + k[q])
            if seen:
                u = np.unique(np.concatenate(seen))
                np.add.at(z, u // len(self.known), self.w[u % len(self.known)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", parts: int = 5, out: int = 0, max_train: int = 12000, max_features: int = 1500) -> tuple[CharModel, Lexicon]:
    """A character model from all documents; a lexicon from at most ``max_train`` labelled ones."""
    spark = docs.sparkSession
    model = char_model(docs)
    held = spark.sparkContext.broadcast(model)
    some = labelled(labels, column, parts, out, max_train)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stage(own.join(F.broadcast(some), "doc_id").select("doc_id", "text", "y"), "toxic-sample").repartition(12)
    size = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, t = size[0], size[1] or 0.0
    chosen: list[int] = []
    if 0 < t < n:
        share = F.col("t") / F.lit(t) - (F.col("n") - F.col("t")) / F.lit(n - t)
        odds = F.col("n") / F.lit(n)
        z = share / F.sqrt(odds * (1 - odds + 1e-9) * F.lit(1 / t + 1 / (n - t)))
        feats = sample.mapInArrow(_counts(held), "f long, t double, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        chosen = [r[0] for r in feats.filter("n >= 3").select("f", z.alias("z")).filter("z > 4").orderBy(F.desc("z"), "f").limit(max_features).collect()]
    known = np.sort(np.array(chosen, np.int64).view(U64))
    rows = sample.mapInArrow(_members(held, known.view(np.int64).tolist()), "doc_id long, y double, x binary").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    return model, Lexicon(known, [np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    both = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        model, lexicon = both.value
        fix = Restorer(model)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(lexicon(fix.restore(rb.column(1))))], ["doc_id", "score"])

    parts, out = options.get("parts", 5), options.get("out", 0)
    held = F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def restore(docs: DataFrame) -> DataFrame:
    """``docs`` with suspicious spans of ``text`` replaced by their readings."""
    model = docs.sparkSession.sparkContext.broadcast(char_model(docs))
    at = docs.columns.index("text")

    def run(batches):
        fix = Restorer(model.value)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([fix.restore(c).cast(pa.string()) if i == at else c for i, c in enumerate(rb.columns)], rb.schema.names)

    return docs.mapInArrow(run, docs.schema)
