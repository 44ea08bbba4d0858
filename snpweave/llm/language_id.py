"""Language identification in two steps: the family first, then a language of that family.

1. Texts become counts of letter n-grams (1 to 4 bytes of lower-cased letters, words apart by one blank), hashed to
   ``BUCKETS`` columns.  A row is its counts over their sum, each column over the root of its mean share in the sample.
2. Families are told apart by one-versus-rest linear support vector machines, languages of a family by one-versus-one
   machines: each pair of languages votes, ties go to the larger sum of margins.  All minimise the squared hinge loss.
3. Margins become probabilities by a logistic curve fitted to margins of rows that the machine was not fitted on (a
   quarter of the sample); ``score`` is the family's share times the language's share among its family.

The machines are fitted on at most ``sample`` labelled rows (2,400 by default), the same number for each language, by
the smallest hashes of doc_id; their columns travel to the driver, at most ``BUCKETS`` values for a row.  Everything
else covers all rows: each text is read whole, in blocks, and scored in the task that reads it; nothing is shuffled.
Families are fixed values; a language that is in none is a family of its own.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their text nor their language is learnt from.

Defined results
* ``lang_pred`` is ``und`` and score 0 where the text is null or has no letter (of any script), or nothing was learnt.
* with one learnt language, that one, with score 1.  A null doc_id is not learnt from and counts as held out = null.
* repeated rows are scored alike; languages are taken as written ("" and "EN" are languages of their own).
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import LOWER, fold_latin, lean, text_buffers

BUCKETS, ORDERS, SAMPLE, CHUNK = 1 << 15, (1, 2, 3, 4), 2_400, 1 << 19
#: fixed values: codes of ISO 639-1 by family
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "indic": "hi mr ne bn gu pa ur",
    "malayic": "id ms",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: bytes of words: ASCII letters and all that is not ASCII
_WORD = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_MUL = [0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"={lang}")


def _grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a piece of text; words stand apart by one blank, also at both ends."""
    word = _WORD[data]
    d = np.where(word, LOWER[fold_latin(data)], 32).astype(np.uint8)
    keep = word.copy()
    keep[1:] |= word[:-1]
    d = np.concatenate([[32], d[keep], [32]]).astype(np.uint32)
    out = []
    for n in ORDERS:
        m = len(d) - n + 1
        if m > 0:
            v = d[:m].copy()
            for k in range(1, n):
                v = (v << np.uint32(8)) | d[k : m + k]
            v *= np.uint32(_MUL[n])
            v ^= v >> np.uint32(15)
            out.append((v * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15))
    return np.concatenate(out)


def _counts(data: np.ndarray) -> np.ndarray:
    """Counts by bucket of a whole text, in blocks that end between words where they can."""
    total, at = np.zeros(BUCKETS, np.int64), 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gap = np.flatnonzero(~_WORD[data[max(at, end - 4096) : end]])
            if len(gap):
                end = max(at, end - 4096) + int(gap[-1]) + 1
        total += np.bincount(_grams(data[at:end]), minlength=BUCKETS)
        at = end
    return total


def _has_letter(data: np.ndarray) -> bool:
    if _WORD[data[data < 128]].any():
        return True
    rest = data.tobytes().decode("utf-8", "ignore") if len(data) and (data >= 128).any() else ""
    return any(c.isalpha() for c in rest)


def _texts(col: pa.Array) -> Iterator[np.ndarray]:
    data, off = text_buffers(col)
    for k in range(len(off) - 1):
        yield data[off[k] : off[k + 1]]


@dataclass
class Rows:
    """Sparse rows: the columns and values of row i are ``ptr[i]:ptr[i + 1]``."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.ptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(n)])
        col, val = np.empty(ptr[-1], self.col.dtype), np.empty(ptr[-1], self.val.dtype)
        for k, r in enumerate(rows):
            col[ptr[k] : ptr[k + 1]], val[ptr[k] : ptr[k + 1]] = self.col[self.ptr[r] : self.ptr[r + 1]], self.val[self.ptr[r] : self.ptr[r + 1]]
        return Rows(ptr, col, val)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.ptr) - 1)
        for lo, hi, part in self._parts():
            s = np.concatenate([[0.0], np.cumsum(self.val[part] * w[self.col[part]], dtype=np.float64)])
            at = self.ptr[lo : hi + 1] - self.ptr[lo]
            out[lo:hi] = s[at[1:]] - s[at[:-1]]
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for lo, hi, part in self._parts():
            out += np.bincount(self.col[part], self.val[part] * np.repeat(g[lo:hi], np.diff(self.ptr[lo : hi + 1])), BUCKETS)
        return out

    def _parts(self, rows: int = 200) -> Iterator[tuple[int, int, slice]]:
        """Some rows at a time: what is derived from all values is never there at once."""
        for lo in range(0, len(self.ptr) - 1, rows):
            hi = min(lo + rows, len(self.ptr) - 1)
            yield lo, hi, slice(int(self.ptr[lo]), int(self.ptr[hi]))


def fit_machine(x: Rows, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine for labels of +1 and -1; both sides weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    size = max((float((x.val[x.ptr[k] : x.ptr[k + 1]].astype(np.float64) ** 2).sum()) for k in range(len(y))), default=0.0) + 1.0
    step = 1.0 / (2 * size + penalty)
    w, b = np.zeros(BUCKETS), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):  # accelerated gradient steps
        miss = np.maximum(0.0, 1 - y * (x.dot(vw) + vb))
        g = -2 * share * y * miss
        nw, nb = vw - step * (x.back(g) + penalty * vw), vb - step * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -40, 40)))
        r, h = goal - p, p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-4]])
        da, dc = np.linalg.solve(m, [(r * margin).sum(), r.sum()])
        a, c = float(np.clip(a + np.clip(da, -2, 2), 0.05, 200)), float(np.clip(c + np.clip(dc, -2, 2), -40, 40))
    return a, c


@dataclass
class Model:
    """``families``: names; each has languages; ``weights`` has a column for each machine."""

    families: list[str]
    langs: list[list[str]]
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    curve: np.ndarray
    pairs: list[list[tuple[int, int, int]]]  # of each family: (language, language, machine)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of rows of counts."""
        share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) * self.scale
        margin = share @ self.weights + self.shift
        chance = 1 / (1 + np.exp(-np.clip(self.curve[:, 0] * margin + self.curve[:, 1], -40, 40)))
        n = len(self.families)
        odds = chance[:, :n] if n > 1 else np.ones((len(counts), 1))
        top = odds.argmax(axis=1)
        score = odds.max(axis=1) / odds.sum(axis=1)
        out = []
        for r, f in enumerate(top.tolist()):
            names = self.langs[f]
            votes, sums, logs = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
            for i, j, k in self.pairs[f]:
                m, p = margin[r, k], min(max(chance[r, k], 1e-12), 1 - 1e-12)
                votes[i if m >= 0 else j] += 1
                sums[i] += m
                sums[j] -= m
                logs[i] += np.log(p)
                logs[j] += np.log(1 - p)
            best = max(range(len(names)), key=lambda i: (votes[i], sums[i], -i))
            e = np.exp(logs - logs.max())
            score[r] *= e[best] / e.sum()
            out.append(names[best])
        return out, np.clip(score, 0.0, 1.0)


def fit(x: Rows, langs: np.ndarray, spare: np.ndarray) -> Model | None:
    """The machines; ``spare`` marks rows kept for the curves."""
    if not len(langs):
        return None
    total = x.back(np.ones(len(langs)))
    scale = (1 / np.sqrt(total / max(total.sum(), 1e-12) + 1e-6)).astype(np.float32)
    x = Rows(x.ptr, x.col, x.val * scale[x.col])
    families = sorted({family(g) for g in langs})
    names = [sorted({str(g) for g in langs if family(g) == f}) for f in families]
    own = np.array([families.index(family(g)) for g in langs])
    weights, shift, curve, pairs = [], [], [], []

    def machine(rows: np.ndarray, y: np.ndarray) -> int:
        known = ~spare[rows] if len(set(y[~spare[rows]])) == 2 else np.ones(len(rows), bool)
        w, b = fit_machine(x.take(rows[known]), y[known])
        judge = ~known if len(set(y[~known])) == 2 else known
        weights.append(w)
        shift.append(b)
        curve.append(fit_curve(x.take(rows[judge]).dot(w) + b, y[judge]))
        return len(weights) - 1

    if len(families) > 1:
        for f in range(len(families)):
            machine(np.arange(len(own)), np.where(own == f, 1.0, -1.0))
    for f, inside in enumerate(names):
        found = []
        for i in range(len(inside)):
            for j in range(i + 1, len(inside)):
                rows = np.flatnonzero((langs == inside[i]) | (langs == inside[j]))
                found.append((i, j, machine(rows, np.where(langs[rows] == inside[i], 1.0, -1.0))))
        pairs.append(found)
    return Model(families, names, scale, np.array(weights).reshape(-1, BUCKETS).T, np.array(shift), np.array(curve).reshape(-1, 2), pairs)


def _features(batches) -> Iterator[pa.RecordBatch]:
    """Columns and values of whole texts that have letters."""
    for rb in batches:
        lang, spare, col, val = [], [], [], []
        for k, data in enumerate(_texts(rb.column(1))):
            if _has_letter(data):
                c = _counts(data)
                at = np.flatnonzero(c)
                lang.append(rb.column(0)[k].as_py())
                spare.append(rb.column(2)[k].as_py())
                col.append(at.astype(np.uint16).tobytes())
                val.append((c[at] / c.sum()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(spare, pa.bool_()), pa.array(col, pa.binary()), pa.array(val, pa.binary())], ["lang", "spare", "col", "val"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled rows that are not held out; at most ``sample`` rows, the same number of each language."""
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''").filter(F.crc32("id") % 5 != 0).withColumn("h", F.xxhash64("id"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return None
    each = max(2, sample // len(sizes))
    # a hash under its language's share lets about half as many again through; the rank then takes the smallest
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.5 * each + 50) / r["n"])))])
    near = own.filter((F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "id"))).filter(F.col("k") <= each)
    got = first.select("lang", "text", (F.col("k") % 4 == 0).alias("spare")).mapInArrow(lambda b: _features(rb.select(["lang", "text", "spare"]) for rb in b), "lang string, spare boolean, col binary, val binary").toArrow()
    if not got.num_rows:
        return None
    cols, vals = ([np.frombuffer(v.as_buffer(), kind) for v in got.column(name)] for name, kind in (("col", np.uint16), ("val", np.float32)))
    x = Rows(np.concatenate([[0], np.cumsum([len(c) for c in cols])]), np.concatenate(cols), np.concatenate(vals))
    return fit(x, np.array(got.column("lang").to_pylist(), object), np.array(got.column("spare").to_pylist(), bool))


def _predict(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rb in batches:
            lang, score = [], []

            def settle(rows, lang=lang, score=score):
                at = [k for k, c in enumerate(rows) if c is not None]
                names, s = model.predict(np.array([rows[k] for k in at], np.float32)) if at else ([], [])
                found = dict(zip(at, zip(names, s, strict=True), strict=True))
                lang.extend(found[k][0] if k in found else "und" for k in range(len(rows)))
                score.extend(float(found[k][1]) if k in found else 0.0 for k in range(len(rows)))

            rows = []
            for data in _texts(rb.column(2)):
                rows.append(_counts(data) if model is not None and _has_letter(data) else None)
                if len(rows) == 64:
                    settle(rows)
                    rows = []
            settle(rows)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each document."""
    model = train(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS values for each family and pair of its languages
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(_predict(shared)), "doc_id long, held_out boolean, lang_pred string, score double")
