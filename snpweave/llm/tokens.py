"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Texts are read as bytes straight from Arrow's buffers, in blocks of about ``BLOCK`` bytes, so
memory does not follow the length of a text or a batch.  A token is a maximal run of bytes of a
class; its 64-bit hash is a polynomial over substituted bytes, taken from prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: bytes of ``[^\x20\x09-\x0D]+``
NON_WHITE = ~WHITE
#: digits, letters and all that is not ASCII
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SUB = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
#: equal for A-Z and a-z
SUB_LOWER = _SUB[LOWER]
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64))]) for b in (_BASE & _MASK, inv))
    return _powers


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory it no longer needs back to the system after each result: workers are kept for later tasks."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        if (f := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            f(0)

    def own(batches):
        for out in run(batches):
            yield out
            del out
            trim()
        trim()

    return own


def fold_latin(d: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of Latin-1 (two bytes, the first 0xC3) as small letters."""
    m = np.zeros(len(d), bool)
    m[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
    return d + m.astype(np.uint8) * np.uint8(32)


@dataclass
class Block:
    """Tokens of rows ``lo`` to ``hi``: those of row ``lo + i`` are ``ptr[i]:ptr[i + 1]``."""

    lo: int
    hi: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray


def _run(data: np.ndarray, base: int, breaks: np.ndarray, cls: np.ndarray, sub: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z
    tok = cls[data]
    new = tok.copy()
    if cls.dtype == bool:
        new[1:] &= ~tok[:-1]
        last = tok.copy()
        last[:-1] &= ~tok[1:]
    else:  # several classes: a run ends where the class changes; class 0 is between tokens
        new = tok > 0
        new[1:] &= tok[1:] != tok[:-1]
        last = tok > 0
        last[:-1] &= tok[1:] != tok[:-1]
    if len(breaks):
        new[breaks] = tok[breaks] > 0
        b = breaks[breaks > 0] - 1
        last[b] = tok[b] > 0
    s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
    up, down = _tables(max(n, BLOCK * 2))
    v = sub[fold_latin(data) if fold else data] * up[:n]
    np.cumsum(v, out=v)
    h = v[e - 1]
    h[s > 0] -= v[s[s > 0] - 1]
    h = mix(h * down[s] + (e - s).astype(U64))
    return h, s + base, e + base


def blocks(col: pa.Array, cls: np.ndarray = NON_WHITE, sub: np.ndarray = SUB_LOWER, fold: bool = False) -> Iterator[Block]:
    """The tokens of each row, by blocks of whole rows.

    ``cls`` marks the bytes of tokens (or numbers several classes, of which a token has one), ``sub``
    substitutes bytes before hashing, ``fold`` equates Latin-1 capitals with small letters.  A row longer than a block is cut at bytes between tokens.
    """
    data, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
        a, b = int(off[lo]), int(off[hi])
        parts = []
        while b - a > 2 * BLOCK:  # one very long row
            cut = a + BLOCK
            while cut < b:
                window = data[cut : min(b, cut + 4096)]
                if len(gap := np.flatnonzero(cls[window] == 0)):
                    cut += int(gap[0])
                    break
                cut += len(window)
            parts.append(_run(data[a:cut], a, np.zeros(0, np.int64), cls, sub, fold))
            a = cut
        cuts = off[lo:hi] - a
        parts.append(_run(data[a:b], a, cuts[(cuts >= 0) & (cuts < b - a)], cls, sub, fold))
        h, s, e = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        yield Block(lo, hi, h, s, e, np.searchsorted(s, off[lo : hi + 1]))
        lo = hi


def shingle_hashes(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-token shingles of a block's rows, and where each row's begin.

    A row with fewer tokens has its whole sequence as its only shingle; one without tokens has none.
    """
    coef = mix(np.arange(101, 101 + k, dtype=U64) * U64(_BASE)) | U64(1)
    count = np.diff(b.ptr)
    m = len(b.hashes)
    if k > 1 and m >= k:
        h = b.hashes[: m - k + 1] * coef[0]
        for j in range(1, k):
            h += b.hashes[j : m - k + 1 + j] * coef[j]
    else:
        h = b.hashes * coef[0] if k == 1 else np.zeros(0, U64)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ptr = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(ptr[-1]), U64)
    full = count >= k
    if full.all():
        idx = np.arange(len(out)) - np.repeat(ptr[:-1] - b.ptr[:-1], n)
        out[:] = h[idx] if len(out) else out
    else:
        rows = np.flatnonzero(full)
        if len(rows):
            nn = n[rows]
            rep = np.repeat(np.arange(len(rows)), nn)
            within = np.arange(int(nn.sum())) - np.repeat(np.concatenate([[0], np.cumsum(nn)[:-1]]), nn)
            out[ptr[rows][rep] + within] = h[b.ptr[rows][rep] + within]
        for r in np.flatnonzero((~full) & (count > 0)):
            t = b.hashes[b.ptr[r] : b.ptr[r + 1]]
            out[ptr[r]] = (int((t * coef[: len(t)]).sum(dtype=U64)) + len(t) * _BASE) & _MASK
    return mix(out), ptr


def range_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``s:e`` of ``data``."""
    up, down = _tables(max(len(data), BLOCK * 2))
    v = sub[data] * up[: len(data)]
    np.cumsum(v, out=v)
    h = v[e - 1]
    h[s > 0] -= v[s[s > 0] - 1]
    return mix(h * down[s] + (e - s).astype(U64))


def long_hash(data: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """``range_hash`` of the whole of ``data``, in pieces of ``BLOCK`` bytes."""
    up, _ = _tables(BLOCK * 2)
    total = 0
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        total = (total + int((sub[part] * up[: len(part)]).sum(dtype=U64)) * pow(_BASE, i, 1 << 64)) & _MASK
    return mix(np.array([(total + len(data)) & _MASK], U64))
