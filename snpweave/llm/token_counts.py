"""Token counts by section: whole documents are encoded once and tokens are joined to spans.

Tokens of a byte-level vocabulary are byte strings that add up to the text, so the running sum of their
lengths gives every token's byte span exactly.  Sections are sorted spans; a sorted interval search joins
each token to the section that gets it under an explicit rule:

* ``start``: the section that holds the token's first byte; a token that begins between sections goes to
  the next section it reaches into, or to none (``outside``);
* ``most``: the section that holds most of its bytes, ties to the earlier one, or to none.

A token crosses when it has bytes in a section and beyond that section's end.  The work is per row, in
blocks of Arrow rows; nothing is shuffled.  The vocabulary's path is a parameter and must exist on all nodes.

Defined results
* null or empty text: no tokens; one empty section.
* sections given with overlaps are cut where the next begins; empty sections get no token.
* null ``doc_id`` and repeated rows are counted like others; an empty table gives an empty result;
  further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how the public vocabulary splits text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, tuple] = {}


def encoder(path: str = VOCABULARY):
    """The encoding and the byte length of each token; loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[path]


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the byte spans of the tokens of a text."""
    enc, size = encoder(path)
    ids = np.array(enc.encode_ordinary(text), np.int64)
    end = np.cumsum(size[ids])
    return ids, end - size[ids], end


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each line as a section, without its newline."""
    cut = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(raw)]])


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence with the white space that ends it, and each line with its newline, as a section."""
    d = np.frombuffer(raw, np.uint8)
    stop = np.isin(d, np.frombuffer(b".!?", np.uint8))
    cut = np.union1d(np.flatnonzero(d == 10) + 1, np.flatnonzero(stop[:-1] & (d[1:] == 32)) + 2) if len(d) else np.zeros(0, np.int64)
    cut = cut[cut < len(d)]
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(d)]]).astype(np.int64)


def attribute(start: np.ndarray, end: np.ndarray, s: np.ndarray, e: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: outside) and whether it crosses; ``s`` and ``e`` are sorted spans."""
    e = np.minimum(e, np.append(s[1:], np.iinfo(np.int64).max))
    real = np.flatnonzero(e > s)
    if not len(real):
        return np.full(len(start), -1), np.zeros(len(start), bool)
    s, e = s[real], e[real]
    i = np.searchsorted(s, start, "right") - 1
    held = (i >= 0) & (start < e[np.maximum(i, 0)])
    nxt = np.minimum(np.searchsorted(e, start, "right"), len(s) - 1)
    reach = (s[nxt] < end) & (e[nxt] > start)
    first = np.where(held, i, np.where(reach, nxt, -1))
    crosses = (first >= 0) & (end > e[np.maximum(first, 0)])
    if rule == "most":
        best = first.copy()
        t = np.flatnonzero(crosses)
        k = np.minimum(first[t] + 1, len(s) - 1)
        here = e[first[t]] - np.maximum(s[first[t]], start[t])
        there = np.where(k > first[t], np.minimum(e[k], end[t]) - s[k], 0)
        best[t] = np.where(there > here, k, first[t])
        for t in t[(k > first[t]) & (end[t] > e[k])]:  # over two boundaries or more
            k = int(first[t])
            top, at = -1, k
            while k < len(s) and s[k] < end[t]:
                part = min(e[k], end[t]) - max(s[k], start[t])
                if part > top:
                    top, at = part, k
                k += 1
            best[t] = at
        first = best
    elif rule != "start":
        raise ValueError(f"no such rule: {rule}")
    return np.where(first >= 0, real[np.maximum(first, 0)], -1), crosses


def _count(path: str, rule: str, sections: Callable[[bytes], tuple[np.ndarray, np.ndarray]]):
    def run(batches):
        for rb in batches:
            out = []
            for text in rb.column(1).to_pylist():
                text = text or ""
                _, a, b = token_spans(text, path)
                s, e = sections(text.encode())
                at, crosses = attribute(a, b, s, e, rule)
                n = np.bincount(at[at >= 0], minlength=len(s))
                out.append((len(a), n.tolist(), int(crosses.sum()), int((at < 0).sum())))
            c = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.list_(pa.int64())), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], ["doc_id", "n_tokens", "section_tokens", "crossing", "outside"])

    return run


def section_tokens(docs: DataFrame, path: str = VOCABULARY, rule: str = "start", sections: Callable[[bytes], tuple[np.ndarray, np.ndarray]] = lines) -> DataFrame:
    """(doc_id, n_tokens, section_tokens, crossing, outside); n_tokens = the sum of section_tokens + outside."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_count(path, rule, sections), "doc_id long, n_tokens long, section_tokens array<long>, crossing long, outside long")


def field_tokens(rows: DataFrame, key: str, fields: list[str], separator: str = "\n", path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """Tokens of each field when the fields are encoded as one document: (key, n_tokens, one column for each field).

    A null field is empty.  ``key`` keeps its type.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for rb in batches:
            cols = [rb.column(i + 1).to_pylist() for i in range(len(fields))]
            out = []
            for values in zip(*cols, strict=True):
                raw = [(v or "").encode() for v in values]
                n = np.array([len(x) for x in raw], np.int64)
                s = np.concatenate([[0], np.cumsum(n + len(separator.encode()))[:-1]])
                ids, a, b = token_spans(separator.join(v or "" for v in values), path)
                at, _ = attribute(a, b, s, s + n, rule)
                out.append((len(ids), *np.bincount(at[at >= 0], minlength=len(fields)).tolist()))
            c = list(zip(*out, strict=True)) or [()] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(x, pa.int64()) for x in c)], ["key", "n", *[f"f{i}" for i in range(len(fields))]])

    own = rows.select(F.col(key), *[F.col(f).cast("string") for f in fields])
    got = own.mapInArrow(run, ", ".join([f"key {kind}", "n long", *[f"f{i} long" for i in range(len(fields))]]))
    return got.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), *[F.col(f"f{i}").alias(f"{f}_tokens") for i, f in enumerate(fields)])
