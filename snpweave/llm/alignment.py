"""Alignment of two tokenizers: which tokens of A end where tokens of B end, and how often over the corpus.

Side A is a byte-level vocabulary (space and text are encoded), side B a piece vocabulary that adds the space itself.
Both cover the same bytes, so offsets where tokens of both end cut a document into groups; the tokens that end there are
a link.  Counts of links over the corpus are kept in dense matrices, striped by the id of B.

1. *Encode*, once for each document; the result is staged.  Documents go in lots (at most ``LOT`` documents and
   ``LOT_LINKS`` distinct links).  A lot has a row with what concerns its documents, and a row for each of 32 stripes
   (B id modulo 32) with its links: document within the lot, pair, multiplicity.
2. *Count*: tasks sum their pairs, which then go to blocks (B id modulo 512).  A block is a matrix of at most
   63 rows (B ids) by all A ids, filled by ``np.add.at``; row maxima say which pairs are the best of their B id.
3. *Score*, where the links are: each stripe's counts (only those over 0) go to its links.  A stripe with many links is
   split by lot into cells of at most 1/64 of all links, or 2^28 where that is less; each cell gets the stripe's counts.
   Rows stream, sorted so that a cell's counts come first.
4. Sums by stripe come back to the lot and are added.

A text is encoded in pieces of about ``PIECE`` characters, cut before a single blank between two word characters: neither
vocabulary has tokens over such a place, so the tokens are those of the whole text.  Side A is run by the library that is
faster when merges are numbered in their order, else by the one that reads the file itself; tests compare the two.
Vocabularies' paths are parameters and must exist on all nodes.

Defined results
* null or empty text, or one that either side's tokens don't spell (a normaliser, a letter that stands for a blank): no
  tokens, zeros, and ``groups_sha256`` is the empty string.
* special tokens' strings are plain text.  Texts of any length are read whole.
* each row, repeated or with a null doc_id, gets a row.  Ties for a B id's highest count are all best.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .token_counts import PATTERN
from .tokens import lean

SIDE_A, SIDE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
STRIPES, BLOCKS = 32, 512
LOT, LOT_LINKS, PIECE, CELL = 256, 400_000, 1 << 15, 1 << 28
_CUT = re.compile(r"\w (?=\w)")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100 on."""
    plain = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ``encode`` gives ids, ``raw`` the bytes of each id, ``size`` their lengths."""

    def __init__(self, encode, raw: list[bytes], name: str):
        self.encode, self.raw, self.name = encode, raw, name
        self.size = np.array([len(x) for x in raw], np.int64)


@functools.cache
def byte_side(path: str, own: bool = True) -> Side:
    """Side A.  ``own=False`` always takes the library that reads the file itself."""
    with open(path) as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], _byte_letters()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        raw[i] = token.encode() if token in added else bytes(letters[c] for c in token)
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    ordered = own and spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and [vocab[m] for m in merges] == list(range(256, 256 + len(merges)))
    if ordered:
        import tiktoken

        encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={raw[i]: i for token, i in vocab.items() if token not in added}, special_tokens={})
        return Side(encoding.encode_ordinary, raw, "ranks")
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return Side(lambda text: t.encode(text, add_special_tokens=False).ids, raw, "file")


@functools.cache
def piece_side(path: str) -> Side:
    """Side B."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.vocab_size()) for p in [sp.id_to_piece(i)]]
    return Side(lambda text: sp.encode(text, num_threads=1), raw, "pieces")


@functools.cache
def _written(n_a: int, n_b: int) -> list[bytes]:
    """How ids are written: A inside a group, A at its end, B inside, B at the end."""
    return [b"%d%s" % (i, end) for n, ends in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for end in (ends[:1], ends[1:])]


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text in pieces, and whether a piece follows another (it begins with a blank)."""
    at, first = 0, True
    while at < len(text):
        m = _CUT.search(text, at + size) if len(text) - at > size else None
        end = m.start() + 1 if m else len(text)
        yield text[at:end], not first
        at, first = end, False


def align(text: str | None, a: Side, b: Side) -> tuple[int, int, np.ndarray, np.ndarray, str]:
    """Numbers of tokens, ids of A and of B of each link in order, and the digest of the groups."""
    none = np.zeros(0, np.int64)
    if not text:
        return 0, 0, none, none, ""
    n_a = n_b = 0
    out_a, out_b, digest, table = [], [], hashlib.sha256(), _written(len(a.raw), len(b.raw))
    for k, (piece, follows) in enumerate(pieces(text)):
        whole = piece if follows else " " + piece
        ids_a, ids_b = a.encode(whole), b.encode(piece[1:] if follows else piece)
        raw = whole.encode()
        if b"".join([a.raw[i] for i in ids_a]) != raw or b"".join([b.raw[i] for i in ids_b]) != raw:
            return 0, 0, none, none, ""
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        ends = np.zeros(len(raw) + 1, np.int8)
        ends[end_a] = 1
        ends[end_b] += 2
        last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        out_a.append(ids_a[at_a])
        out_b.append(ids_b[at_b])
        n_a += len(ids_a)
        n_b += len(ids_b)
        code = np.empty(len(ids_a) + len(ids_b), np.int64)  # a group's tokens of A, then its tokens of B
        before = np.concatenate([[0], at_b[:-1] + 1])
        code[np.arange(len(ids_a)) + before[np.cumsum(last_a) - last_a]] = 2 * ids_a + last_a
        code[np.arange(len(ids_b)) + at_a[np.cumsum(last_b) - last_b] + 1] = 2 * len(a.raw) + 2 * ids_b + last_b
        if k:
            digest.update(b";")
        digest.update(b"".join([table[c] for c in code.tolist()])[:-1])
    return n_a, n_b, np.concatenate(out_a), np.concatenate(out_b), digest.hexdigest()


_ENCODED = (
    "lot long, stripe int, n long, docs binary, keys binary, mult binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, sha array<string>"
)


def _encode(path_a: str, path_b: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        a, b, width = byte_side(path_a), piece_side(path_b), len(byte_side(path_a).raw)
        base, held, links = TaskContext.get().partitionId() << 32, [], 0
        names = [c.split(" ")[0] for c in _ENCODED.split(", ")]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3, *[longs] * 4, pa.list_(pa.string())]

        def send():
            nonlocal base, held, links
            none = [None] * 3
            rows = [(base, -1, 0, *none, *[[h[c] for h in held] for c in range(5)])]
            doc = np.repeat(np.arange(len(held)), [len(h[5]) for h in held])
            key, mult = (np.concatenate([h[c] for h in held]) for c in (5, 6))
            side = key // width
            order = np.argsort(side % STRIPES, kind="stable")
            doc, key, mult, side = doc[order], key[order], mult[order], side[order]
            cut = np.searchsorted(side % STRIPES, np.arange(STRIPES + 1))
            key = side // STRIPES * width + key % width
            for s in range(STRIPES):
                lo, hi = cut[s], cut[s + 1]
                if hi > lo:
                    rows.append((base, s, int(mult[lo:hi].sum()), doc[lo:hi].astype(np.uint16).tobytes(), key[lo:hi].astype(np.uint32).tobytes(), mult[lo:hi].astype(np.uint32).tobytes(), *none, *none[:2]))
            base, held, links = base + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for rb in batches:
            ids = rb.column(0).to_pylist()
            for i, doc_id in enumerate(ids):
                n_a, n_b, link_a, link_b, sha = align(rb.column(1)[i].as_py(), a, b)
                key, mult = np.unique(link_b * width + link_a, return_counts=True)
                held.append((doc_id, n_a, n_b, len(link_a), sha, key, mult))
                links += len(key)
                if len(held) == LOT or links > LOT_LINKS:
                    yield send()
        if held:
            yield send()

    return run


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _presum(width: int):
    """A task's links by block: (block, keys, counts)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = []

        def settle():
            nonlocal keys, counts, held
            keys, counts = _summed(np.concatenate([keys, *[h[0] for h in held]]), np.concatenate([counts, *[h[1] for h in held]]))
            held = []

        def send():
            nonlocal keys, counts
            side = keys // width
            order = np.argsort(side % BLOCKS, kind="stable")
            side, key, n = side[order], keys[order], counts[order]
            cut = np.searchsorted(side % BLOCKS, np.arange(BLOCKS + 1))
            key = (side // BLOCKS * width + key % width).astype(np.uint32)
            rows = [(b, key[cut[b] : cut[b + 1]].tobytes(), n[cut[b] : cut[b + 1]].tobytes()) for b in range(BLOCKS) if cut[b + 1] > cut[b]]
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], ["block", "keys", "counts"])

        for rb in batches:
            for stripe, k, m in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True):
                k = np.frombuffer(k, np.uint32).astype(np.int64)
                held.append(((k // width * STRIPES + stripe) * width + k % width, np.frombuffer(m, np.uint32).astype(np.int64)))
            if sum(len(h[0]) for h in held) > 1 << 21:
                settle()
                if len(keys) > 1 << 22:
                    yield from send()
        settle()
        yield from send()

    return run


def _by(batches, columns: int) -> Iterator[tuple]:
    """Rows of batches as tuples, one after the other; binary columns stay bytes."""
    for rb in batches:
        yield from zip(*(rb.column(i).to_pylist() for i in range(columns)), strict=True)


def _count(width: int, n_b: int):
    """Dense matrices of blocks that come sorted: (stripe, keys, counts, best), one row for each block."""
    rows_of = -(-n_b // BLOCKS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        dense, now = np.zeros(rows_of * width, np.int64), None

        def send():
            at = np.flatnonzero(dense)
            n = dense[at]
            best = n == dense.reshape(rows_of, width).max(axis=1)[at // width]
            dense[at] = 0
            side = at // width * BLOCKS + now
            key = (side // STRIPES * width + at % width).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([now % STRIPES], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (key, n, best))], ["stripe", "keys", "counts", "best"])

        for block, keys, counts in _by(batches, 3):
            if block != now:
                if now is not None:
                    yield send()
                now = block
            np.add.at(dense, np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int64))
        if now is not None:
            yield send()

    return run


def _score(batches) -> Iterator[pa.RecordBatch]:
    """Sums of a lot's links in a stripe, by document; a cell's counts come before its links."""
    now, parts, table, out = None, [], None, []

    def send():
        c = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], ["lot", "docs", "n_best", "count_sum"])

    for stripe, salt, lot, docs, keys, n, best in _by(batches, 7):
        if (stripe, salt) != now:
            now, parts, table = (stripe, salt), [], None
        if lot is None:
            parts.append((np.frombuffer(keys, np.uint32), np.frombuffer(n, np.int64), np.frombuffer(best, bool)))
            continue
        if table is None:
            table = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(table[0])
            table = [x[order] for x in table]
        docs, mult = np.frombuffer(docs, np.uint16), np.frombuffer(n, np.uint32).astype(np.int64)
        at = np.searchsorted(table[0], np.frombuffer(keys, np.uint32))
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        out.append((lot, docs[first].tobytes(), np.add.reduceat(mult * table[2][at], first).tobytes(), np.add.reduceat(mult * table[1][at], first).tobytes()))
        if len(out) == 256:
            yield send()
            out.clear()
    if out:
        yield send()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """Adds the stripes' sums of a lot to its documents."""
    head, best, total = None, None, None

    def send():
        doc_id, n_a, n_b, links, sha = head
        cols = [doc_id, n_a, n_b, links, links, best, total]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(sha, pa.string())], [c.split(" ")[0] for c in _RESULT.split(", ")])

    for _lot, _kind, docs, n_best, count_sum, *header in _by(batches, 10):
        if docs is None:
            if head is not None:
                yield send()
            head, best, total = header, np.zeros(len(header[0]), np.int64), np.zeros(len(header[0]), np.int64)
        else:
            at = np.frombuffer(docs, np.uint16)
            best[at] += np.frombuffer(n_best, np.int64)
            total[at] += np.frombuffer(count_sum, np.int64)
    if head is not None:
        yield send()


def _counted(links: DataFrame, width: int, n_b: int) -> DataFrame:
    """(stripe, keys, counts, best) of staged links."""
    sums = links.select("stripe", "keys", "mult").mapInArrow(lean(_presum(width)), "block int, keys binary, counts binary")
    return sums.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_count(width, n_b)), "stripe int, keys binary, counts binary, best binary")


def _staged(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(own.mapInArrow(lean(_encode(path_a, path_b)), _ENCODED), "alignment")


def pair_counts(docs: DataFrame, path_a: str = SIDE_A, path_b: str = SIDE_B) -> DataFrame:
    """(b_id, a_id, count, best): how many links of the corpus hold each pair, and whether that is its B id's highest."""
    width, n_b = len(byte_side(path_a).raw), len(piece_side(path_b).raw)

    def run(batches):
        for stripe, keys, counts, best in _by(batches, 4):
            k = np.frombuffer(keys, np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k // width * STRIPES + stripe), pa.array(k % width), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(best, bool))], ["b_id", "a_id", "count", "best"])

    return _counted(_staged(docs, path_a, path_b).filter("stripe >= 0"), width, n_b).mapInArrow(run, "b_id long, a_id long, count long, best boolean")


def align_tokenizers(docs: DataFrame, path_a: str = SIDE_A, path_b: str = SIDE_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each document."""
    width, n_b = len(byte_side(path_a).raw), len(piece_side(path_b).raw)
    encoded = _staged(docs, path_a, path_b)
    links = encoded.filter("stripe >= 0").select("lot", "stripe", "n", "docs", "keys", "mult")
    sizes = {r["stripe"]: r["n"] for r in links.groupBy("stripe").agg(F.sum("n").alias("n")).collect()}  # 32 rows
    most = max(1, min(sum(sizes.values()) / (2 * STRIPES), CELL))
    cells = F.element_at(F.array(*[F.lit(max(1, math.ceil(sizes.get(s, 0) / most))) for s in range(STRIPES)]), F.col("stripe") + 1)
    counted = _counted(links, width, n_b).withColumn("salt", F.explode(F.sequence(F.lit(0), cells - 1)))
    nothing = F.lit(None)
    table = counted.select("stripe", "salt", nothing.cast("long").alias("lot"), nothing.cast("binary").alias("docs"), "keys", F.col("counts").alias("n"), "best")
    told = links.select("stripe", F.pmod(F.hash("lot"), cells).cast("int").alias("salt"), "lot", "docs", "keys", F.col("mult").alias("n"), nothing.cast("binary").alias("best"))
    cell = table.unionByName(told).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("lot").isNotNull())
    sums = cell.mapInArrow(lean(_score), "lot long, docs binary, n_best binary, count_sum binary")
    header = ["doc_id", "n_a", "n_b", "n_links", "sha"]
    heads = encoded.filter("stripe < 0").select("lot", F.lit(0).alias("kind"), *[nothing.cast("binary").alias(c) for c in ("docs", "n_best", "count_sum")], *header)
    kinds = dict(encoded.dtypes)
    rest = sums.select("lot", F.lit(1).alias("kind"), "docs", "n_best", "count_sum", *[nothing.cast(kinds[c]).alias(c) for c in header])
    return heads.unionByName(rest).repartition("lot").sortWithinPartitions("lot", "kind").mapInArrow(lean(_merge), _RESULT)
