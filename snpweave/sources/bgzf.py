"""Block-compressed text (BGZF: ``.vcf.gz`` as bgzip and its kind write it) as a splittable, indexable data source.

A BGZF file is a row of gzip members of at most 64 KB that say their own size, so a reader that starts anywhere finds the
next member by its header.  ``lines`` cuts a file by bytes; a task decompresses the members that begin in its range.
A line belongs to the range that holds the newline before it (the first line to the first range): a task drops what
comes before its first newline, and reads on past its end until its last line is whole.  Nothing is shuffled, and the
driver reads one member of a file at most.

``write_index`` scans a VCF once in the same way and stores a row for each chunk of members and chromosome: its bytes and the
smallest and largest place (with the length of REF).  With an index, filters on CHROM and POS choose the chunks before
any is read; Spark applies the filters to the rows again.  The index may lie anywhere Spark reads, and files need not be sorted.

Ranges are read by Python tasks: by ``open`` where the path is local (or mounted everywhere), else by ``pyarrow.fs``, which
knows the common stores.  Where it does not know one, or a ``.gz`` is not in blocks, ``readers`` reads the text in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MAGIC = b"\x1f\x8b\x08\x04"
#: bytes of a member at most; compressed bytes of a partition, and of a chunk of the index
MEMBER, SPLIT, CHUNK = 1 << 16, 8 << 20, 1 << 18


def _file(path: str):
    """An open file with ``seek`` and ``read``, and its size."""
    local = path.removeprefix("file://") if path.startswith("file:") else path
    local = local.removeprefix("file:")
    if "://" not in local:
        import os

        return open(local, "rb"), os.path.getsize(local)  # noqa: SIM115
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at), store.get_file_info(at).size


def member_size(head: bytes, at: int = 0) -> int:
    """Bytes of the member that begins at ``at``; 0 if none does."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return 0
    extra = struct.unpack_from("<H", head, at + 10)[0]
    k, end = at + 12, min(len(head), at + 12 + extra)
    while k + 4 <= end:
        size = struct.unpack_from("<H", head, k + 2)[0]
        if head[k : k + 2] == b"BC" and size == 2 and k + 6 <= end:
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + size
    return 0


def is_blocked(path: str) -> bool:
    """Whether a file begins with a BGZF member; False where Python cannot read the path."""
    try:
        f, _ = _file(path)
        with f:
            return member_size(f.read(64)) > 0
    except Exception:  # noqa: BLE001  a store that only Spark reads
        return False


def inflate(member: bytes) -> bytes:
    extra = struct.unpack_from("<H", member, 10)[0]
    out = zlib.decompress(member[12 + extra : -8], -15)
    crc, size = struct.unpack_from("<II", member, len(member) - 8)
    if len(out) != size or zlib.crc32(out) != crc:
        raise OSError("a block of the file is damaged")
    return out


class Blocks:
    """Members of a file from a byte on, one after the other; ``read`` counts the bytes that were fetched."""

    def __init__(self, path: str, start: int, sure: bool = False, fetch: int = 1 << 20):
        self.f, self.size = _file(path)
        self.fetch, self.read = fetch, 0
        self.buffer, self.base = b"", start
        self.at = start if sure else self._find(start)

    def _need(self, offset: int, n: int) -> None:
        """Have ``n`` bytes from ``offset`` in the buffer, as far as the file goes."""
        if offset + n <= self.base + len(self.buffer) or self.base + len(self.buffer) >= self.size:
            return
        keep = self.buffer[max(0, offset - self.base) :] if offset < self.base + len(self.buffer) else b""
        self.base = offset
        self.f.seek(offset + len(keep))
        more = self.f.read(max(self.fetch, n - len(keep)))
        self.read += len(more)
        self.buffer = keep + more

    def _find(self, start: int) -> int:
        """The first member at or after ``start``: its magic, its size, and another member (or the end) behind it."""
        at = start
        while at < self.size:
            self._need(at, MEMBER + 64)
            k = self.buffer.find(MAGIC, at - self.base)
            if k < 0:
                at = max(at + 1, self.base + len(self.buffer) - 3)
                continue
            at = self.base + k
            self._need(at, 2 * MEMBER + 64)
            n = member_size(self.buffer, at - self.base)
            if n and (at + n == self.size or member_size(self.buffer, at - self.base + n)):
                return at
            at += 1
        return self.size

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            self._need(self.at, 64)
            n = member_size(self.buffer, self.at - self.base)
            if not n:
                raise OSError(f"no block at byte {self.at}")
            self._need(self.at, n)
            start = self.at
            self.at += n
            yield start, inflate(self.buffer[start - self.base : self.at - self.base])

    def close(self) -> None:
        self.f.close()


def text_of(path: str, lo: int, hi: int, sure: bool = False, most: int = 4 << 20, counter=None) -> Iterator[bytes]:
    """The whole lines of a range of bytes, in pieces of about ``most`` bytes that end with a line."""
    blocks = Blocks(path, lo, sure, min(1 << 20, max(4096, hi - lo)))
    held, size, begun = [], 0, lo == 0
    try:
        for start, data in blocks:
            if blocks.at >= hi:
                blocks.fetch = 1 << 14
            if start >= hi:  # only what ends the last line
                if not begun:
                    break
                cut = data.find(b"\n") + 1
                held.append(data[:cut] if cut else data)
                if cut:
                    break
                continue
            if not begun:
                cut = data.find(b"\n") + 1
                if not cut:
                    continue
                begun, data = True, data[cut:]
            held.append(data)
            size += len(data)
            if size > most and (cut := data.rfind(b"\n") + 1):
                held[-1] = data[:cut]
                yield b"".join(held)
                held, size = [data[cut:]], len(data) - cut
        if rest := b"".join(held):
            yield rest
    finally:
        if counter is not None:
            counter(blocks.read)
        blocks.close()


def to_lines(text: bytes) -> pa.Array:
    """Lines of a text as a column; the newlines (and carriage returns before them) go."""
    if b"\r" in text:
        text = text.replace(b"\r\n", b"\n")
    data = np.frombuffer(text, np.uint8)
    end = np.flatnonzero(data == 10)
    if len(data) and (not len(end) or end[-1] != len(data) - 1):
        end = np.append(end, len(data))
    kept = np.delete(data, end[end < len(data)])
    offsets = np.concatenate([[0], end - np.arange(len(end))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(end), pa.py_buffer(offsets), pa.py_buffer(kept))


def first_fields(text: bytes, n: int) -> bytes:
    """The text with the first ``n`` tab-separated fields of each line."""
    if not text:
        return b""
    data = np.frombuffer(text, np.uint8)
    end = np.flatnonzero(data == 10)
    if not len(end) or end[-1] != len(data) - 1:
        end = np.append(end, len(data))
    start = np.concatenate([[0], end[:-1] + 1])
    tab = np.append(np.flatnonzero(data == 9), len(data))
    cut = np.minimum(tab[np.minimum(np.searchsorted(tab, start) + n - 1, len(tab) - 1)], end)
    return b"".join([text[a:b] + b"\n" for a, b in zip(start.tolist(), cut.tolist(), strict=True)])


def sites(lines: pa.Array) -> tuple[list[str], list[int], list[int]]:
    """CHROM, POS and the last place that REF covers, of VCF lines."""
    chrom, pos, end = [], [], []
    for x in lines.to_pylist():
        f = x.split("\t", 4)
        p = int(f[1]) if len(f) > 3 and f[1].isdigit() else 0
        chrom.append(f[0])
        pos.append(p)
        end.append(p + max(1, len(f[3])) - 1 if len(f) > 3 else p)
    return chrom, pos, end


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int
    sure: bool


class BlockReader(DataSourceReader):
    """Plans ranges of bytes, or with an index the chunks that the filters leave."""

    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.split = int(options.get("split", SPLIT))
        self.chunks = [c.split("\t") for c in options["chunks"].split("\n") if c] if "chunks" in options else None
        self.placed = options.get("placed") == "true"
        self.fields = int(options.get("fields", 0))
        self.chrom: set[str] | None = None
        self.least, self.most, self.read_bytes = None, None, 0

    def pushFilters(self, filters):
        for f in filters:
            at = (getattr(f, "attribute", None) or ("",))[0]
            if at == "CHROM" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chrom = values if self.chrom is None else self.chrom & values
            elif at == "POS" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least or 0, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most = f.value if self.most is None else min(self.most, f.value)
            yield f  # Spark looks at the rows again

    def _wanted(self, chrom: str, first: int, last: int) -> bool:
        return (self.chrom is None or chrom in self.chrom) and (self.least is None or last >= self.least) and (self.most is None or first <= self.most)

    def partitions(self):
        if self.chunks is None:
            out = []
            for p in self.paths:
                f, size = _file(p)
                f.close()
                n = max(1, -(-size // self.split))
                out += [Range(p, size * k // n, size * (k + 1) // n, k == 0) for k in range(n)]
            return out
        ranges = sorted({(p, int(lo), int(hi)) for p, lo, hi, chrom, first, last in self.chunks if self._wanted(chrom, int(first), int(last))})
        out = []
        for p, lo, hi in ranges:  # neighbours are read together
            if out and out[-1].path == p and out[-1].hi == lo and hi - out[-1].lo <= self.split:
                out[-1].hi = hi
            else:
                out.append(Range(p, lo, hi, True))
        return out or [Range("", 0, 0, True)]

    def _count(self, n: int) -> None:
        self.read_bytes += n

    def read(self, partition: Range):
        if not partition.path:
            return
        for text in text_of(partition.path, partition.lo, partition.hi, partition.sure, counter=self._count):
            lines = to_lines(first_fields(text, self.fields) if self.fields else text)
            if not self.placed:
                yield pa.RecordBatch.from_arrays([lines], ["value"])
                continue
            lines = lines.filter(pa.array([not x.startswith("#") and x != "" for x in lines.to_pylist()], pa.bool_()))
            chrom, pos, _ = sites(lines)
            yield pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(pos, pa.int64()), lines], ["CHROM", "POS", "value"])


class BlockText(DataSource):
    """Format ``blocked_text``: ``value``, and with the option ``placed`` also CHROM and POS of VCF lines."""

    @classmethod
    def name(cls) -> str:
        return "blocked_text"

    def schema(self) -> str:
        return "CHROM string, POS long, value string" if self.options.get("placed") == "true" else "value string"

    def reader(self, schema):
        return BlockReader(dict(self.options))


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, which may be a folder: names that do not begin with ``_`` or ``.``, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.getFileStatus(p).isDirectory():
        return [path]
    found = [s.getPath() for s in store.listStatus(p) if s.isFile()]
    return sorted(str(f.toString()) for f in found if f.getName()[:1] not in "_.")


def _source(spark: SparkSession):
    spark.dataSource.register(BlockText)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("blocked_text")


def blocked_files(spark: SparkSession, path: str) -> list[str] | None:
    """The files of a path if all are in blocks and Python can read them, else None."""
    if not path.rstrip("/").lower().endswith((".gz", ".bgz", ".bgzf")) and not any(x.endswith((".gz", ".bgz")) for x in files(spark, path)[:1]):
        return None
    found = files(spark, path)
    return found if found and all(is_blocked(f) for f in found) else None


def head(path: str) -> list[str]:
    """The lines at the beginning of a file that begin with ``#``."""
    out: list[str] = []
    for text in text_of(path, 0, 1 << 62, True, most=MEMBER):
        for x in to_lines(text).to_pylist():
            if not x.startswith("#"):
                return out
            out.append(x)
    return out


def _sized(spark: SparkSession, found: list[str], split: int | None) -> int:
    """Bytes of a partition: ``SPLIT``, or less (64 KB at least) where that would leave cores without work."""
    if split:
        return split
    total = 0
    for p in found:
        f, size = _file(p)
        f.close()
        total += size
    return int(min(SPLIT, max(1 << 16, total // (2 * spark.sparkContext.defaultParallelism))))


def lines(spark: SparkSession, path: str, split: int | None = None, fields: int | None = None) -> DataFrame | None:
    """The lines of block-compressed text (``value``; the first ``fields`` fields, if given), a task for each ``split`` bytes; None if it is of another kind."""
    found = blocked_files(spark, path)
    split = _sized(spark, found, split) if found else None
    return _source(spark).option("paths", "\n".join(found)).option("split", split).option("fields", fields or 0).load() if found else None


def _chunks(size: int):
    """(path, lo, hi, CHROM, first, last) of the chunks of ranges: bytes of members, and the places of their lines."""

    def run(batches):
        for rb in batches:
            rows = []
            for path, lo, hi in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True):
                starts = [s for s, _ in _members(path, lo, hi)]
                edges = starts[:1]
                for s in starts[1:]:
                    if s - edges[-1] >= size:
                        edges.append(s)
                for a, b in zip(edges, [*edges[1:], None], strict=True):
                    seen: dict[str, list[int]] = {}
                    b = b if b is not None else _next(path, hi)
                    for text in text_of(path, a, b, True):
                        keep = to_lines(text)
                        for c, p, e in zip(*sites(keep.filter(pa.array([not x.startswith("#") and x != "" for x in keep.to_pylist()], pa.bool_()))), strict=True):
                            s = seen.setdefault(c, [p, e])
                            s[0], s[1] = min(s[0], p), max(s[1], e)
                    rows += [(path, a, b, c, s[0], s[1]) for c, s in seen.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "lo", "hi", "CHROM", "first", "last"])

    return run


def _members(path: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(start, bytes) of the members that begin in a range, by their headers alone."""
    blocks = Blocks(path, lo)
    try:
        while blocks.at < min(hi, blocks.size):
            blocks._need(blocks.at, MEMBER + 64)
            n = member_size(blocks.buffer, blocks.at - blocks.base)
            if not n:
                raise OSError(f"no block at byte {blocks.at}")
            yield blocks.at, n
            blocks.at += n
    finally:
        blocks.close()


def _next(path: str, at: int) -> int:
    blocks = Blocks(path, at)
    blocks.close()
    return blocks.at


def write_index(spark: SparkSession, path: str, index: str, chunk: int = CHUNK, split: int = SPLIT) -> None:
    """Scan a block-compressed VCF and store where which places are, as Parquet (a row for each chunk and chromosome)."""
    found = blocked_files(spark, path)
    if not found:
        raise ValueError(f"not block-compressed, or not readable by Python tasks: {path}")
    options = {"paths": "\n".join(found), "split": str(split)}
    ranges = [(p.path, p.lo, p.hi) for p in BlockReader(options).partitions()]
    plan = spark.createDataFrame(ranges, "path string, lo long, hi long").repartition(max(1, len(ranges)), "path", "lo")
    plan.mapInArrow(_chunks(chunk), "path string, lo long, hi long, CHROM string, first long, last long").write.mode("overwrite").parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(index)


def has_index(spark: SparkSession, index: str) -> bool:
    """Whether there is a finished index."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def region_lines(spark: SparkSession, path: str, index: str, split: int = SPLIT, chrom: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """CHROM, POS and ``value`` of a VCF's lines, planned by its index.

    Filters on CHROM and POS choose the chunks.  The chunks that a region can touch come to the driver as the plan; with none given
    all do: a row for each 256 KB of compressed text and chromosome.
    """
    rows = read_index(spark, index)
    if chrom is not None:
        rows = rows.filter(F.col("CHROM") == chrom)
    if first is not None:
        rows = rows.filter(F.col("last") >= first)
    if last is not None:
        rows = rows.filter(F.col("first") <= last)
    text = "\n".join("\t".join(map(str, r)) for r in rows.select("path", "lo", "hi", "CHROM", "first", "last").collect())
    x = _source(spark).option("paths", path).option("chunks", text).option("placed", "true").option("split", split).load()
    if chrom is not None:
        x = x.filter(F.col("CHROM") == chrom)
    if first is not None:
        x = x.filter(F.col("POS") >= first)
    if last is not None:
        x = x.filter(F.col("POS") <= last)
    return x


def compress(text: bytes, level: int = 6) -> bytes:
    """Bytes as BGZF members, without the empty one that ends a file."""
    out = []
    for k in range(0, len(text), 0xFF00):
        part = text[k : k + 0xFF00]
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        if len(body) + 26 > MEMBER:  # does not shrink
            c = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = c.compress(part) + c.flush()
        out.append(MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


#: fixed value: the empty member that ends a file
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
