"""Vectorised byte kernels shared by the free-style operators.

Each kernel works on a block of documents laid out as one contiguous byte buffer
with offsets (exactly Arrow's string layout), so a word costs a few numpy
element operations rather than Python objects. Blocks are bounded by bytes, not by
rows, so a batch of very long texts needs no more memory than one of short texts;
only a single document longer than a block makes a larger one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_rng.integers(1, 2**62)) * 8 + 5) % 2**64
_BASE_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _separators(*codes: int) -> np.ndarray:
    lut = np.ones(256, np.uint8)
    lut[list(codes)] = 0
    return lut


#: 1 where a byte belongs to a word of ``[^\x20\x09-\x0D]+``.
WHITE = _separators(0x20, *range(0x09, 0x0E))
#: 1 where a byte belongs to a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
ALNUM = _separators(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))

_powers: dict[str, np.ndarray] = {}
#: What modules keep in a worker from task to task; each adds its own.
caches: list[dict] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get("n", 0)
    if have < n:
        size = max(1, -(-(n - 4096) // BLOCK_BYTES)) * BLOCK_BYTES + 4096
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def release_large(give_back: bool = True) -> None:
    """Drop power tables that one very long document made large, and give freed memory back: workers live on after a task."""
    if _powers.get("n", 0) > 2 * BLOCK_BYTES + 8192:
        _powers.clear()
    if give_back:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def drop_caches() -> None:
    """Drop what tasks of other work left in this worker, as it lives on into later stages and they need its memory."""
    if any(caches):
        for held in caches:
            held.clear()
        release_large()


def _trimmer():
    """The C library's call that returns freed memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


_trim = _trimmer()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that high and low bits are usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo if len(column) else np.zeros(1, np.int64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of documents of at most ``limit`` bytes."""
    buf, offsets = layout(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each document's first word (with the total at the end)."""
    w = lut[buf]
    n = len(w)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = w[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = 0
    starts = np.flatnonzero(w > before)
    after = np.empty(n, np.uint8)
    after[-1] = 0
    after[:-1] = w[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = 0
    ends = np.flatnonzero(w > after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by prefix sums of a random-table polynomial."""
    up, down = _pow(len(buf) + 1)
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTE[buf] * down[: len(buf)], out=s[1:])
    return mix((s[ends] - s[starts]) * up[starts])


def hash_windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive items within each document.

    ``h``: an item's hash; ``first``: each document's first item, and the total.
    Returns the hashes, and the window count before each document (with the total).
    A document of fewer than k items, but not none, has its whole sequence as one window.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    total = int(before[-1])
    begin = np.arange(total) - np.repeat(before[:-1] - first[:-1], count)
    end = begin + np.repeat(np.minimum(n, k), count)
    up, down = _pow(len(h) + 1)
    s = np.empty(len(h) + 1, np.uint64)
    s[0] = 0
    np.cumsum(h * down[: len(h)], out=s[1:])
    return mix((s[end] - s[begin]) * up[begin] + np.uint64(k)), before


def free_name(columns, wanted: str) -> str:
    """A column name like ``wanted`` that is not among the columns (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def set_batches(spark, rows: int = 1024) -> None:
    """Keep Arrow batches small, so that batches of very long texts fit in memory.

    Sizes are bounded in bytes where this Spark version can, and in rows always.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        return


def shared_dir(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, one is made and set if all of Spark runs in this process; on a cluster that is an error,
    as a machine's own folder would hold only its part of a table.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark, name: str) -> str:
    """A new path below the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df, name: str):
    """Write ``df`` as a table in the shared folder and return it as read from there, which cuts its lineage."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The tables that one job writes in the shared folder, so that those can go which its result does not read."""

    def __init__(self, spark):
        self.spark, self.held = spark, []

    def save(self, df, name: str):
        """As ``saved``."""
        path = fresh(self.spark, name)
        df.write.parquet(path)
        self.held.append((out := self.spark.read.schema(df.schema).parquet(path), path))
        return out

    def drop_all_but(self, *kept) -> None:
        """Delete all tables but these, once nothing that is yet to be read is made from them."""
        for df, path in self.held:
            if not any(df is k for k in kept):
                delete(self.spark, path)
        self.held = [(df, path) for df, path in self.held if any(df is k for k in kept)]


def delete(spark, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Schemes as Spark writes them, and those that pyarrow knows the same stores by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def filesystem(uri: str):
    """A pyarrow file system and the path within it; a bare path is local."""
    from pyarrow import fs

    scheme, split, rest = uri.partition("://")
    if not split:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
