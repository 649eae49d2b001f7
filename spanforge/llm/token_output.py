"""Fixed-width binary output of token ids.

File format (little-endian), one file per task, made to be read by ranges::

    magic  b"FWTOKENS"
    blocks  ``block_ids`` ids each (a multiple of 64), ``bits`` bits an id, packed
            into 64-bit words from the low bit up; the last block is padded with zeros
    index   int64 document ids, uint8 null marks, uint64 first id of each document and
            the total, uint64 byte offset of each block and the end
    footer  uint64 documents, uint64 ids, uint32 bits, uint32 block_ids, uint64 index
            offset, magic

``bits`` is the least width that holds the vocabulary. 64 ids take exactly ``bits``
words, so packing and unpacking are ``64`` vectorised numpy steps, and any id range is
read from the blocks that hold it.

Documents go to files by ranges of (doc_id, hash of text), so that files ascend in
doc_id and many rows of one doc_id still spread. A task writes under a name of its own
attempt and returns it; what the job's committed manifest does not name is never read,
so lost executors and repeated or speculative tasks leave the result whole.

Cases: a null or empty text has the end id alone; repeated rows appear once each; a
null ``doc_id`` sorts first and stays null; an id that is no whole number is an error, as
the format holds 64-bit ids, and so is a token id beyond the vocabulary; an empty table
writes no ids; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import kernels as K
from spanforge.llm.tokenize import END_ID, default_path, encoder, vocabulary_of

MAGIC = b"FWTOKENS"
FOOTER = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("bits", "<u4"), ("block_ids", "<u4"), ("index", "<u8"), ("magic", "S8")])
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The least number of bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, padded with zeros to a multiple of 64, as packed 64-bit words."""
    n = -(-len(ids) // 64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} takes more than {bits} bits")
    rows = np.zeros((n, 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, bits + 1), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:, :bits]).astype("<u8").tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:count]


class Writer:
    """Streams ids to one file; holds one block and the index."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids % 64:
            raise ValueError("block_ids must be a multiple of 64")
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.names, self.firsts, self.blocks, self.total = [], [], [], 0
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        sink.write(MAGIC)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.names.append(name)
        self.firsts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 4 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(held) if last else len(held) // self.block_ids * self.block_ids
        for i in range(0, end, self.block_ids):
            raw = pack_bits(held[i : min(end, i + self.block_ids)], self.bits)
            self.sink.write(raw)
            self.blocks.append(self.at)
            self.at += len(raw)
        self.held, self.n_held = [held[end:]], len(held) - end

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([x is None for x in self.names], np.uint8)
        index = np.array([x or 0 for x in self.names], "<i8").tobytes() + nulls.tobytes() + np.array([*self.firsts, self.total], "<u8").tobytes() + np.array([*self.blocks, self.at], "<u8").tobytes()
        self.sink.write(index + np.array((len(self.names), self.total, self.bits, self.block_ids, self.at, MAGIC), FOOTER).tobytes())


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.foot = np.frombuffer(source.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if self.foot["magic"] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        n, at = int(self.foot["docs"]), int(self.foot["index"])
        raw = source.read_at(size - FOOTER.itemsize - at, at)
        names, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.names = [None if z else x for x, z in zip(names.tolist(), nulls.tolist(), strict=True)]
        rest = np.frombuffer(raw[9 * n :], "<u8").astype(np.int64)
        self.firsts, self.blocks = rest[: n + 1], rest[n + 1 :]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end``, reading only the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        size, bits = int(self.foot["block_ids"]), int(self.foot["bits"])
        a, b = begin // size, -(-end // size)
        raw = self.source.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        return unpack_bits(raw, bits, end - a * size)[begin - a * size :]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of all documents, some blocks in memory at a time."""
        i, n, size = 0, len(self.names), int(self.foot["block_ids"])
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + 4 * size, "right")) - 1)
            held = self.ids(int(self.firsts[i]), int(self.firsts[j]))
            for k in range(i, j):
                yield self.names[k], int(self.firsts[k]), held[self.firsts[k] - self.firsts[i] : self.firsts[k + 1] - self.firsts[i]]
            i = j


def write(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, vocabulary: int | None = None, folder: str | None = None, block_ids: int = BLOCK_IDS, write_id: str | None = None) -> DataFrame:
    """Write all ids and return the manifest: ``part, path, docs, ids`` of each file, in ascending doc_id order by part.

    ``vocabulary`` is the number of ids, by default the tokenizer's. Files are named after ``write_id``, by default a new one;
    what lost attempts of a write of this id have left in the folder goes, files of other writes stay.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a whole number")
    K.set_batches(spark)
    path, folder = tokenizer or default_path(), folder or K.fresh(spark, "tokens")
    bits, own = bits_for(vocabulary or vocabulary_of(path)), write_id or uuid.uuid4().hex
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # the shuffle's partitions are numbered in doc_id order
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = K.filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, enc = f"part-{part:06d}-{own}-{uuid.uuid4().hex}.fwt", encoder(path)
        with fs.open_output_stream(f"{base}/{name}") as sink:
            out = Writer(sink, bits, block_ids)
            for batch in batches:
                names = batch.column(0).to_pylist()
                for r, ids, _ in enc.texts(batch.column(1)):
                    out.add(names[r], np.append(ids, np.uint32(END_ID)))
            out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "docs": [len(out.names)], "ids": [out.total]})

    manifest = K.saved(rows.mapInArrow(run, "part int, path string, docs long, ids long"), "manifest")
    fs, base = K.filesystem(folder)
    named = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()}
    for info in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)):
        if f"-{own}-" in info.base_name and info.base_name not in named:
            fs.delete_file(info.path)
    return manifest


def read(manifest: DataFrame) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all documents before it.

    The manifest has one short row a file (as many as the writing job had tasks) and is
    summed on the driver; each file is read by a task of its own.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for x in sorted(manifest.collect(), key=lambda x: x["part"]):
        if x["docs"]:
            files.append((x["path"], start))
        start += x["ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = K.filesystem(path)
                with fs.open_input_file(at) as source:
                    rows = []
                    for name, begin, ids in Reader(source).documents():
                        rows.append((name, first + begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "path string, first long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
