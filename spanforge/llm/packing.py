"""Best-fit packing of token sequences with bounded space.

A fixed number of bins is open at a time, kept in a bitset keyed by free space: the
lowest set bit from a piece's length on is the fullest open bin that takes it. Where
none does, a new bin opens; beyond the fixed number the fullest open bin closes first.

Texts are encoded where they lie. Their pieces, narrow rows of numbers, are then dealt
evenly to as many tasks as their tokens need (``TASK_TOKENS`` each), however the input is
split; every task packs its pieces in one pass, in an order that their ids' checksums fix,
in memory that does not grow with them. Sequence ids carry the task. Only the bins open at
a task's end stay part-filled: with some thousands of sequences a task, and 1024 open bins,
about one in a hundred more than the least, as in one task for all.

Cases: a null or empty text is one end id; a text that is longer than a sequence is cut
into pieces, the remainder first, so that all later pieces fill a sequence each;
repeated rows are packed once each; a null ``doc_id`` stays null, and one of any type keeps
it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import kernels as K
from spanforge.llm.tokenize import END_ID, default_path, encoder

TASK_TOKENS = 4 << 20
#: Columns of a piece beside its ``doc_id``, which keeps its own type; and its place.
PIECES = "piece int, start long, length long, ids_crc32 long"
PLACE = "sequence_id long, offset long"


class BestFit:
    """Bounded-space online best-fit. ``place`` gives a bin number and the place in it."""

    def __init__(self, capacity: int, open_bins: int = 1024):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.by_free, self.n_open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            self.by_free[left].append(number)
            self.mask |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole if it fits, else the remainder and then full ones."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(i, capacity) for i in range(head, n, capacity)]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, open_bins: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, ``doc_id`` and as ``PIECES`` and ``PLACE``: which ids of which document lie where in which sequence."""
    K.set_batches(docs.sparkSession)
    path, schema = tokenizer or default_path(), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {PIECES}"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for r, ids, _ in enc.texts(batch.column(1)):
                ids = np.append(ids, np.uint32(END_ID))
                for k, (start, length) in enumerate(pieces(len(ids), capacity)):
                    rows.append((r, k, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())))
            of, *columns = list(zip(*rows, strict=True)) or [()] * 5
            numbers = [pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(columns)]
            K.release_large()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            columns = [[base + number for number, _ in placed], [offset for _, offset in placed]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, "sequence_id", "offset"])

    found = K.saved(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(cut, schema), "pieces")
    tasks = max(1, (found.agg(F.sum("length")).first()[0] or 0) // TASK_TOKENS)
    dealt = (found.repartition(tasks) if tasks > 1 else found.coalesce(1)).sortWithinPartitions("ids_crc32", "doc_id", "piece")
    return dealt.mapInArrow(place, f"{schema}, {PLACE}")
