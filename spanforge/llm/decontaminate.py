"""Benchmark decontamination with a broadcast hash set of test n-grams.

A benchmark item's words are cut into windows of ``n`` consecutive words (an item of
fewer, but not none, is one window). Their hashes form a sorted table with a bit map in
front; a task hashes all word windows of its documents in vectorised steps, looks each
up, and compares the words of every hit with the item's, so a hash collision is no hit.
A word inside any occurrence of a window is hit.

The table (sorted hashes, and places in one buffer of the items' words) is broadcast only
up to ``max_bytes``, reckoned by the most that the texts could take; a larger benchmark is
dealt into groups of that size by whole items, and documents are scanned once a group, with
hits carried along.

Cases: a null text has no words; a benchmark item without words occurs nowhere; equal
items all count; repeated rows are scanned once each; an empty table gives no rows, an
empty benchmark no hits; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import kernels as K

RESULT = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<begin:bigint,end:bigint>>"}


class Grams:
    """The windows of benchmark items as sorted arrays: for each window length the hashes, and each one's item and byte
    range in one buffer of all items' words. A window takes 28 bytes beside its words."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = 10):
        self.n, self.names, texts, at = n, [], [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for name, text in items:
            buf, offsets = K.layout(pa.array([text or ""], pa.large_string()))
            buf = K.LOWER[buf]
            starts, ends, first = K.words(buf, offsets, K.ALNUM)
            if not len(starts):
                continue
            k = min(n, len(starts))
            hashes, _ = K.hash_windows(K.hash_ranges(buf, starts, ends), first, k)
            raw = buf.tobytes()
            texts.append(b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
            end = at + np.cumsum(ends - starts) + np.arange(len(starts))
            begin = end - (ends - starts)
            found.setdefault(k, []).append((hashes, np.full(len(hashes), len(self.names), np.int32), begin[: len(hashes)], end[k - 1 :]))
            self.names.append(str(name))
            at += len(texts[-1])
        self.text = b"".join(texts)
        self.of = {}
        for k, parts in found.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.of[k] = [c[order] for c in columns]
        self.shift = {k: np.uint64(64 - min(28, max(12, (8 * len(t[0])).bit_length()))) for k, t in self.of.items()}
        self.map = {}
        for k, t in self.of.items():
            self.map[k] = np.zeros(1 << int(64 - self.shift[k]), bool)
            self.map[k][(t[0] >> self.shift[k]).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        """What is broadcast."""
        return len(self.text) + sum(c.nbytes for t in self.of.values() for c in t) + sum(m.nbytes for m in self.map.values()) + 64 * len(self.names)

    def _items(self, k: int, h: int, key: bytes) -> frozenset[str]:
        """The items that hold this very window."""
        hashes, item, begin, end = self.of[k]
        a, b = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
        return frozenset(self.names[i] for i, x, y in zip(item[a:b].tolist(), begin[a:b].tolist(), end[a:b].tolist(), strict=True) if self.text[x:y] == key)

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, set[str]]], tuple]:
        """Words of each document, and (document, hit marks by word, items) of those with hits; and the words' places."""
        buf = K.LOWER[buf]
        starts, ends, first = K.words(buf, offsets, K.ALNUM)
        counts, found = np.diff(first), {}
        if len(starts) and self.of:
            h, raw = K.hash_ranges(buf, starts, ends), None
            for k, (table, *_) in self.of.items():
                w, before = K.hash_windows(h, first, k)
                maybe = np.flatnonzero(self.map[k][(w >> self.shift[k]).astype(np.int64)])
                at = np.searchsorted(table, w[maybe])
                maybe = maybe[table[np.minimum(at, len(table) - 1)] == w[maybe]]
                if not len(maybe):
                    continue
                raw, known = raw or buf.tobytes(), {}
                docs = np.searchsorted(before, maybe, "right") - 1
                for g, d in zip(maybe.tolist(), docs.tolist(), strict=True):
                    at = int(first[d] + g - before[d])
                    if counts[d] < k:
                        continue
                    key = b" ".join([raw[a:b] for a, b in zip(starts[at : at + k].tolist(), ends[at : at + k].tolist(), strict=True)])
                    if key not in known:
                        known[key] = self._items(k, int(w[g]), key)
                    if names := known[key]:
                        marks, items = found.setdefault(d, (np.zeros(counts[d] + 1, np.int32), set()))
                        marks[at - first[d]] += 1
                        marks[at - first[d] + k] -= 1
                        items |= names
        return counts, [(d, np.cumsum(m)[:-1] > 0, i) for d, (m, i) in sorted(found.items())], (starts, ends, first)


#: At most so many bytes of a table for each byte of items: a word of one letter and its space give 28 bytes and two of the
#: buffer, and the bit map 16 bytes at most for each window.
TABLE_BYTES = 23


def _groups(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in groups whose tables take about ``max_bytes`` at most (or of one item), read one group at a time."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[text_col].cast("string").alias("t"))
    total = rows.agg(F.sum(TABLE_BYTES * F.octet_length("t") + 64).alias("n")).first()["n"] or 0
    n = -(-total // max_bytes) or 1
    for g in range(n):
        yield [tuple(x) for x in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == g)).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_bytes: int = 128 << 20, with_spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The documents (all columns, or those in ``keep``) with ``n_words``, ``n_hit``, ``items`` (those with an occurring
    window, sorted) and ``spans`` (byte ranges of the hit words in the UTF-8 text; empty unless ``with_spans``)."""
    spark = docs.sparkSession
    K.set_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    marked_col = K.free_name([*keep, text_col, *RESULT], "_marks")
    out = docs.select(*keep, *([] if text_col in keep else [text_col]), F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("binary").alias(marked_col), F.array().cast("array<string>").alias("items"))
    columns = out.columns
    schema = T.StructType([*out.schema.fields[:-3], T.StructField("n_words", T.LongType()), T.StructField(marked_col, T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    place = columns.index(text_col)

    def marked(broadcast):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            K.drop_caches()
            grams = broadcast.value
            for batch in batches:
                n_words, marks, items = [], batch.column(len(columns) - 2).to_pylist(), batch.column(len(columns) - 1).to_pylist()
                for i, _, buf, offsets in K.blocks(batch.column(place)):
                    counts, found, _ = grams.block(buf, offsets)
                    n_words += counts.tolist()
                    for d, hit, names in found:
                        before = marks[i + d]
                        if before is not None:
                            hit = hit | np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)).astype(bool)
                        marks[i + d] = np.packbits(hit).tobytes()
                        items[i + d] = sorted(names | set(items[i + d]))
                K.release_large()
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) - 3], pa.array(n_words, pa.int64()), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=columns)

        return run

    for g, items in enumerate(_groups(benchmark, item_col, item_text_col, max_bytes)):
        if g:
            out = K.saved(out, "scanned")
        out = out.mapInArrow(marked(spark.sparkContext.broadcast(Grams(items, n))), schema)

    def located(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for i, j, buf, offsets in K.blocks(batch.column(place)):
                marks = batch.column(len(columns) - 2).slice(i, j - i).to_pylist()
                starts = None
                for d in range(j - i):
                    if marks[d] is None:
                        spans.append([])
                        continue
                    if starts is None:
                        starts, ends, first = K.words(K.LOWER[buf], offsets, K.ALNUM)
                    hit = np.unpackbits(np.frombuffer(marks[d], np.uint8), count=int(first[d + 1] - first[d]))
                    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    a, b = np.flatnonzero(edge == 1) + first[d], np.flatnonzero(edge == -1) + first[d] - 1
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(starts[a] - offsets[d], ends[b] - offsets[d], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=[*columns, "spans"])

    if with_spans:
        out = out.mapInArrow(located, T.StructType([*schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]))
    else:
        out = out.withColumn("spans", F.array().cast(RESULT["spans"]))
    return out.withColumn("n_hit", F.coalesce(_ones(marked_col), F.lit(0)).cast("bigint")).select(*keep, *RESULT)


def _ones(column: str):
    """The number of one bits of a binary column."""
    digits = F.hex(column)
    total = None
    for weight, some in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        part = F.length(F.regexp_replace(digits, f"[^{some}]", "")) * weight
        total = part if total is None else total + part
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """The documents, their own columns, without contaminated ones (``mode="document"``) or with every run of hit words
    taken out of the text (``mode="span"``)."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode {mode!r} is neither 'document' nor 'span'")
    hits = {c: f"_own_{c}" for c in docs.columns if c in RESULT}
    found = scan(docs.withColumnsRenamed(hits), benchmark, text_col=hits.get(text_col, text_col), with_spans=mode == "span", **options)
    names = [F.col(hits.get(c, c)).alias(c) for c in docs.columns]
    if mode == "document":
        return found.where("n_hit = 0").select(*names)
    raw, held = F.encode(F.col(hits.get(text_col, text_col)), "UTF-8"), F.col("spans")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(held, lambda s: s["end"]))
    ends = F.concat(F.transform(held, lambda s: s["begin"]), F.array(F.octet_length(raw).cast("bigint")))
    cut = F.aggregate(F.arrays_zip(begins.alias("a"), ends.alias("b")), F.encode(F.lit(""), "UTF-8"), lambda acc, s: F.concat(acc, F.substring(raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
    text = F.when(F.size(held) == 0, F.col(hits.get(text_col, text_col))).otherwise(cut.cast("string"))
    return found.withColumn(hits.get(text_col, text_col), text).select(*names)
