"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its ASCII-lower-cased words and their beginnings of 4 and 6 bytes
(for inflected and compounded languages), hashed into a fixed number of buckets; a text
is the set of its buckets. The score is the logistic function of

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the buckets present, so that two terms which are harmless apart (an insult, the
mention of a group) can weigh together. The pair sum is computed in time linear in the
number of terms.

Training takes labelled rows up to ``max_rows`` a class (a documented bound, those of
least hash; weights restore the class shares), counts each bucket's documents by class
on the executors, keeps the ``max_terms`` buckets most associated with the label, and
fits by stochastic gradient descent on the driver over those buckets alone: at most
``2 * max_rows`` short rows. A bucket below the bounds (``least`` documents, a deviation of 4,
the ``max_terms`` strongest) has no weight of its own: rare words tell nothing either way. Text is read in place: the bounded label sample is
broadcast, texts are never shuffled. Scoring is one pass over all texts.

Cases: a null or empty text has no terms and gets the score of the intercept; labels
with nulls are ignored, of several labels of one document the highest counts; without
labels, or with labels of one class only, the score is that share (0 without labels);
repeated rows are scored once each; an empty table gives no rows; other columns pass
through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import kernels as K

BUCKET_BITS = 20
BEGINNINGS = (4, 6)


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each term, its row from the first) for blocks of texts."""
    K.drop_caches()
    shift = np.uint64(64 - BUCKET_BITS)
    for i, j, buf, offsets in K.blocks(column):
        buf = K.LOWER[buf]
        starts, ends, first = K.words(buf, offsets, K.ALNUM)
        rows = np.repeat(np.arange(j - i), np.diff(first))
        found, whose = [K.hash_ranges(buf, starts, ends)], [rows]
        for n in BEGINNINGS:
            long = np.flatnonzero(ends - starts > n)
            found.append(K.mix(K.hash_ranges(buf, starts[long], starts[long] + n) + np.uint64(n)))
            whose.append(rows[long])
        yield i, j, (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(whose)
    K.release_large()


@dataclass
class Model:
    """A fitted machine: bucket numbers (sorted), intercept, weights and factors."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.place = np.full(1 << BUCKET_BITS, -1, np.int16 if len(self.buckets) < 2**15 else np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets))

    def present(self, buckets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, kept term) pairs, by row."""
        at = self.place[buckets]
        hit = np.flatnonzero(at >= 0)
        pairs = np.unique(rows[hit] * len(self.buckets) + at[hit]) if len(hit) else np.zeros(0, np.int64)
        return pairs // max(1, len(self.buckets)), pairs % max(1, len(self.buckets))

    def score(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` rows from their pairs."""
        z = self.w0 + np.bincount(rows, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            z += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: np.ndarray, at: np.ndarray, labels: np.ndarray, weights: np.ndarray, buckets: np.ndarray, *, factors: int = 4, epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fit by Adagrad over minibatches of documents; ``rows`` sorted."""
    n, m, rng = len(labels), len(buckets), np.random.default_rng(seed)
    share = float(np.average(labels, weights=weights))
    w0, w, v = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(m), rng.normal(0, 0.05, (m, factors))
    g0, gw, gv = 1e-8, np.full(m, 1e-8), np.full((m, factors), 1e-8)
    first = np.searchsorted(rows, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 512):
            batch = order[k : k + 512]
            count = first[batch + 1] - first[batch]
            take = np.arange(count.sum()) + np.repeat(first[batch] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            whose, i = np.repeat(np.arange(len(batch)), count), at[take]
            sums = np.stack([np.bincount(whose, v[i, f], len(batch)) for f in range(factors)], 1)
            squares = np.bincount(whose, (v[i] ** 2).sum(1), len(batch))
            z = w0 + np.bincount(whose, w[i], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[batch]) * weights[batch] / 8
            d0, d = e.sum(), np.bincount(i, e[whose], m) + decay * w
            dv = np.stack([np.bincount(i, e[whose] * (sums[whose, f] - v[i, f]), m) for f in range(factors)], 1) + decay * v
            g0, gw, gv = g0 + d0**2, gw + d**2, gv + dv**2
            w0 -= rate * d0 / np.sqrt(g0)
            w -= rate * d / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Model(buckets, w0, w, v)


def _labelled(labels: DataFrame, id_col: str, label_col: str, train_only: bool, max_rows: int) -> DataFrame:
    one = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    if train_only:
        one = one.where(~held_out("_id"))
    parts = [one.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), one


def held_out(column: str):
    """True for documents that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_terms: int = 4096, least: int = 3, hold_out: bool = True, **options) -> Model:
    """Train on the labelled documents (without those held out)."""
    spark = docs.sparkSession
    K.set_batches(spark)
    sample, every = _labelled(labels, id_col, label_col, hold_out, max_rows)
    shares = {r["_y"]: r["n"] for r in every.groupBy("_y").agg(F.count("*").alias("n")).collect() if r["_y"] in (0, 1)}
    nothing = np.zeros(0, np.int64)
    total = sum(shares.values())
    if len(shares) < 2:
        share = sum(y * n for y, n in shares.items()) / max(1, total)
        return Model(nothing, float(np.log(share / (1 - share))) if 0 < share < 1 else 35.0 * (2 * share - 1), np.zeros(0), np.zeros((0, 1)))
    known = K.saved(sample, "sample")  # at most 2 * max_rows short rows
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(known), "_id")
    # of rows that share a labelled id the least text is learnt from: one row an id, whatever their number
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for i, j, buckets, rows in terms(batch.column(0)):
                pairs = np.unique(rows << BUCKET_BITS | buckets)
                for c in (0, 1):
                    np.add.at(n[c], (pairs & ((1 << BUCKET_BITS) - 1))[y[i:j][pairs >> BUCKET_BITS] == c], 1)
        some = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]).cast(pa.int64()), pa.array(n[1, some]).cast(pa.int64())], ["bucket", "n0", "n1"])

    by_bucket = texts.select("_text", "_y").mapInArrow(counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sizes = {0: 0.0, 1: 0.0} | {r["_y"]: float(r["n"]) for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # the signed root of the chi-square of bucket and label; a rare bucket is no evidence
    p = (F.col("n0") + F.col("n1")) / F.lit(sizes[0] + sizes[1])
    z = (F.col("n1") / sizes[1] - F.col("n0") / sizes[0]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * F.lit(1 / sizes[0] + 1 / sizes[1]))
    best = by_bucket.where(F.col("n0") + F.col("n1") >= least).withColumn("z", F.abs(z)).where("z > 4").orderBy(F.desc("z"), "bucket").limit(max_terms).collect()
    buckets = np.array(sorted(r["bucket"] for r in best), np.int64)
    model = Model(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))
    shared = spark.sparkContext.broadcast(model)

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b""] * batch.num_rows
            for i, j, b, rows in terms(batch.column(0)):
                r, at = shared.value.present(b, rows)
                edge = np.searchsorted(r, np.arange(j - i + 1))
                for d in range(j - i):
                    found[i + d] = at[edge[d] : edge[d + 1]].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["_id", "_y", "at"])

    id_type = labels.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_y", T.IntegerType()), T.StructField("at", T.BinaryType())])
    got = sorted(((r["_id"], r["_y"], bytes(r["at"])) for r in texts.select("_text", "_id", "_y").mapInArrow(extracted, schema).collect()), key=lambda r: (r[0], r[1], r[2]))
    y = np.array([r[1] for r in got], float)
    counts = np.array([len(r[2]) // 4 for r in got], np.int64)
    at = np.frombuffer(b"".join(r[2] for r in got), "<i4").astype(np.int64)
    del got
    # class weights: the classes' shares among all labelled rows, softened so that the rarer class is learnt
    weight = {c: np.sqrt(shares[1 - c] / shares[c]) ** 0.5 for c in (0, 1)}
    weights = np.where(y == 1, weight[1] * shares[1] / max(1, (y == 1).sum()), weight[0] * shares[0] / max(1, (y == 0).sum()))
    model = train(np.repeat(np.arange(len(y)), counts), at, y, weights / weights.mean(), buckets, **options)
    K.release_large()
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (all columns, or those in ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    spark = docs.sparkSession
    K.set_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(model)
    inner = docs.select(docs[text_col].cast("string").alias(K.free_name(keep, "_text")), *keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, buckets, rows in terms(batch.column(0)):
                out.append(shared.value.score(*shared.value.present(buckets, rows), j - i))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *out]))], names=[*keep, "score"])

    schema = T.StructType([*inner.schema.fields[1:], T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
