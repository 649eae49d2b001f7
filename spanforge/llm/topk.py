"""Exact top-k search by inner product: vectors by descending length, partial sums in a rotated basis, Cauchy-Schwarz bounds.

The vectors are written once, sorted by length. A rotation from the singular vectors of a bounded sample moves
most of every product into the first coordinates; it decides how soon a pair is given up and never
a result. Queries are a stated set; batches of them, of a fixed size in bytes, are broadcast to tasks that read the
sorted table, in waves: first the longest vectors, then each time about eight times as many. A query's k-th best
so far is its limit for the next wave. A query leaves where its length times the greatest of a
wave can not reach its limit; a pair leaves where the sum over the first coordinates and the product of
what is left of both lengths can not. What stays is multiplied out in whole numbers. A task returns at most k rows a
query, which a window cuts to k of all.

Components are ``floor(scale * x)``, x as double. Vectors that are null, or hold a null or a component that is not
finite (before or after scaling), take no part; shorter vectors count as filled up with zeros, an empty one as zeros.
Repeated rows are vectors of their own, and a query's own row alone is left out; ties go to the smaller id, null ids last;
a null id is never a query. Scores beyond a long's range count as its ends. An empty table has no rows. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import kernels as K

#: Vectors that the rotation is taken from, and the most of the first wave.
SAMPLE = 4096
HEAD = 4096
#: How many times as many vectors each wave has reached.
GROWTH = 8
#: Bytes of queries that are broadcast at a time.
BATCH = 32 << 20
#: Pairs looked at together: queries by vectors.
QUERIES, VECTORS = 1024, 2048
EXACT = 2.0**53
LAST = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``row, id, v, norm`` of all vectors that take part."""
    K.set_batches(df.sparkSession, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            n, whole = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
            with np.errstate(all="ignore"):
                x = np.floor(scale * whole.to_numpy(zero_copy_only=False))
                of = np.repeat(np.arange(len(n)), n)
                fine = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(of[~np.isfinite(x)], minlength=len(n)) == 0)
                norm = np.sqrt(np.bincount(of, x * x, len(n)))
            keep, some = pa.array(fine), fine[of]
            ends = np.append(0, np.cumsum(n[fine])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["row"].filter(keep), batch["id"].filter(keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(x[some])), pa.array(norm[fine])], names=["row", "id", "v", "norm"])

    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "row bigint, id bigint, v array<double>, norm double")


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists as rows of ``size`` numbers, shorter ones filled up with zeros."""
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), size))
    out[np.arange(size) < n[:, None]] = lists.flatten().to_numpy()
    return out


def rotation(sample: np.ndarray) -> np.ndarray:
    """The right singular vectors of a sample, the strongest first: an orthogonal matrix."""
    with np.errstate(all="ignore"):
        sample = np.nan_to_num(sample / np.sqrt((sample * sample).sum(1, keepdims=True)), posinf=0.0, neginf=0.0)
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


class Search:
    """The queries of a batch, and in one task the best that was found for each."""

    def __init__(self, k: int, rows: np.ndarray, vectors: np.ndarray, basis: np.ndarray, limit: np.ndarray, limit_id: np.ndarray):
        self.k, self.rows, self.vectors, self.basis = k, rows, vectors, basis
        self.limit, self.limit_id = limit.copy(), limit_id.copy()
        size = vectors.shape[1]
        self.steps = sorted({max(1, size // 4), max(1, size // 2)})
        self.length, self.turned, self.left = self._turned(vectors)
        none = np.zeros(0, np.int64)
        self.query, self.score, self.id = none, none, none

    def _turned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Lengths, rotated vectors, and their lengths without the first coordinates, for each step."""
        with np.errstate(all="ignore"):
            turned = vectors @ self.basis
            left = [np.sqrt((turned[:, s:] ** 2).sum(1)) for s in self.steps]
            return np.sqrt((vectors * vectors).sum(1)), turned, left

    def block(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Look at some vectors for all queries."""
        length, turned, left = self._turned(vectors)
        most = length.max(initial=0.0)
        for at in range(0, len(self.rows), QUERIES):
            of = np.arange(at, min(at + QUERIES, len(self.rows)))
            with np.errstate(all="ignore"):
                of = of[~(self.length[of] * most * (1 + 1e-9) < self.limit[of])]
            if len(of):
                self._found(*self._pairs(of, length, turned, left, vectors), rows, ids, vectors)

    def _pairs(self, of: np.ndarray, length: np.ndarray, turned: np.ndarray, left: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and vectors whose bounds reach the query's limit."""
        s = self.steps[0]
        with np.errstate(all="ignore"):
            # rounding of sums in another basis is far below this part of both lengths
            limit = self.limit[of].astype(float)
            bound = self.turned[of, :s] @ turned[:, :s].T
            bound += self.left[0][of, None] * left[0] + (1e-9 * self.length[of, None]) * length
            far = bound < limit[:, None]
            if far.mean() < 0.9:  # little is gone: the whole products at once
                score = self.vectors[of] @ vectors.T
                if self.length[of].max() * length.max(initial=0.0) < EXACT / 4 and score.shape[1] > self.k:
                    far = score < np.maximum(limit, np.partition(score, -self.k - 1, axis=1)[:, -self.k - 1])[:, None]
            q, x = np.nonzero(~far)
            q = of[q]
            for i in range(1, len(self.steps)):
                a, b = self.steps[i - 1 : i + 1]
                if b > a and far.mean() >= 0.9:
                    part = (self.turned[q, :b] * turned[x, :b]).sum(1) + self.left[i][q] * left[i][x] + 1e-9 * self.length[q] * length[x]
                    near = ~(part < self.limit[q])
                    q, x = q[near], x[near]
        return q, x

    def _found(self, q: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Multiply pairs out and keep each query's best."""
        other = self.rows[q] != rows[x]
        q, x = q[other], x[other]
        score = products(self.vectors, vectors, q, x)
        id = ids[x]
        better = (score > self.limit[q]) | (score == self.limit[q]) & (id <= self.limit_id[q])
        if not better.any():
            return
        query, score, id = (np.concatenate([a, b[better]]) for a, b in ((self.query, q), (self.score, score), (self.id, id)))
        order = np.lexsort((id, ~score, query))
        query, score, id = query[order], score[order], id[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        last = rank == self.k - 1
        self.limit[query[last]], self.limit_id[query[last]] = score[last], id[last]
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], id[kept]


def products(left: np.ndarray, right: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows of whole numbers, as longs."""
    out = np.empty(len(q), np.int64)
    for at in range(0, len(q), 1 << 16):
        a, b = left[q[at : at + (1 << 16)]], right[x[at : at + (1 << 16)]]
        with np.errstate(all="ignore"):
            # no sum of some of the products passes the sum of their sizes
            exact = (np.abs(a) * np.abs(b)).sum(1) < EXACT
            out[at : at + len(a)] = np.where(exact, (a * b).sum(1), 0)
        for i in np.flatnonzero(~exact).tolist():
            whole = sum(int(u) * int(v) for u, v in zip(a[i].tolist(), b[i].tolist(), strict=True))
            out[at + i] = max(LEAST, min(LAST, whole))
    return out


def searched(vectors: DataFrame, size: int, sent) -> DataFrame:
    """``query, id, score``: what tasks over these vectors find for the broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, basis, rows, own, limit, limit_id = sent.value
        search = Search(k, rows, own, basis, limit, limit_id)
        for batch in batches:
            ids, row, v = batch["id"].fill_null(LAST).to_numpy(), batch["row"].to_numpy(), matrix(batch["v"], size)
            for at in range(0, len(row), VECTORS):
                search.block(row[at : at + VECTORS], ids[at : at + VECTORS], v[at : at + VECTORS])
        id = pa.array(search.id, mask=search.id == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(search.rows[search.query]), id, pa.array(search.score)], names=["query", "id", "score"])

    return vectors.select("row", "id", "v").mapInArrow(run, "query bigint, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.select("query", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def waves(vectors: DataFrame, total: int) -> list[tuple[float, float]]:
    """Ranges of lengths from the greatest on, (least, below which), each of about ``GROWTH`` times as many vectors."""
    shares, share = [], 1.0 / GROWTH
    while total * share * GROWTH > HEAD:
        shares.insert(0, share)
        share /= GROWTH
    if not shares:
        return [(-1.0, float("inf"))]
    cuts = vectors.agg(F.percentile_approx("norm", [1 - s for s in shares], int(10 / shares[0]))).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    return list(zip([*cuts, -1.0], [float("inf"), *cuts], strict=True))


def top_k(df: DataFrame, queries: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` (a condition on the id, written as column ``id``) holds
    for, the k rows of the greatest inner products with it."""
    spark, tables = df.sparkSession, K.Tables(df.sparkSession)
    rows = tables.save(scaled(df, id_col, vec_col, scale), "scaled")
    total, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = max(size, 1)
    # rows of one length, however many, spread over tasks by their number
    vectors = tables.save(rows.repartitionByRange(F.desc("norm"), F.asc("row")).sortWithinPartitions(F.desc("norm"), F.asc("row")), "sorted")
    asked = tables.save(rows.where(queries & F.col("id").isNotNull()), "queries")
    basis = rotation(matrix(rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks(), size))
    ranges, many, done = waves(vectors, total), asked.count(), []
    parts = max(1, -(-many * size * 16 // BATCH))
    for part in range(parts if many else 0):
        some = asked.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(parts)) == part).select("row", "v").toArrow().sort_by("row")
        own, of = some["row"].to_numpy(), matrix(some["v"].combine_chunks(), size)
        limit, limit_id = np.full(len(own), LEAST), np.full(len(own), LAST)
        length, best = np.sqrt((of * of).sum(1)), None
        for least, below in ranges:
            # lengths fall from wave to wave: who can not gain here can not gain later
            with np.errstate(all="ignore"):
                on = ~(length * below * (1 + 1e-9) < limit) if np.isfinite(below) else np.ones(len(own), bool)
            if not on.any():
                break
            sent = spark.sparkContext.broadcast((k, basis, own[on], of[on], limit[on], limit_id[on]))
            found = searched(vectors.where((F.col("norm") >= least) & (F.col("norm") < below)) if np.isfinite(below) else vectors.where(F.col("norm") >= least), size, sent)
            best = tables.save(_best(found if best is None else found.unionByName(best.drop("rank")), k), "best")
            sent.destroy()
            last = best.where(F.col("rank") == k).select("query", "id", "score").toArrow()
            at = np.searchsorted(own, last["query"].to_numpy())
            limit[at], limit_id[at] = last["score"].to_numpy(), last["id"].fill_null(LAST).to_numpy()
        if best is not None:
            done.append(best)
    if not done:
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        tables.drop_all_but()
        return empty
    out = done[0]
    for best in done[1:]:
        out = out.unionByName(best)
    ids = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    tables.drop_all_but(asked, *done)
    return out.join(ids, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
