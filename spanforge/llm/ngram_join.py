"""Exact n-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct word shingles. Two texts link when ``100 * |x & y| >=
percent * |x | y|``. Then ``|x & y| >= a = ceil(percent * |x| / 100)``, so under any one
order of all tokens the prefixes of ``|x| - a + s`` tokens of both hold the first ``s``
tokens that they share. The order puts rare tokens first and frequent ones last, and the
prefix is extended to ``s = g + 1``. In it every rare token is indexed alone; the frequent
ones are dealt by hash into ``g`` groups and every two of a group are indexed as a
combination. Of ``g + 1`` shared tokens one is rare, or two are frequent ones of the same
group, so the index meets each linked pair, while texts that have one frequent token in
common do not meet. ``g`` grows with the set (a sixteenth to a thirty-second of it), so
the combinations stay in proportion to the text at every length. It is fixed by the power
of two below the set's size; a set that may link with one beyond the next power is indexed
with that one's ``g`` too, so each pair meets under the ``g`` of its larger set.

Steps:

1. ``digests``: texts of equal token sets become one node (a 128-bit digest), so copies
   cost nothing later.
2. ``frequencies``: the tokens of all texts are counted, summed in each task before they
   are sent. The tokens found in several texts go into a bit map of fixed size, the
   frequent ones into a list of bounded size. These two are all that is broadcast, and
   they only decide the order and the class of a token, never the result. A token that
   the map does not hold is unique to its text, is not indexed, and bounds the text's
   similarity to all others; where the map fills up, fewer are known to be unique.
3. ``index``: rows (entry, node). Nodes that share an entry form a bucket; equal buckets
   are one. A bucket is never gathered: it is counted, named and given its centre by
   aggregates that combine before the shuffle, and its members meet others by joins, which
   adaptive execution splits where they are skewed.
4. Stars: each bucket's most central node is verified against its members on whole token
   sets. Links merge nodes into components. Buckets that still hold several components
   take another centre, as long as this halves what is left.
5. The rest: in a bucket, members outside its main component against all others of other
   components, so a group of near copies costs about its size times the number of those
   that did not link with a centre, not its square. A pair is dropped in the join where
   its sizes, unique tokens or parity sketches (512 bits; the bits in which two sketches
   differ are at most the tokens in which the sets differ) show that it can not link. All
   others are verified, so the components are exact.
6. Components: of a bounded number of edges in one task, of more by alternating large-star
   and small-star steps on tables.

Shingles are compared by 64-bit hashes and nodes by 128-bit digests of those.

Cases: a null, empty or wordless text has an empty set and links with nothing; a text of
fewer words than a shingle has the whole sequence as its one token; equal texts are in one
component; rows that share a ``doc_id`` stay apart in the result, each with its own row;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import kernels as K

#: Bits of the map of shared tokens (16 MB), and of the filter of nodes whose sets are needed (2 MB).
MAP_BITS = 27
NODE_BITS = 24
#: A token is frequent from so many texts on; of so many tokens at most, the most frequent.
FREQUENT = 512
FREQUENT_TOKENS = 1 << 20
TASK_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 20
SEEN = 200_000
LOCAL_EDGES = 1 << 20
#: Candidates of the last round that are not worth another round of stars.
REST_PAIRS = 50_000
#: 64-bit words of a parity sketch.
WORDS = 8
SKETCH = [f"s{k}" for k in range(WORDS)]
_LOW = np.uint64((1 << 40) - 1)


def token_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    K.drop_caches()
    for i, j, buf, offsets in K.blocks(column):
        buf = K.LOWER[buf]
        starts, ends, first = K.words(buf, offsets, K.WHITE)
        h, before = K.hash_windows(K.hash_ranges(buf, starts, ends), first, n)
        edges = before.tolist()
        for r in range(j - i):
            yield i + r, np.unique(h[edges[r] : edges[r + 1]])
    K.release_large()


def digest(tokens: np.ndarray) -> bytes:
    """The node of a token set."""
    return hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of a set's tokens in each of 64 * WORDS groups, as WORDS numbers."""
    odd = np.bincount((tokens & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def least_own(x, percent: int):
    """The least overlap of a linked set of size x with any set."""
    return -(-percent * x // 100)


class Order:
    """The class of each token: 0 surely in one text only, 1 in several texts, 2 frequent."""

    def __init__(self, marks: np.ndarray, frequent: np.ndarray, parts: int, size: int):
        self.marks, self.frequent, self.parts, self.size = marks, frequent, parts, size

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        out, part = np.ones(len(tokens), np.uint8), part_of(tokens, self.parts)
        for at in places(tokens, self.size):
            at += part.astype(np.int64) * self.size
            out &= self.marks[at >> 3] >> (at & 7).astype(np.uint8)
        if len(self.frequent):
            key = part << np.uint64(40) | (tokens & _LOW)
            i = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
            out[self.frequent[i] == key] = 2
        return out


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def places(tokens: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of a token in its part's ``size`` bits of the map, by its lower 40 bits. Tokens that fall together only
    seem more frequent."""
    low = tokens & _LOW
    return [(((low * np.uint64(m)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def digests(rows: DataFrame, n: int) -> DataFrame:
    """``doc_id, key, node, n_shingles`` of each row; the node is null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for _, tokens in token_sets(batch.column(2), n):
                nodes.append(digest(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "key", "node", "n_shingles"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, node binary, n_shingles long")


class _Seen:
    """Remembers the latest sets of a task, up to a number of them."""

    def __init__(self, limit: int):
        self.held, self.limit = set(), limit

    def add(self, d: bytes) -> bool:
        """Whether it is new."""
        if d in self.held:
            return False
        if len(self.held) >= self.limit:
            self.held.clear()
        self.held.add(d)
        return True


def frequencies(rows: DataFrame, n: int, parts: int, tables: K.Tables, frequent: int, map_bits: int) -> Order:
    """Count the tokens of all distinct sets of each task, and keep the order's two bounded tables."""
    pair, size_of = np.dtype([("low", "<u8"), ("n", "<i8")]), max(8, (1 << map_bits) // parts // 8 * 8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen(SEEN)

        def flush() -> pa.RecordBatch:
            # a token that is once in this lot takes five bytes; one that is there more often sixteen, once
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            once, often = tokens[times == 1], tokens[times > 1]
            low = (once & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            more = np.empty(len(often), pair)
            more["low"], more["n"] = often & _LOW, times[times > 1]
            a, b = (np.searchsorted(part_of(t, parts).astype(np.int64), np.arange(parts + 1)) for t in (once, often))
            some = np.flatnonzero(np.diff(a) + np.diff(b))
            columns = [[x[e[p] : e[p + 1]].tobytes() for p in some] for x, e in ((low, a), (more, b))]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "once", "often"])

        for batch in batches:
            for _, tokens in token_sets(batch.column(0), n):
                if len(tokens) and seen.add(digest(tokens)):
                    held.append(tokens)
                    size += len(tokens)
                if size >= TASK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("once")]).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        often = np.concatenate([np.frombuffer(x.as_py(), pair) for x in table.column("often")])
        low, back = np.unique(np.concatenate([wide.reshape(-1).view("<u8"), often["low"]]), return_inverse=True)
        times = np.bincount(back, np.concatenate([np.ones(len(raw), np.int64), often["n"]]), len(low)).astype(np.int64)
        low, times = low[times > 1], times[times > 1]
        bits = np.zeros(size_of, bool)
        for at in places(low, size_of):
            bits[at] = True
        level = np.floor(np.log2(np.maximum(times, 1))).astype(np.int64)
        out = [(-1, 0, np.packbits(bits, bitorder="little").tobytes())]
        for k in np.unique(level[times >= frequent]).tolist():
            some = low[(level == k) & (times >= frequent)]
            out.append((k, len(some), (some | np.uint64(part) << np.uint64(40)).astype("<u8").tobytes()))
        columns = list(zip(*out, strict=True))
        K.release_large()
        return pa.table([pa.array([part] * len(out), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["part", "level", "n", "data"])

    grouped = rows.select("text").mapInArrow(run, "part int, once binary, often binary").groupBy("part")
    counted = tables.save(grouped.applyInArrow(count, "part int, level int, n long, data binary"), "frequencies")
    levels = {r["level"]: r["n"] for r in counted.where("level >= 0").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least = next(k for k in range(66) if sum(m for j, m in levels.items() if j >= k) <= FREQUENT_TOKENS)
    marks = np.zeros(parts * size_of // 8, np.uint8)
    for r in counted.where("level = -1").select("part", "data").toLocalIterator():  # the map in parts, 2 ** map_bits bits in all
        marks[r["part"] * size_of // 8 : (r["part"] + 1) * size_of // 8] = np.frombuffer(r["data"], np.uint8)
    keys = [np.frombuffer(r["data"], "<u8") for r in counted.where(F.col("level") >= least).select("data").toLocalIterator()]
    return Order(marks, np.sort(np.concatenate([np.zeros(0, np.uint64), *keys])), parts, size_of)


def grouping(size: int, percent: int) -> list[tuple[int, int]]:
    """(power, g) under which a set of this size is indexed: its own power of two, and the next if it may link with a set there."""
    power = size.bit_length() - 1
    own = [(power, max(1, 2**power // 16))]
    if 100 * size >= percent * 2 ** (power + 1):
        own.append((power + 1, max(1, 2 ** (power + 1) // 16)))
    return own


def combinations(tokens: np.ndarray, power: int, g: int) -> np.ndarray:
    """The entries of every two of the tokens that fall into the same of ``g`` groups."""
    group = (tokens & np.uint64(0xFFFFFFFF)) * np.uint64(g) >> np.uint64(32)
    by = np.lexsort((tokens, group))
    tokens, group, out, step = tokens[by], group[by], [], 1
    while True:  # by distance in the order, at most the size of the largest group
        same = np.flatnonzero(group[step:] == group[:-step]) if step < len(tokens) else ()
        if not len(same):
            break
        a, b = tokens[same], tokens[same + step]
        out.append(K.mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x5851F42D4C957F2D + power))))
        step += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def entries(tokens: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, int]:
    """The index entries of a set, and how many of its tokens no other set can have."""
    size = len(tokens)
    kind = order.classes(tokens)
    unique, short = int((kind == 0).sum()), size - least_own(size, percent)
    if unique > short:
        return np.zeros(0, np.uint64), unique  # no other set can share enough
    by = np.argsort(kind, kind="stable")
    tokens, kind, ways = tokens[by], kind[by], grouping(size, percent)
    longest = short + 1 + max(g for _, g in ways)
    out = [tokens[:longest][kind[:longest] == 1]]
    for power, g in ways:
        out.append(combinations(tokens[: short + 1 + g][kind[: short + 1 + g] == 2], power, g))
    return np.concatenate(out), unique


def index(rows: DataFrame, n: int, percent: int, order) -> DataFrame:
    """``entry, node, n, u`` of each distinct set's index entries; n is its size and u the number of its unique tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen(SEEN)

        def flush() -> pa.RecordBatch:
            many = [len(x) for x, _, _, _ in held]
            nodes = np.repeat(np.frombuffer(b"".join(d for _, d, _, _ in held), "V16"), many)
            node = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(np.arange(0, 16 * len(nodes) + 1, 16, dtype=np.int32)), pa.py_buffer(nodes.tobytes())])
            numbers = [pa.array(np.repeat(np.array([x[k] for x in held], np.int32), many)) for k in (2, 3)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _, _, _ in held]).view(np.int64)), node, *numbers], ["entry", "node", "n", "u"])

        for batch in batches:
            for _, tokens in token_sets(batch.column(0), n):
                if not len(tokens) or not seen.add(d := digest(tokens)):
                    continue
                found, unique = entries(tokens, order.value, percent)
                if len(found):
                    held.append((found, d, len(tokens), unique))
                    size += len(found)
                if size >= TASK_TOKENS // 8:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("text").mapInArrow(run, "entry long, node binary, n int, u int").dropDuplicates(["entry", "node"])


def could_link(x: str, xu: str, y: str, yu: str, percent: int) -> str:
    """SQL: sets of sizes x, y with so many unique tokens may link."""
    return f"100L * least({x} - {xu}, {y} - {yu}) >= {percent}L * greatest({x} + {yu}, {y} + {xu})"


def members(found: DataFrame, tables: K.Tables) -> DataFrame:
    """``bucket, node, n, u`` of the entries that two or more nodes share; equal buckets appear once."""
    h = [F.xxhash64("node", F.lit(k)) for k in (0, 1)]
    shared = found.groupBy("entry").agg(F.count("*").alias("many"), F.bit_xor(h[0]).alias("x"), F.bit_xor(h[1]).alias("y")).where("many > 1")
    one = shared.groupBy("many", "x", "y").agg(F.min("entry").alias("bucket"))
    return found.join(one.select("bucket"), F.col("entry") == F.col("bucket")).select("bucket", "node", "n", "u")


def needed_sets(rows: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """``node, tokens`` (packed) and the parity sketch ``s0 ...`` of the given nodes, one row each, and of a few more.

    The nodes are broadcast as a bit map of fixed size; what else falls on its bits is harmless.
    """
    spark, mask = rows.sparkSession, (1 << NODE_BITS) - 1
    at = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit(mask))
    bits = nodes.select(F.shiftright(at, 15).alias("b"), at.bitwiseAND(F.lit(0x7FFF)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    marks = np.zeros((mask >> 3) + 1, np.uint8)
    for r in bits.toLocalIterator():  # at most NODE_BITS in all
        marks[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    wanted = spark.sparkContext.broadcast(marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(SEEN)
        for batch in batches:
            found = []
            for _, tokens in token_sets(batch.column(0), n):
                if not len(tokens):
                    continue
                d = digest(tokens)
                k = int.from_bytes(d[:4], "big") & mask
                if wanted.value[k >> 3] >> (k & 7) & 1 and seen.add(d):
                    found.append((d, tokens.astype("<u8").tobytes(), sketch(tokens)))
            if found:
                s = np.stack([x for _, _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.binary()), pa.array([x for _, x, _ in found], pa.binary()), *(pa.array(s[:, k]) for k in range(WORDS))], ["node", "tokens", *SKETCH])

    return rows.select("text").mapInArrow(run, "node binary, tokens binary, " + ", ".join(f"{c} long" for c in SKETCH)).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link."""
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets.select("node", "tokens").join(some, "node", "left_semi")
    left, right = sets.withColumnsRenamed({"node": "a", "tokens": "ta"}), sets.withColumnsRenamed({"node": "b", "tokens": "tb"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, tables: K.Tables, local: int | None = None) -> DataFrame:
    """``node, label``: each linked node's least reachable node.

    Up to ``local`` edges (a bounded table) one task finds them by vectorised hooking and pointer jumping; beyond that,
    alternating large and small stars do, on tables.
    """
    edges = tables.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    if edges.count() <= (LOCAL_EDGES if local is None else local):
        return edges.coalesce(1).mapInArrow(_hooked, "node binary, label binary")
    return _stars_of(edges, tables)


def _hooked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task."""
    ends = [[], []]
    for b in batches:
        for held, column in zip(ends, b.columns, strict=True):
            held.append(np.frombuffer(b"".join(column.to_pylist()), "S16"))
    if not ends[0]:
        return
    u, v = (np.concatenate(x) for x in ends)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not ((further := root[root]) == root).all():
            root = further
    raw = nodes.tobytes()
    names = [raw[i : i + 16] for i in range(0, len(raw), 16)]
    for i in range(0, len(names), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)], pa.binary()), pa.array([names[r] for r in root[i : i + (1 << 16)].tolist()], pa.binary())], ["node", "label"])


def _stars_of(edges: DataFrame, tables: K.Tables) -> DataFrame:
    """Components by alternating large-star and small-star steps."""

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(m.select("u", F.col("m").alias("v"))).distinct()
        edges = tables.save(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _may_link(x: str, y: str, percent: int) -> str:
    """SQL: two members (prefixes of their columns) of different components that could link by sizes, unique tokens and sketches."""
    differ = " + ".join(f"bit_count({x}{c} ^ {y}{c})" for c in SKETCH)
    return f"{x}label != {y}label and {could_link(f'{x}n', f'{x}u', f'{y}n', f'{y}u', percent)} and {100 + percent}L * ({differ}) <= {100 - percent}L * ({x}n + {y}n)"


def _stars(buckets: DataFrame, centres: DataFrame, percent: int, turn: int, tables: K.Tables) -> DataFrame:
    """Each bucket's centre against its members of other components. First the centre is the node with most shared tokens.

    The centres are a table of their own, so that the join stands alone in its stage and skewed buckets can be split.
    """
    rank = [] if turn else [(F.col("n") - F.col("u")).alias("shared")]
    kept = ["node", "n", "u", "label", *SKETCH]
    centre = centres.groupBy("bucket").agg(F.max(F.struct(*rank, F.xxhash64("node", F.lit(turn)).alias("h"), *kept)).alias("c"))
    near = buckets.join(tables.save(centre, "centres"), "bucket").where(F.expr(_may_link("", "c.", percent)))
    return near.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _main(buckets: DataFrame) -> DataFrame:
    """``bucket, main, others, total`` of the buckets that hold several components: the one with most members, how many
    members lie outside it, and how many there are."""
    parts = buckets.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("top"))
    return parts.where("top.c < total").select("bucket", F.col("top.label").alias("main"), (F.col("total") - F.col("top.c")).alias("others"), "total")


def _rest(buckets: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of different components of a bucket that may link; one of each lies outside the main component."""
    other = buckets.withColumnsRenamed({c: f"_{c}" for c in buckets.columns if c != "bucket"})
    near = buckets.where("label != main").join(other, "bucket").where(F.expr(f"(_label = main or node < _node) and {_may_link('', '_', percent)}"))
    return near.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _links(rows: DataFrame, found: DataFrame, n: int, percent: int, tables: K.Tables, frequent: int, map_bits: int) -> DataFrame | None:
    """Labels of all linked nodes, or None if there are none."""
    spark = rows.sparkSession
    total = found.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return None
    parts = max(8, min(1 << 20, total // GROUP_TOKENS))
    order = spark.sparkContext.broadcast(frequencies(rows, n, parts, tables, frequent, map_bits))
    buckets = tables.save(members(tables.save(index(rows, n, percent, order), "entries"), tables), "buckets")
    sets = tables.save(needed_sets(rows, n, buckets.select("node")), "sets")
    order.destroy()
    K.release_large()
    buckets = tables.save(buckets.join(sets.select("node", *SKETCH), "node"), "members")
    K.release_large()
    labels, links, turn, before = None, None, 0, None
    now = buckets.withColumn("label", F.col("node"))
    while True:
        if turn:
            main = tables.save(_main(now), "main")
            left = main.agg(F.sum(F.col("others").cast("double") * F.col("total"))).first()[0] or 0
            if not left:
                return labels
            now = tables.save(now.join(main.select("bucket", "main"), "bucket"), "open")
        last = turn and (left <= REST_PAIRS or before is not None and 2 * left > before)
        if last:
            pairs = _rest(now, percent)
        else:
            pairs = _stars(now, now.where("label != main") if turn else now, percent, turn, tables)
        more = tables.save(verified(tables.save(pairs, "pairs"), sets, percent), "links")
        links = more if links is None else links.union(more)
        labels = tables.save(components(links, tables), "labels")
        if last:
            return labels
        before, turn = left if turn else None, turn + 1
        now = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, tables: K.Tables, frequent: int = FREQUENT, map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, node, n_shingles`` of each row (key: a hash of its text), and ``node, label`` of all nodes."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    K.set_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = tables.save(digests(rows, words), "digests")
    labels = _links(rows, found, words, percent, tables, frequent, map_bits)
    nodes = found.where("node is not null").select("node").distinct()
    return found, nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **bounds) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` (the least doc_id reachable by links, its own included).

    ``bounds``: ``frequent``, the number of texts from which a token is frequent, and ``map_bits``, the size of the bit map
    as a power of two. They decide which candidates are made and never results.
    """
    tables = K.Tables(docs.sparkSession)
    found, labels = _labelled(docs, id_col, text_col, words, percent, tables, **bounds)
    least = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = tables.save(least.join(labels, "node"), "nodes")
    of = tables.save(nodes.join(nodes.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id"), "components")
    tables.drop_all_but(found, of)
    linked = found.where("node is not null").join(of, "node").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.union(found.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **bounds) -> DataFrame:
    """Exactly one row of each component, with its own columns: that of least doc_id (null last; of several texts under
    it, that of least hash). Rows without words all stay."""
    tables = K.Tables(docs.sparkSession)
    found, labels = _labelled(docs, id_col, text_col, words, percent, tables, **bounds)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = tables.save(found.where("node is not null").groupBy("node").agg(F.min(rank).alias("first")).join(labels, "node"), "nodes")
    first = nodes.join(nodes.groupBy("label").agg(F.min("first").alias("leader")), "label").select("node", "leader")
    ranked = found.where("node is not null").join(first, "node").select("doc_id", "key", F.expr("doc_id <=> leader.doc_id and key = leader.key").alias("stays"))
    ranked = tables.save(ranked.groupBy("doc_id", "key", "stays").agg(F.count("*").alias("many")).where("not stays or many > 1"), "copies")
    tables.drop_all_but(ranked)

    def of(some: DataFrame):
        return docs[id_col].eqNullSafe(some["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == some["key"])

    gone, twice = ranked.where("not stays"), ranked.where("stays")
    if twice.isEmpty():
        return docs.join(gone, of(gone), "left_anti")
    once = docs.join(twice, of(twice), "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(ranked, of(ranked), "left_anti").unionByName(once)
