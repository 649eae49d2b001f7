"""Phrase collocation mining: which word sequences stand together more often than their parts tell.

Phrases of 1 to ``max_n`` words become rows (language, phrase, count), level by level. A phrase that is
frequent enough has only parts that are, so level n explodes those phrases alone whose two parts of n - 1
words may be frequent: a bit map of fixed size, built from the level before, tells which may (it never
denies one that is). Inside a task the words of some megabytes of text are numbered by an exact
dictionary, phrases are pairs of numbers, and each distinct phrase leaves the task once with its
count; the rest is a hash aggregate, joins with the counts of both parts, Decimal arithmetic, an
anti join with phrases one word longer, and a window in two steps, so that no task sorts a language.

A null language is ``und``, a null text empty; repeated rows count as often as they are there; an empty
table has no phrases. Columns besides text and language are not read. Counts must stay below 10**16,
beyond which products pass 38 digits and Spark raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import kernels as K

#: Characters that end a piece, and those that stand between the words of one.
ENDS_PIECE = tuple(b".,;:!?\n\x0b\x0c\r")
BETWEEN = tuple(b" \t")
#: Text bytes numbered by one dictionary, and rows of a batch that leaves a task.
BLOCK = 3 << 20
ROWS = 1 << 17
#: Bits of the map of what may be frequent: 16 MB, and 2 bits a phrase.
MAP_BITS = 1 << 27
#: Parts into which a language's phrases are dealt before its best are taken of all.
SALTS = 64

_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of ``buf`` as strings."""
    n = ends - starts
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    kind = np.int32 if max(len(buf), offsets[-1]) < 2**31 else np.int64
    at = np.repeat((starts - offsets[:-1]).astype(kind), n)
    at += np.arange(offsets[-1], dtype=kind)
    data = buf[at]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _numbered(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys as numbers from 0, and of each number a place where it stands and how often."""
    codes, distinct = pd.factorize(key)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = at[::-1]
    return codes, first, np.bincount(codes, minlength=len(distinct))


class Block:
    """The words of some texts, numbered, with their language and the bytes of all phrases."""

    def __init__(self, langs: pa.Array, buf: np.ndarray, offsets: np.ndarray):
        lut = np.ones(256, np.uint8)
        lut[list(ENDS_PIECE + BETWEEN)] = 0
        low = K.LOWER[buf]
        starts, ends, first = K.words(low, offsets, lut)
        many = np.diff(first)
        self.names = langs.dictionary_encode()
        self.lang = np.repeat(self.names.indices.to_numpy(zero_copy_only=False).astype(np.int64), many)
        inside = low[lut[low] == 1]
        lut[list(BETWEEN)] = 1
        stops = np.flatnonzero(lut[low] == 0)
        piece = np.searchsorted(stops, starts)
        doc = np.repeat(np.arange(len(many)), many)
        #: whether a word and the next one are of one piece
        self.next = np.append((piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False) if len(starts) else np.zeros(0, bool)
        before = np.append(0, np.cumsum(ends - starts))
        number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(before), pa.py_buffer(inside)]).dictionary_encode()
        self.word = self.lang * max(len(number.dictionary), 1) + number.indices.to_numpy()
        # the words again with one blank after each: every phrase is a range of these bytes
        self.start = before + np.arange(len(before))
        self.bytes = np.insert(inside, before[1:], 0x20)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the phrases of ``n`` words at these places, with their languages."""
        return _keyed(K.hash_ranges(self.bytes, self.start[at], self.start[at + n] - 1), _hashes(self.names.dictionary)[self.lang[at]])

    def phrases(self, n: int, may: np.ndarray | None) -> pa.RecordBatch:
        """Each distinct phrase of ``n`` words with its count, without those whose parts of n - 1 words can not be frequent."""
        at = np.arange(len(self.word))
        gram, first, count = _numbered(self.word, at)
        inside = np.ones(len(at), bool)
        for k in range(2, n + 1):
            if k == n and may is not None:
                inside[at] = _marked(may, self.hashes(first, n - 1))[gram[at]]
            # a phrase is the pair of its parts of one word less, at a place and at the next one
            inside = inside & np.append(inside[1:], False) & self.next if len(inside) else inside
            at, each = np.flatnonzero(inside), len(first)
            codes, first, count = _numbered(gram[at] * each + gram[at + 1] if len(at) else at, at)
            gram = np.zeros(len(self.word), np.int64)
            gram[at] = codes
        return pa.RecordBatch.from_arrays([self.names.dictionary.take(pa.array(self.lang[first])), slices(self.bytes, self.start[first], self.start[first + n] - 1), pa.array(count, pa.int64())], schema=_COUNTED)


def _hashes(values: pa.Array) -> np.ndarray:
    buf, offsets = K.layout(values)
    return K.hash_ranges(buf, offsets[:-1], offsets[1:])


def _keyed(phrase: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return K.mix(phrase + lang * np.uint64(0x9E3779B97F4A7C15))


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the map that a hash sets."""
    return (h % np.uint64(MAP_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(MAP_BITS)).astype(np.int64)


def _marked(may: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    out = np.ones(len(h), bool)
    for slot in _slots(h):
        out &= (may[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out


def exploded(df: DataFrame, n: int, may=None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``n`` words: each once a block of text, with its count there."""
    K.set_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(may.value, np.uint64) if may is not None else None
        for langs, texts in _gathered(batches):
            for i, j, buf, offsets in K.blocks(texts, BLOCK):
                found = Block(langs[i:j], buf, offsets).phrases(n, bits)
                for at in range(0, found.num_rows, ROWS):
                    yield found.slice(at, ROWS)
            K.release_large()

    own = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, phrase string, f bigint")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts of as many batches as make a block."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK:
            yield _columns(held)
            held, size = [], 0
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    one = pa.Table.from_batches(held)
    texts = one.column(1).cast(pa.large_string()).combine_chunks()
    langs = one.column(0).combine_chunks()
    return (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs), (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)


def may_be_frequent(frequent: DataFrame):
    """A broadcast bit map that marks all these phrases: of fixed size, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _keyed(_hashes(batch.column(1)), _hashes(batch.column(0)))
            slot = np.concatenate(_slots(h))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS >> 6, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def counted(df: DataFrame, tables: K.Tables, max_n: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """The phrases that occur ``least`` times or more, a table a level, and the words of each language."""
    levels, may, totals = [], None, None
    for n in range(1, max_n + 1):
        # blocks give each phrase once, so rows go straight to where they are added up
        rows = exploded(df, n, may, text_col, lang_col).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if n == 1:
            rows = tables.save(rows, "words")
            totals = tables.save(rows.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        levels.append(tables.save(rows.where(F.col("f") >= least), f"phrases-{n}"))
        if may is not None:
            may.destroy()
        may = may_be_frequent(levels[-1]) if n < max_n else None
    return levels, totals


def _words(phrase: str, many: Column) -> Column:
    """The first words of a phrase, so many; the last ones where the number is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), many)


def collocations(df: DataFrame, *, max_n: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of 2 to ``max_n`` words of each language: ``lang, rank, phrase, words, a, l, r, n, score``.

    ``a`` is a phrase's count, ``n`` its language's words; of all cuts in two the one of the least score counts (ties: the
    shortest first part), whose parts occur ``l`` and ``r`` times: score = floor(1000000 * a * a / (l * r)). A phrase goes
    if one that holds it occurs at least ``inside_percent`` as often; as counts fall with length, looking at phrases one
    word longer tells this for all.
    """
    if max_n < 2 or least < 1:
        raise ValueError("phrases have two words or more, and occur")
    tables = K.Tables(df.sparkSession)
    levels, totals = counted(df, tables, max_n, least, text_col, lang_col)
    candidates = levels[1].withColumn("words", F.lit(2))
    for n, level in enumerate(levels[2:], 3):
        candidates = candidates.unionByName(level.withColumn("words", F.lit(n)))
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": _words("phrase", F.col("k")), "tail": _words("phrase", F.col("k") - F.col("words"))})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"_up": big("f") * big("f") * F.lit(1000000).cast("decimal(7,0)"), "_down": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    scored = cuts.groupBy("lang", "phrase", "words", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("words > 2")
    ends = F.array(_words("phrase", F.col("words") - 1), _words("phrase", 1 - F.col("words")))
    over = longer.select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    over = over.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "over")
    covered = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("over") * 100 >= F.col("f") * inside_percent)
    kept = scored.join(over, covered, "left_anti").select("lang", "phrase", "words", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = tables.save(best.join(totals, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score"), "collocations")
    tables.drop_all_but(out)
    return out
