"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which ids stand for which.

Each text is encoded, after one blank, by tokenizer A (byte-level BPE of the tokenizers library, special
strings as plain text) and by tokenizer B (a sentencepiece model, which puts the blank there itself).
The ends of both cut the bytes into elementary intervals; the token of each side that owns an interval
is found by binary search, an interval is one overlap of one A token with one B token, and an end that
both share closes a group.

Both tokenizers always cut before a blank that follows a visible character (for B this is read off its
vocabulary; without it, texts stay whole), so texts are taken apart there, and a worker encodes and
aligns each distinct part once, found by an exact dictionary. What a part gives (groups, pairs of ids)
is then added up by document.

A pair of ids counts in how many documents they are linked. Counts are added up before and in the
shuffle; the pairs of highest counts, of a fixed number, are broadcast, and only what is left of a
document's pairs is joined, so that no pair that all documents have becomes one task's key.

A text that is null or empty, or that one of the tokenizers does not give back byte for byte, has no tokens:
zeros and an empty text of groups. Repeated rows are documents of their own; an empty table gives no rows.
Kept columns named like a result come out with ``_own_`` before their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import kernels as K
from spanforge.llm.tokenize import Encoder, default_path

#: Distinct parts that a worker keeps at most, before those of one block.
PARTS = 3 << 17
BLOCK = 2 << 20
#: Pairs of the highest counts that are broadcast: 16 bytes each.
HEAD = 1 << 20
BLANK = "▁"
PREFIX = "_own_"

RESULTS = (("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("many", pa.list_(pa.int32())))
_SQL_TYPES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, many array<int>"


def default_paths() -> tuple[str, str]:
    """The public vocabularies of this environment: byte-level and piece."""
    import public_tokenizers

    return default_path(), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: visible ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of all ids, one after the other, and where each begins."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.arange(n.sum()) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)]


class Sides:
    """Both tokenizers of a worker, and what the distinct parts met so far gave."""

    def __init__(self, a_path: str, b_path: str, product: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.product = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), product
        self.a.encode_special_tokens = True
        known, special = byte_alphabet(), {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        ids = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.of_a = Vocabulary([bytes(known[c] for c in ids[i]) if i in ids and i not in special else b"" for i in range(max(ids) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.decimals = Decimals(max(self.of_a.size, self.of_b.size))
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.blank = self.b.piece_to_id(BLANK)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        # of each part: whether both sides give it back, its tokens, groups and links, and its distinct pairs
        self.facts = np.zeros((0, 5), np.int64)
        self.first, self.distinct = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, parts: list[bytes], size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Each side's ids of all parts, and how many each part has; every part begins with a blank, which B adds by itself.

        Parts that end where both sides always cut are encoded in one call; the bytes of the ids tell them apart.
        """
        joint = self.cuts & np.fromiter((_ends_visibly(p) for p in parts), bool, len(parts))
        text = b"".join(p for p, j in zip(parts, joint.tolist(), strict=True) if j).decode("utf-8", "replace")
        rest = [p.decode("utf-8", "replace") for p, j in zip(parts, joint.tolist(), strict=True) if not j]
        whole = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]) if text else []
        single = [e.ids for e in self.a.encode_batch(rest, add_special_tokens=False)], [x if len(t) > 1 else [self.blank] for x, t in zip(self.b.encode([t[1:] for t in rest], num_threads=1), rest, strict=True)]
        sides = []
        for of, ids, others in zip((self.of_a, self.of_b), whole, single, strict=True):
            ids = np.array(ids, np.int64)
            ends, wanted = np.cumsum(of.length[ids]), np.cumsum(size[joint])
            upto = np.searchsorted(ends, wanted) + 1
            if len(wanted) and (len(ends) != upto[-1] or (ends[np.minimum(upto, len(ends)) - 1] != wanted).any()):
                return self._one_by_one(parts)  # some part is not given back in its length
            n = np.zeros(len(parts), np.int64)
            n[joint], n[~joint] = np.diff(upto, prepend=0), [len(x) for x in others]
            both = np.concatenate([ids, np.fromiter(chain.from_iterable(others), np.int64)])
            begin = np.zeros(len(parts), np.int64)
            begin[joint], begin[~joint] = upto - n[joint], len(ids) + np.cumsum(n[~joint]) - n[~joint]
            sides.append((both[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)], n))
        return sides[0], sides[1]

    def _one_by_one(self, parts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        own = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        other = [ids if len(t) > 1 else [self.blank] for ids, t in zip(self.b.encode([t[1:] for t in texts], num_threads=1), texts, strict=True)]
        return tuple((np.fromiter(chain.from_iterable(x), np.int64), np.array([len(i) for i in x], np.int64)) for x in (own, other))

    def learn(self, parts: list[bytes]) -> None:
        """Align parts that are not known yet."""
        size = np.array([len(p) for p in parts], np.int64)
        (ids_a, n_a), (ids_b, n_b) = self.encode(parts, size)
        fine = np.ones(len(parts), bool)
        for n, ids, of in ((n_a, ids_a, self.of_a), (n_b, ids_b, self.of_b)):
            fine &= np.bincount(np.repeat(np.arange(len(parts)), n), of.length[ids], len(parts)).astype(np.int64) == size
        for n, ids, of in ((n_a, ids_a, self.of_a), (n_b, ids_b, self.of_b)):
            there = np.frombuffer(b"".join(p for p, good in zip(parts, fine.tolist(), strict=True) if good), np.uint8)
            wrong = np.flatnonzero(there != of.joined(ids[np.repeat(fine, n)]))
            fine[np.flatnonzero(fine)[np.searchsorted(np.cumsum(size[fine]), wrong, "right")]] = False
        ids_a, ids_b = ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)]
        n_a, n_b = np.where(fine, n_a, 0), np.where(fine, n_b, 0)
        end_a, end_b = np.cumsum(self.of_a.length[ids_a]), np.cumsum(self.of_b.length[ids_b])
        ends, own, other, shared = intervals(end_a, end_b)
        # tokens up to each end that both sides share: the groups
        to_a, to_b = own[shared] + 1, other[shared] + 1
        if self.product:
            own, other = products(np.diff(to_a, prepend=0), np.diff(to_b, prepend=0))
        part_ends = np.cumsum(np.where(fine, size, 0))
        part_of = np.searchsorted(part_ends, end_a[own])
        key, many = summed(part_of * (self.of_a.size * self.of_b.size) + ids_a[own] * self.of_b.size + ids_b[other])
        place, pair = np.divmod(key, self.of_a.size * self.of_b.size)
        n_pairs = np.bincount(place, minlength=len(parts))
        groups_of = np.searchsorted(part_ends, ends[shared])
        facts = np.stack([fine, n_a, n_b, np.bincount(groups_of, minlength=len(parts)), np.bincount(part_of, minlength=len(parts))], 1).astype(np.int64)
        known = len(self.groups)
        self.number |= {p: known + i for i, p in enumerate(parts)}
        self.groups += self.decimals.written(ids_a, ids_b, to_a, to_b, facts[:, 3])
        self.first = np.append(self.first, len(self.pair) + np.cumsum(n_pairs) - n_pairs)
        self.distinct, self.facts = np.append(self.distinct, n_pairs), np.concatenate([self.facts, facts])
        self.pair, self.many = np.append(self.pair, pair), np.append(self.many, many)

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of parts that follow each other without gaps; new ones are learnt."""
        offsets = np.append(starts, ends[-1:]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.number]
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        return np.fromiter((self.number[p] for p in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each document is aligned, and the numbers of its parts."""
        if len(self.groups) > PARTS:
            self.forget()
        size = np.diff(offsets)
        buf = np.insert(buf, offsets[:-1], 0x20)
        offsets = offsets + np.arange(len(offsets))
        starts, ends, first = Encoder._parts(buf, offsets) if self.cuts else (offsets[:-1], offsets[1:], np.arange(len(offsets)))
        number = self.numbers(buf, starts, ends) if len(starts) else np.zeros(0, np.int64)
        parts = np.split(number, first[1:-1]) if len(size) else []
        fine = size > 0
        bad = np.unique(np.repeat(np.arange(len(size)), np.diff(first))[self.facts[number, 0] == 0])
        for d in bad[fine[bad]].tolist():  # the whole text decides
            whole = buf[offsets[d] : offsets[d + 1]]
            parts[d] = self.numbers(whole, np.array([0]), np.array([len(whole)]))
            fine[d] = self.facts[parts[d][0], 0] == 1
        return fine, parts


def intervals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two divisions of the same bytes: their ends, the owners on both sides, and where both sides end."""
    ends = np.union1d(end_a, end_b)
    own, other = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return ends, own, other, (end_a[own] == ends) & (end_b[other] == ends)


def products(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of one group, given each group's tokens on both sides."""
    times = np.repeat(n_b, n_a)
    own = np.repeat(np.arange(n_a.sum()), times)
    return own, np.repeat(np.repeat(np.cumsum(n_b) - n_b, n_a), times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def summed(keys: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they are there."""
    if many is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(many[order], at) if len(at) else np.zeros(0, np.int64)


def _ends_visibly(part: bytes) -> bool:
    """Whether a part ends with a character before which a following blank is surely cut off."""
    return 0x20 < part[-1] < 0x7F or len(part) > 1 and 0xC3 <= part[-2] <= 0xCA


class Decimals:
    """The decimal texts of all ids, one after the other."""

    def __init__(self, size: int):
        texts = [b"%d" % i for i in range(size)]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` for each part, given the tokens of both sides up to the end of each group."""
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # a group's A tokens, then its B tokens: each id with the sign after it
        place_a = np.arange(len(ids_a)) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(ids_b)) + np.repeat(to_a, n_b)
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        sign[place_a[to_a - 1]], sign[place_b[to_b - 1]] = ord("|"), ord(";")
        n = self.length[ids]
        ends = np.cumsum(n + 1)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[inner + np.repeat(ends - n - 1, n)] = self.bytes[inner + np.repeat(self.begin[ids], n)]
        out[ends - 1] = sign
        raw, upto = out.tobytes(), np.cumsum(n_groups)
        stop = np.where(n_groups > 0, ends[place_b[to_b[upto - 1] - 1]], 0) if len(to_b) else np.zeros(len(n_groups), np.int64)
        stop = np.maximum.accumulate(stop)
        return [raw[i:j][:-1] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


def align(df: DataFrame, a_path: str | None = None, b_path: str | None = None, *, keep: list[str] | None = None, text_col: str = "text", product: bool = False, digest: bool = False) -> DataFrame:
    """The kept columns (all, if none are named) of each row with ``n_a, n_b, n_groups, n_links, groups, pairs, many``.

    ``groups`` holds ``a1,a2|b1;a3|b2,b3``, decimal ids of A and B by group, or with ``digest`` its SHA-256. ``pairs`` are
    the distinct linked pairs, a * (ids of B) + b in ascending order, and ``many`` how often each is linked. Linked are
    tokens that overlap, or with ``product`` all tokens of one group.
    """
    paths = default_paths()
    a_path, b_path = a_path or paths[0], b_path or paths[1]
    K.set_batches(df.sparkSession)
    results = {name for name, _ in RESULTS}
    text = K.free_name([*df.columns, *results], "_text")
    own = df.select(*(F.col(c).alias(PREFIX + c if c.lower() in results else c) for c in (keep if keep is not None else df.columns)), F.col(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = None
        for batch in batches:
            sides = sides or Sides(a_path, b_path, product)
            for i, j, buf, offsets in K.blocks(batch.column(batch.num_columns - 1), BLOCK):
                kept = batch.slice(i, j - i)
                columns = _documents(sides, *sides.block(buf, offsets), digest)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *columns], names=[*kept.schema.names[:-1], *(name for name, _ in RESULTS)])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]]
    return own.mapInArrow(run, ", ".join([*types, _SQL_TYPES]))


def _documents(sides: Sides, fine: np.ndarray, parts: list[np.ndarray], digest: bool) -> list[pa.Array]:
    """The result columns of a block."""
    parts = [p if good else p[:0] for p, good in zip(parts, fine.tolist(), strict=True)]
    n = np.array([len(p) for p in parts], np.int64)
    number = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(parts)), n)
    upto = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(sides.facts[number], 0)])
    edge = np.append(0, np.cumsum(n))
    totals = upto[edge[1:]] - upto[edge[:-1]]
    groups = sides.groups
    written = (b";".join([groups[i] for i in p.tolist()]) for p in parts)
    texts = [hashlib.sha256(w).hexdigest() if digest and w else w.decode() for w in written]
    # each part once a document, then each pair once a document
    space = max(len(groups), 1)
    key, times = summed(doc * space + number)
    doc, number = np.divmod(key, space)
    each = sides.distinct[number]
    at = np.arange(each.sum()) + np.repeat(sides.first[number] - (np.cumsum(each) - each), each)
    space = sides.of_a.size * sides.of_b.size
    key, many = summed(np.repeat(doc, each) * space + sides.pair[at], sides.many[at] * np.repeat(times, each))
    doc, pair = np.divmod(key, space)
    ends = pa.array(np.searchsorted(doc, np.arange(len(parts) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(many.astype(np.int32)))]
    return [*(pa.array(totals[:, i]) for i in range(1, 5)), pa.array(texts, pa.string()), *lists]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs``: in how many rows of ``align`` each pair is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))


def with_counts(df: DataFrame, a_path: str | None = None, b_path: str | None = None, *, keep: list[str] | None = None, text_col: str = "text", product: bool = False, digest: bool = False) -> DataFrame:
    """What ``align`` gives but for the pairs, with ``n_best`` and ``count_sum``: the links of each row whose count is the
    highest of all pairs with their A id, and the sum of the counts over its links."""
    spark, tables = df.sparkSession, K.Tables(df.sparkSession)
    paths = default_paths()
    ids_of_b = Sides(a_path or paths[0], b_path or paths[1]).of_b.size
    row = K.free_name([*df.columns, *(PREFIX + name for name, _ in RESULTS)], "_row")
    columns = keep if keep is not None else df.columns
    aligned = align(df.withColumn(row, F.monotonically_increasing_id()), a_path, b_path, keep=[*columns, row], text_col=text_col, product=product, digest=digest)
    aligned = tables.save(aligned, "aligned")
    counts = tables.save(pair_counts(aligned).withColumn("level", F.floor(F.log2("docs") * 8).cast("int")), "pairs")
    best = counts.groupBy(F.expr(f"pair div {ids_of_b}").alias("a")).agg(F.max("docs").alias("most"))  # a row an id of A
    by_level = sorted((tuple(r) for r in counts.groupBy("level").count().collect()), reverse=True)
    level, total = 2**31 - 1, 0
    for at, n in by_level:
        if (total := total + n) > HEAD:
            break
        level = at
    own = best.toArrow()
    most = np.zeros(int(own["a"].to_numpy().max(initial=0)) + 1, np.int64)
    most[own["a"].to_numpy()] = own["most"].to_numpy()
    head = counts.where(F.col("level") >= level).select("pair", "docs").toArrow()
    order = np.argsort(head["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((head["pair"].to_numpy()[order].tobytes(), head["docs"].to_numpy()[order].tobytes(), most.tobytes()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, most = (np.frombuffer(x, np.int64) for x in sent.value)
        for batch in batches:
            pair, many, edge = batch["pairs"].flatten().to_numpy(), batch["many"].flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(batch["pairs"].value_lengths().to_numpy()))
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            n = np.where(known, docs[at] if len(keys) else 0, 0)
            sums = []
            for x in (np.where(known & (n == most[pair // ids_of_b]), many, 0), many * n):
                upto = np.append(0, np.cumsum(x))
                sums.append(pa.array(upto[edge[1:]] - upto[edge[:-1]]))
            left = np.append(0, np.cumsum(~known))[edge]
            rest = [pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pa.array(x[~known])) for x in (pair, many)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums, *rest], names=[*batch.schema.names[:-2], "n_best", "count_sum", "_pairs", "_many"])

    kept = [c for c in aligned.columns if c not in ("pairs", "many")]
    types = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    found = tables.save(aligned.mapInArrow(look_up, f"{types}, n_best bigint, count_sum bigint, _pairs array<bigint>, _many array<bigint>"), "found")
    rare = counts.where(F.col("level") < level).join(F.broadcast(best), F.expr(f"pair div {ids_of_b}") == F.col("a"))
    rest = found.select(row, F.explode(F.arrays_zip("_pairs", "_many")).alias("x")).select(row, F.col("x._pairs").alias("pair"), F.col("x._many").alias("many")).join(rare, "pair")
    rest = rest.groupBy(row).agg(F.sum(F.when(F.col("docs") == F.col("most"), F.col("many")).otherwise(0)).alias("_best"), F.sum(F.col("many") * F.col("docs")).alias("_sum"))
    full = found.join(rest, row, "left")
    out = full.select(*(c for c in kept if c != row), (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
    out = tables.save(out, "counted")
    tables.drop_all_but(out)
    sent.destroy()
    return out
