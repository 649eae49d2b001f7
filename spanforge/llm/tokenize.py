"""Exact, cached byte-level BPE encoding of whole texts.

The tokenizer's pre-tokenizer never lets a piece run from a non-space character into a
following space, so a text may be cut before every space that follows a non-space
character, and the ids of the parts joined are the ids of the whole. A special token in a
text is one id, as the library gives it: none holds a space after another character, so no
cut splits one, and a part with one is encoded like any other. Each distinct part
is encoded once by the tokenizers library and kept in a direct-mapped cache of fixed
size; a repeated part then costs a vectorised lookup. Parts longer than ``LONG`` bytes
are encoded directly. A test holds the result against plain encoding of whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spanforge.llm import kernels as K

END_ID = 0
SLOT_BITS = 21
POOL = 6 << 20
LONG = 48

_cache: dict[str, Encoder] = {}
K.caches.append(_cache)


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file."""
    if path not in _cache:
        _cache.clear()
        _cache[path] = Encoder(path)
    return _cache[path]


def default_path() -> str:
    """The public byte-level vocabulary of this environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_of(path: str) -> int:
    """The number of ids of a tokenizer file, special ones included: one more than the greatest."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1


def _begun(spans: list[tuple[int, int]]) -> np.ndarray:
    """Characters counted at each token: those whose last byte it holds. They sum to the text's length."""
    n = len(spans)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.fromiter((x for x, _ in spans), np.int64, n)
    end = np.fromiter((y for _, y in spans), np.int64, n)
    done = np.append(np.minimum(end[:-1], begin[1:]), end[-1:])
    return np.diff(done, prepend=0)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tag = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.many = np.zeros(1 << SLOT_BITS, np.int32)
        self.pool = np.zeros(POOL, np.uint32)
        self.chars = np.zeros(POOL, np.int32)
        self.used = 0

    def plain(self, text: str) -> list[int]:
        """The ids as the library gives them for the text in one piece."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _parts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts, and the index of each document's first part (with the total).

        A cut needs a character before the space that is surely not white space: a
        visible ASCII one, or a two-byte letter from U+00C0 to U+02BF.
        """
        n = len(buf)
        sure = (buf > 0x20) & (buf < 0x7F)
        sure[1:] |= (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xCA)
        cut = np.zeros(n, bool)
        cut[1:] = (buf[1:] == 0x20) & sure[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, ...]:
        """ids, characters, and each part's place and number in them; ``joint`` parts first, many of them in one call."""
        n = len(starts)
        at, many, ids, chars, used = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], 0
        groups = [joint[k : k + 4000] for k in range(0, len(joint), 4000)]
        for some in groups + [np.array([j]) for j in np.setdiff1d(np.arange(n), joint, assume_unique=True)]:
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            e = self.tokenizer.encode("".join(parts), add_special_tokens=False)
            spans = e.offsets
            edge = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=edge[1:])
            edge = np.searchsorted(np.fromiter((x for x, _ in spans), np.int64, len(spans)), edge)
            edge[-1] = len(spans)
            ids.append(np.array(e.ids, np.uint32))
            chars.append(_begun(spans).astype(np.int32))
            at[some], many[some] = used + edge[:-1], np.diff(edge)
            used += len(spans)
        return np.concatenate(ids), np.concatenate(chars), at, many

    def block(self, buf: np.ndarray, offsets: np.ndarray, chars: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """All ids of a block of documents, each document's first place in them (with the total), and with ``chars``
        the number of characters that end in each token."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int32) if chars else None
        starts, ends, first = self._parts(buf, offsets)
        h = K.hash_ranges(buf, starts, ends) | np.uint64(1)
        short = (buf[starts] == 0x20) & (ends - starts <= LONG)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, many = self.at[slot].astype(np.int64), self.many[slot].astype(np.int64)
        pool, step = self.pool, self.chars
        missing = np.flatnonzero(~((self.tag[slot] == h) & short))
        if len(missing):
            # a part that no other may be joined to is told from a joinable one of the same bytes
            distinct, back = np.unique(np.where(short, h, ~h)[missing], return_index=True, return_inverse=True)[1:]
            pick = missing[distinct]
            joint = np.flatnonzero(short[pick])
            ids, begun, p, m = self._encode(buf.tobytes(), starts[pick], ends[pick], joint)
            fits = self.used + len(ids) <= POOL
            if fits:
                base = self.used
                self.pool[base : base + len(ids)], self.chars[base : base + len(ids)] = ids, begun
                self.used += len(ids)
            else:  # what is known is still read from the old pool, which is emptied afterwards
                base = POOL
                pool, step = np.concatenate([pool, ids]), np.concatenate([step, begun])
            at[missing], many[missing] = base + p[back], m[back]
            if fits:
                s = slot[pick[joint]]
                self.at[s], self.many[s], self.tag[s] = base + p[joint], m[joint], h[pick[joint]]
            else:
                self.used = 0
                self.tag[:] = 0
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(many, out=before[1:])
        take = np.arange(before[-1]) + np.repeat(at - before[:-1], many)
        return pool[take], before[first], step[take] if chars else None

    def texts(self, column: pa.Array, chars: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(row, ids, characters that end in each) for each text of an Arrow column; a null text is empty."""
        for i, j, buf, offsets in K.blocks(column):
            ids, first, step = self.block(buf, offsets, chars)
            for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), i):
                yield r, ids[a:b], step[a:b] if chars else None
        K.release_large(give_back=False)
