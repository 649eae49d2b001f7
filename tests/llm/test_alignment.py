"""Cross-tokenizer alignment against a version token by token, and its special cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import alignment


@pytest.fixture(scope="module")
def sides():
    return alignment.Sides(*alignment.default_paths())


def plain(text, sides):
    """Groups and links of one text by going through its bytes: whole encoding, no parts."""
    if not text:
        return None
    a = sides.a.encode(" " + text, add_special_tokens=False).ids
    b = sides.b.encode(text)
    own, other = ([bytes(of.joined(np.array([i]))) for i in ids] for of, ids in ((sides.of_a, a), (sides.of_b, b)))
    if b"".join(own) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
        return None
    at_a = [i for i, t in enumerate(own) for _ in t]
    at_b = [i for i, t in enumerate(other) for _ in t]
    links = sorted(set(zip(at_a, at_b, strict=True)))
    groups, x, y = [], 0, 0
    for i in range(len(at_a)):
        if i + 1 == len(at_a) or (at_a[i + 1] != at_a[i] and at_b[i + 1] != at_b[i]):
            groups.append((a[x : at_a[i] + 1], b[y : at_b[i] + 1]))
            x, y = at_a[i] + 1, at_b[i] + 1
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def expected(rows, sides):
    """All result columns by doc_id, from whole encodings."""
    found = {i: plain(t, sides) for i, t in rows}
    docs = Counter(p for f in found.values() if f for p in set(f[3]))
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = {}
    for i, f in found.items():
        if not f:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[i] = (len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), text)
    return out


TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "tab\tand\nline\r\n  end \n", "Grüße aus Köln — naïve café ÆØÅ", "日本語のテキスト と 中文", "emoji 👍🏽 family 👨‍👩‍👧 ok",
    "<|endoftext|> is text, </s> and <unk> and <0x41> too", "under▁score ▁ here", "é ﬁ  nbsp　wide", "\x00\x01 control", "x" * 3000, "word " * 2000, "1234567890 12.5% $3,000.00 --- === ::: 'tis don't I'LL", "ends in blanks   ", "▁",
    "word " * 2000, "the cat sat on the mat and the dog sat on the log", "the cat sat on the mat", "antidisestablishmentarianism pneumonoultramicroscopic",
]


@pytest.mark.parametrize("head", [alignment.HEAD, 7, 0])
def test_by_whole_encodings(spark, sides, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, _row int").repartition(3)
    got = alignment.with_counts(df)
    assert "_own_n_a" in got.columns
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in got.collect()}
    assert got == expected([(i, t) for i, t, *_ in rows], sides)


def test_the_table(spark, sides):
    from spanforge.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op13_alignment(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for i, r in expected(rows, sides).items()}
    assert got == want


def test_parts_are_forgotten_and_texts_of_other_vocabularies_stay_whole(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "PARTS", 3)
    monkeypatch.setattr(alignment, "BLOCK", 64)
    want = expected(list(enumerate(TEXTS)), sides)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    for r in alignment.align(df).collect():
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (*want[r["doc_id"]][:4], want[r["doc_id"]][6])
        assert sum(r["many"]) == r["n_links"] and r["pairs"] == sorted(set(r["pairs"]))
    whole = alignment.Sides(*alignment.default_paths())
    whole.cuts = False
    texts = [t for t in TEXTS if t]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    fine, parts = whole.block(buf, np.append(0, np.cumsum([len(x) for x in raw])))
    for t, good, p in zip(texts, fine, parts, strict=True):
        f = plain(t, sides)
        assert good == (f is not None) and len(p) == 1
        if good:
            assert whole.facts[p[0], 1:].tolist() == [len(f[0]), len(f[1]), len(f[2]), len(f[3])]


def test_intervals_and_products():
    ends, own, other, shared = alignment.intervals(np.array([2, 5, 9]), np.array([3, 5, 7, 9]))
    assert ends.tolist() == [2, 3, 5, 7, 9] and own.tolist() == [0, 1, 1, 2, 2] and other.tolist() == [0, 0, 1, 2, 3] and shared.tolist() == [False, False, True, False, True]
    own, other = alignment.products(np.array([2, 1]), np.array([2, 2]))
    assert list(zip(own.tolist(), other.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]


def test_product_of_groups(spark, sides):
    text = "pneumonoultramicroscopic naïve日本 x"
    r = alignment.align(spark.createDataFrame([(text,)], "text string"), product=True).first()
    _, _, groups, _ = plain(text, sides)
    want = Counter((x, y) for a, b in groups for x in a for y in b)
    assert {divmod(p, sides.of_b.size): n for p, n in zip(r["pairs"], r["many"], strict=True)} == want and r["n_links"] == sum(want.values())


def test_an_empty_table(spark):
    assert alignment.with_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
