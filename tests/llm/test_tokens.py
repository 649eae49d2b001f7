"""Encoding, packing, token output and token counts against plain encoding and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import packing, token_counts, token_output
from spanforge.llm.tokenize import default_path, encoder

TEXTS = ["", " ", "The  cat\n sat.", "don't we'll \t x<|endoftext|> y", "日本 語 テ", "😀 😀a 😀", "a" * 300 + " b", "　 a 　b", "é è  ê  x", None, "hello world " * 2000]
SCHEMA = "doc_id long, text string, score string, items string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def plain(text):
    return [*encoder(default_path()).plain(text or ""), 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é.'1 \n\t　日😀ßs,", max_size=60), max_size=6))
def test_cached_encoding_is_plain_encoding(texts):
    e = encoder(default_path())
    for r, ids, step in e.texts(pa.array(texts, pa.string()), True):
        assert ids.tolist() == e.plain(texts[r]) and step.sum() == len(texts[r])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "ab", "é", "日", "<|", "|>", "endoftext", " x"]), max_size=12).map("".join), max_size=5))
def test_special_tokens_are_as_the_library_has_them(texts):
    from tokenizers import Tokenizer

    unaltered = Tokenizer.from_file(default_path())
    e = encoder(default_path())
    for r, ids, step in e.texts(pa.array([*texts, "<|endoftext|>"], pa.string()), True):
        text = [*texts, "<|endoftext|>"][r]
        assert ids.tolist() == unaltered.encode(text, add_special_tokens=False).ids and step.sum() == len(text)
    assert ids.tolist() == [50256]


def test_cache_survives_wrapping(monkeypatch):
    from spanforge.llm import tokenize

    monkeypatch.setattr(tokenize, "POOL", 64)
    e = tokenize.Encoder(default_path())
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(30)) for _ in range(40)]
    for t in texts * 2:
        assert next(e.texts(pa.array([t])))[1].tolist() == e.plain(t)


def test_best_fit_places_in_fullest_open_bin():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert b.place(8) == (2, 0)
    assert b.place(9) == (3, 0)  # the fullest, of 8, closes
    assert b.place(2) == (0, 6)


@pytest.mark.parametrize("n", [1, 2048, 2049, 4096, 5000])
def test_pieces_cover_and_only_first_is_short(n):
    p = packing.pieces(n, 2048)
    assert [s for s, _ in p] == [sum(k for _, k in p[:i]) for i in range(len(p))] and sum(k for _, k in p) == n
    assert all(k == 2048 for _, k in p[1:])


def check_packing(rows, found):
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain(t))
    per_doc, per_sequence = {}, {}
    for r in found:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(per_doc) == set(want)
    for i, pieces in per_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            for p in pieces:
                assert crc(want[i][0][p.start : p.start + p.length]) == p.ids_crc32
    for pieces in per_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(per_sequence)


def test_packing(spark):
    rows = [*enumerate(TEXTS), (None, "null id"), (2, TEXTS[2])]
    check_packing(rows, packing.pack(docs(spark, rows)).collect())
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_is_near_the_least(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randint(1, 1500)) for i in range(400)]
    n = check_packing(rows, packing.pack(docs(spark, rows).coalesce(1)).collect())
    assert n <= 1.05 * -(-sum(len(plain(t)) for _, t in rows) // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**31))
def test_bit_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    raw = token_output.pack_bits(ids, bits)
    assert len(raw) == -(-n // 64) * 8 * bits and (token_output.unpack_bits(raw, bits, n) == ids).all()


def test_bits_for():
    assert [token_output.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "x.fwt")
    rnd = np.random.default_rng(3)
    parts = [rnd.integers(0, 1000, n, dtype=np.uint64).astype(np.uint32) for n in (0, 5, 200, 1, 900)]
    with store.open_output_stream(path) as sink:
        w = token_output.Writer(sink, 10, 64)
        for i, p in enumerate(parts):
            w.add(None if i == 1 else i, p)
        w.close()
    with store.open_input_file(path) as source:
        r = token_output.Reader(source)
        every = np.concatenate(parts)
        for a, b in ((0, 0), (3, 70), (64, 128), (600, len(every))):
            assert (r.ids(a, b) == every[a:b]).all()
        assert [(n, len(x)) for n, _, x in r.documents()] == [(0, 0), (None, 5), (2, 200), (3, 1), (4, 900)]


def test_token_output(spark):
    rows = [*enumerate(TEXTS), (None, "null id"), (7, "again"), (7, "again")]
    found = token_output.read(token_output.write(docs(spark, rows).repartition(3))).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert sorted(r.ids_crc32 for r in found) == sorted(crc(plain(t)) for _, t in rows)
    assert token_output.read(token_output.write(docs(spark, []))).count() == 0


def test_packing_does_not_depend_on_the_split(spark):
    rnd = random.Random(6)
    rows = [(i, "word " * rnd.randint(50, 900)) for i in range(400)]
    n = check_packing(rows, packing.pack(docs(spark, rows).repartition(100)).collect())
    assert n <= 1.05 * -(-sum(len(plain(t)) for _, t in rows) // 2048)


def test_packing_of_64_partitions_and_other_ids(spark):
    rnd = random.Random(16)
    rows = [(f"d{i}", "word " * int(rnd.lognormvariate(5, 1))) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(64)
    found = packing.pack(table)
    got = found.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, found.collect())), "the same in each evaluation"
    assert check_packing(rows, got) <= 1.02 * -(-sum(len(plain(t)) for _, t in rows) // 2048) + 1


def test_ids_out_of_range_are_errors(spark):
    with pytest.raises(ValueError):
        token_output.pack_bits(np.array([70000], np.uint32), 16)
    with pytest.raises(ValueError):
        token_output.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert token_output.vocabulary_of(default_path()) == 50257


def test_files_of_lost_attempts_go(spark, tmp_path):
    (tmp_path / "part-000000-w1-lost.fwt").write_bytes(b"x")
    manifest = token_output.write(docs(spark, [(1, "a b"), (2, None)]), folder=str(tmp_path), write_id="w1")
    assert {p.name for p in tmp_path.iterdir() if p.name.endswith(".fwt")} == {r.path.rsplit("/", 1)[1] for r in manifest.collect()}
    assert token_output.read(manifest).count() == 2


def test_packing_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_TOKENS", 20_000)
    rows = [(i, "word " * (i * 37 % 900)) for i in range(200)]
    found = packing.pack(docs(spark, rows).repartition(50)).collect()
    n = check_packing(rows, found)
    assert len({r.sequence_id >> 36 for r in found}) == sum(len(plain(t)) for _, t in rows) // 20_000
    assert n <= 1.15 * -(-sum(len(plain(t)) for _, t in rows) // 2048)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_by_brute_force(rule):
    rnd = random.Random(5)
    e = encoder(default_path())
    for _ in range(60):
        text = "".join(rnd.choice("ab é.\n \t日😀") for _ in range(rnd.randint(0, 40)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 4)))
        sections = list(zip(cuts[::2], cuts[1::2], strict=False))
        spans = e.tokenizer.encode(text, add_special_tokens=False).offsets
        ((_, _, step),) = e.texts(pa.array([text]), True)
        counts, none, crossing = token_counts.attribute(step, np.array([a for a, _ in sections], np.int64), np.array([b for _, b in sections], np.int64), rule)
        assert counts.sum() + none == len(spans)
        want, crossed, at = [0] * (len(sections) + 1), 0, 0
        for n in step.tolist():  # a token's characters one by one; one that completes none counts at the next character
            held = [next((k for k, (a, b) in enumerate(sections) if a <= c < b), len(sections)) for c in range(at, at + max(n, 1))]
            at += n
            crossed += held[0] != held[-1]
            shares = [held.count(k) for k in range(len(sections) + 1)]
            inside = shares[:-1]
            most = held[0] if held[0] == held[-1] or not inside else (inside.index(max(inside)) if max(inside) >= shares[-1] else len(sections))
            want[{"first": held[0], "last": held[-1], "most": most}[rule]] += 1
        assert (counts.tolist() + [none], crossing) == (want, crossed)


def test_most_goes_to_the_larger_share_and_the_earlier():
    attribute = token_counts.attribute
    assert attribute(np.array([4]), np.array([0, 1]), np.array([1, 4]), "most")[0].tolist() == [0, 1]
    assert attribute(np.array([4]), np.array([0, 2]), np.array([2, 4]), "most")[0].tolist() == [1, 0]
    assert attribute(np.array([4]), np.array([3]), np.array([4]), "most")[:2][1] == 1


def test_token_counts(spark):
    rows = [*enumerate(TEXTS), (0, "dup"), (None, "x\ny")]
    found = token_counts.count(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_tokens == sum(s.n_tokens for s in r.sections)
    by = {r.doc_id: r for r in found if r.doc_id not in (0,)}
    assert [s.n_tokens for s in by[None].sections] == [2, 1] and [(s.begin, s.end) for s in by[None].sections] == [(0, 2), (2, 3)]
    assert token_counts.count(docs(spark, [])).count() == 0


def test_fields_as_sections(spark):
    df = spark.createDataFrame([(1, "Title here", None, "Body text.")], "doc_id long, title string, note string, body string")
    joined = token_counts.from_fields(df, ["title", "note", "body"])
    (r,) = token_counts.count(joined, sections_col="sections").collect()
    assert {s.section: s.n_tokens for s in r.sections if s.section} == {"title": 2, "note": 0, "body": 3}
    assert token_counts.per_section(token_counts.count(joined, sections_col="sections")).count() == len(r.sections)


def test_writes_to_one_folder_leave_each_other(spark, tmp_path):
    """A second write to the same folder deletes nothing of the first."""
    from spanforge.llm import kernels

    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    first = token_output.write(docs, folder=str(tmp_path / "t"))
    second = token_output.write(docs.where("doc_id < 5"), folder=str(tmp_path / "t"))
    assert token_output.read(first).count() == 20 and token_output.read(second).count() == 5
    assert kernels.SCHEMES["s3a"] == "s3" and kernels.filesystem("file:/a/b")[1] == "/a/b"
