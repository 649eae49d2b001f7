"""The n-gram Jaccard join, WARC archives and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import kernels, ngram_join, warc
from spanforge.llm.kernels import Tables, fresh

SCHEMA = "doc_id long, text string, node string, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def brute_groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, size=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO"), (1004, " \n")]
    for i in range(size):
        base = [word() for _ in range(rnd.choice([5, 30, 90, 350]))] + (passage if rnd.random() < 0.4 else [])
        for k in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.randint(0, 4) if k else 0):
                w[rnd.randrange(len(w))] = word()
            rows.append((10 * i + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "bounds"), [(1, {}), (2, {"frequent": 2}), (3, {"frequent": 4}), (5, {"map_bits": 6, "frequent": 8})])
def test_join_by_brute_force(spark, seed, bounds):
    rows = corpus(seed)
    found = ngram_join.groups(docs(spark, rows), words=4, percent=85, **bounds)
    assert sorted(map(tuple, found.collect())) == brute_groups(rows, 4, 85)


def test_join_bounds_never_decide(spark, monkeypatch):
    rows = corpus(5)
    for name, value in (("SEEN", 1), ("NODE_BITS", 15), ("LOCAL_EDGES", 0), ("FREQUENT_TOKENS", 3), ("TASK_TOKENS", 50), ("GROUP_TOKENS", 100)):
        monkeypatch.setattr(ngram_join, name, value)
    found = ngram_join.groups(docs(spark, rows), words=5, percent=80, frequent=3)
    assert sorted(map(tuple, found.collect())) == brute_groups(rows, 5, 80)


@pytest.mark.parametrize("rest", [-1, 10**9])
def test_join_of_near_copies(spark, monkeypatch, rest):
    """A large group of near copies about the threshold, with more stars and with none after the first."""
    monkeypatch.setattr(ngram_join, "REST_PAIRS", rest)
    rnd = random.Random(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, ngram_join.groups(docs(spark, rows), words=4, percent=85, frequent=20).collect())) == brute_groups(rows, 4, 85)


def test_join_of_long_texts(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage, rows = [word() for _ in range(3000)], []
    for i in range(12):
        w = [word() for _ in range(6000)] + passage
        rows.append((2 * i, " ".join(w)))
        for _ in range(150 if i % 2 else 60):
            w[rnd.randrange(len(w))] = word()
        rows.append((2 * i + 1, " ".join(w)))
    assert sorted(map(tuple, ngram_join.groups(docs(spark, rows), words=4, percent=85, frequent=5).collect())) == brute_groups(rows, 4, 85)


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 100, 127, 128, 1000])
def test_index_meets_all_linked_sets(size):
    """Sets just at the threshold share an entry, whatever the classes of their tokens."""
    rnd = np.random.default_rng(size)
    for percent in (80, 85, 100):
        for frequent in (0.0, 0.5, 1.0):
            for _ in range(20):
                x = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
                keep = -(-percent * len(x) // 100)
                new = int(keep * 100 / percent) - keep if rnd.random() < 0.5 else 0
                y = np.unique(np.concatenate([rnd.permutation(x)[: keep + (len(x) - keep if new else 0)], rnd.integers(0, 2**63, new if new else 0).astype(np.uint64)]))
                both = len(np.intersect1d(x, y))
                if both == len(x) == len(y) or 100 * both < percent * (len(x) + len(y) - both):
                    continue  # equal sets are one node
                often = np.sort(np.union1d(x, y)[rnd.random(len(np.union1d(x, y))) < frequent])
                order = ngram_join.Order(np.full(1024, 255, np.uint8), often & ngram_join._LOW, 1, 8192)
                a, b = ngram_join.entries(x, order, percent)[0], ngram_join.entries(y, order, percent)[0]
                assert len(np.intersect1d(a, b)), (size, percent, frequent)


def test_join_edges(spark):
    assert ngram_join.groups(docs(spark, [])).count() == 0
    assert sorted(tuple(r) for r in ngram_join.groups(docs(spark, [(3, None), (4, "")])).collect()) == [(3, 0, 3), (4, 0, 4)]
    same = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f")]
    assert {r.component_id for r in ngram_join.groups(docs(spark, same)).collect()} == {7}
    with pytest.raises(ValueError):
        ngram_join.groups(docs(spark, same), percent=40)


def test_one_row_of_each_component(spark):
    text = "a b c d e f g h"
    rows = [(7, text), (7, text), (9, text.upper()), (None, text), (5, "one two three four five six"), (5, "p q r s t u v"), (6, "P q r s t u v"), (4, None), (4, None), (8, " "), (None, "z y x w v")]
    d = docs(spark, rows).selectExpr("*", "1 as key", "2 as stays", "3 as many", "array(4) as bucket")
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, text), (5, "one two three four five six"), (5, "p q r s t u v"), (4, None), (4, None), (8, " "), (None, "z y x w v")], key=str)
    words = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert [r.doc_id for r in ngram_join.one_of_each(words).collect()] == ["a"]


def test_tables_of_a_join_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(kernels, "shared_dir", lambda _: f"file://{tmp_path}")
    found = ngram_join.groups(docs(spark, corpus(1, 5)))
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"digests", "components"} and found.count()


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    name = lambda i: i.to_bytes(16, "big")
    table = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    found = {bytes(r.node): bytes(r.label) for r in ngram_join.components(table, Tables(spark), local).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert found == {name(i): name(find(i)) for e in edges if e[0] != e[1] for i in e}


MAGIC = "WARC/1.0\r\n"
FAKE = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", "<p>x</p>"), (6, "u", "pre " + FAKE * 3 + " post " + MAGIC), (7, "u", big + "z"), (8, "u", big), (None, "u", "n"), (9, "u", "\r\n\r\n" + MAGIC)]
    found = {r.page_id: r for r in warc.read(spark, warc.write(pages(spark, rows).coalesce(2))).collect()}
    assert set(found) == {r[0] for r in rows}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()), i
        assert found[i].verified
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {2: 8, 3: 8}
    assert warc.read(spark, warc.write(pages(spark, []))).count() == 0


def test_chain_over_small_splits_and_blocks(spark):
    rnd = random.Random(8)
    rows = [(i, "u", "".join(rnd.choice(["ab", MAGIC, "\r\n\r\n", FAKE, "WARC/1.0\r", "é"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    folder = warc.write(pages(spark, rows).coalesce(1), fresh(spark, "w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.candidates(spark, folder)
        kept = warc.reached(found, block=512)
        assert kept.count() == len(rows) < found.count()
        got = {r.page_id: r.payload_digest for r in warc.read(spark, folder).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


def test_payloads_with_magic_when_splits_change(spark, monkeypatch):
    """The pieces of a record are read again under other splits than at first."""
    rnd = random.Random(18)
    rows = [(i, "u", "".join(rnd.choice(["ab", MAGIC, FAKE, f"x{i}", "é"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    folder = warc.write(pages(spark, rows).coalesce(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    joined = warc._joined

    def later(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
        return joined(*args)

    monkeypatch.setattr(warc, "_joined", later)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.page_id: (r.payload_digest, r.verified) for r in warc.read(spark, folder).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (hashlib.sha1(h.encode()).hexdigest(), True) for i, _, h in rows}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = text(15)
    rows = [(i, text(60) + (" vermin scum" if i % 10 == 3 else "")) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " tail"), (302, text(20) + " " + bench), (303, "mail a.b@x.example.com " + text(40)), (304, None), (305, "")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toxic = {i for i in range(200) if i % 10 == 3}
    after = d
    for (_, stage), gone in zip(p.STAGES[:4], (toxic, {300, 301}, {302}, set()), strict=True):
        ids = {r.doc_id for r in after.collect()}
        after = stage(spark, after, str(tmp_path))
        assert ids - {r.doc_id for r in after.collect()} == gone and after.columns == d.columns
    assert "a.b@x.example.com" not in after.where("doc_id = 303").first().text
    found = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {r[0] for r in rows} - toxic - {300, 301, 302}
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_keeps_other_columns(spark, tmp_path):
    """Columns named like the operators' results and helpers pass through; n_chars may be absent; doc_ids may repeat."""
    import corpus_pipeline as p

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (1, "a text of its own " + " ".join(f"v{i}" for i in range(30))), (2, text.upper()), (3, "mail a.b@x.example.com here"), (4, None)]
    names = ("score", "predicted", "n_values", "items", "spans", "n_hit", "n_words", "_text", "_marks", "label", "node", "key", "_id")
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'own' as {n}" for n in names))
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in any of them at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after = d
    for _, stage in p.STAGES[:4]:
        after = stage(spark, after, str(tmp_path))
        assert after.columns == d.columns
    found = after.collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 3, 4] and all(r[n] == "own" for r in found for n in names)
    assert p.STAGES[4][1](spark, after, str(tmp_path)).count() == 4


def brute_pipeline(rows, toxic, items):
    """What stays after each of the first three stages, by plain loops."""
    kept = [(i, t) for i, t in rows if i not in toxic]
    groups = {}
    for i, _, c in brute_groups(kept, 5, 80):
        groups.setdefault(c, []).append(i)
    empty = {i for i, n, _ in brute_groups(kept, 5, 80) if not n}
    once = [(i, t) for i, t in kept if i in empty or i in groups]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(words(t)[k : k + len(g)]) == g for g in grams for k in range(len(words(t))))
    return [{i for i, _ in kept}, {i for i, _ in once}, {i for i, t in once if not hit(t)}]


def test_pipeline_by_brute_force(spark, tmp_path):
    import zlib

    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from spanforge.llm import pii, tokenize, toxicity

    rnd = random.Random(19)
    items = [" ".join(f"q{rnd.randrange(50)}" for _ in range(14)) for _ in range(5)]
    rows = [r for r in corpus(8, 30) if r[0] < 1000]
    rows += [(2000 + i, t + " " + " ".join(items[i % 5].split()[:n])) for i, ((_, t), n) in enumerate(zip(rows[:12], [14, 10, 9, 12] * 3, strict=True))]
    rows += [(3000 + i, f"vermin scum {i} " + rows[i][1]) for i in range(40)] + [(4000, "card 4111 1111 1111 1111 on 2020-01-02 " + rows[3][1]), (4001, None), (4002, "")]
    labels = [(i, int(i // 1000 == 3)) for i, _ in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.fit(d, spark.read.parquet(f"{tmp_path}/labels.parquet"), hold_out=False)
    toxic = {r.doc_id for r in toxicity.score(d, model).collect() if r.score >= 0.5}
    assert toxic == {3000 + i for i in range(40)}
    after, work = d, pii.Pseudonyms(p.KEY.encode())
    for (_, stage), want in zip(p.STAGES[:3], brute_pipeline(rows, toxic, items), strict=True):
        after = stage(spark, after, str(tmp_path))
        assert {r.doc_id for r in after.collect()} == want
    texts = {i: None if t is None else work.replace(t) for i, t in rows if i in want}
    assert {r.doc_id: r.text for r in p.STAGES[3][1](spark, after, str(tmp_path)).collect()} == texts
    tokenizer = Tokenizer.from_file(tokenize.default_path())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    found, at = p.run(spark, str(tmp_path)).collect(), {}
    assert {r.doc_id for r in found} == set(ids)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        at[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in found) == sum(map(len, ids.values()))


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
