"""Top-k search against all products, and phrases against counting in Python."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import phrases, topk

VECTORS = "vec_id long, embedding array<double>, label int"


def all_products(rows, wanted, k=5, scale=256.0):
    """(query_id, rank, vec_id, score) of every query, by looking at all rows."""
    own = []
    for i, x in rows:
        if x is None or any(v is None or not math.isfinite(v) or not math.isfinite(scale * v) for v in x):
            continue
        own.append((i, [math.floor(scale * v) for v in x]))
    out = []
    for n, (i, x) in enumerate(own):
        if i is None or not wanted(i):
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), j is None, j or 0, j) for m, (j, y) in enumerate(own) if m != n]
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, wanted, **settings):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], VECTORS).withColumn("norm", F.lit("x")).repartition(3)
    return sorted(map(tuple, topk.top_k(df, wanted, **settings).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("batch", [topk.BATCH, 4000])
def test_random_vectors_with_copies_and_ties(spark, monkeypatch, batch):
    monkeypatch.setattr(topk, "BATCH", batch)
    monkeypatch.setattr(topk, "HEAD", 40)
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * 0.3 * (1 + i % 4)).round(3).tolist()) for i in range(600)]
    rows += [(600 + i, rows[50][1]) for i in range(300)]  # a third are copies of one
    rows += [(50, rows[50][1]), (50, rows[3][1]), (None, rows[50][1])]
    assert found(spark, rows, F.col("id") % 50 == 0) == all_products(rows, lambda i: i % 50 == 0)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0, -0.004]), (50, []), (100, [1e12, -1e12, 3.0]), (150, [5.0]), (1, None), (2, [1.0, None, 1.0]), (3, [float("nan"), 1.0, 1.0]), (4, [1.0, float("inf"), 1.0])]
    rows += [(5, [1e200, 1.0, 1.0]), (6, [1e308, 1.0]), (7, [3e16 / 256, 1 / 256, 0.0]), (8, [2.0, 1.0, 0.0]), (200, [1.0, 1.0, 1.0]), (-50, [-1.0, -1.0, -1.0]), (None, [0.5, 0.5, 0.5])]
    assert found(spark, rows, F.col("id") % 50 == 0) == all_products(rows, lambda i: i % 50 == 0)
    assert found(spark, [(0, [1.0, 2.0])], F.col("id") % 50 == 0) == []
    assert found(spark, [], F.col("id") % 50 == 0) == []
    assert found(spark, [(0, []), (1, [])], F.col("id") % 50 == 0) == [(0, 1, 1, 0)]


def test_bounds_give_up_most_pairs():
    """Vectors of falling lengths in a few directions: nearly all pairs go before they are multiplied out."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 32)) * 0.97 ** np.arange(32) ** 2 * 256 / (1 + np.arange(4000)[:, None] / 200))
    x = x[np.argsort(-(x * x).sum(1))]
    s = topk.Search(5, np.arange(0, 4000, 50), x[::50], topk.rotation(x), np.full(80, topk.LEAST), np.full(80, topk.LAST))
    seen, plain = [], s._found
    s._found = lambda q, *a: (seen.append(len(q)), plain(q, *a))
    for at in range(0, 4000, 500):
        s.block(np.arange(at, at + 500), np.arange(at, at + 500), x[at : at + 500])
    assert sum(seen) < 0.05 * 80 * 4000
    whole = x[::50] @ x.T
    for i in range(80):
        want = sorted((-whole[i, j], j) for j in range(4000) if j != 50 * i)[:5]
        assert [(-float(v), int(j)) for v, j in zip(s.score[s.query == i], s.id[s.query == i], strict=True)] == want


def plain_phrases(rows, max_n=3, least=10, inside=50, top=2000):
    """Everything by its definition, in exact numbers."""
    f, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in wanted.items():
            holds = [q for q, b in wanted.items() if len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            score, k = min((math.floor(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            if not holds:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "top"), [(3, 3, 2000), (4, 2, 7), (2, 1, 50)])
def test_phrases_by_definition(spark, monkeypatch, max_n, least, top):
    monkeypatch.setattr(phrases, "BLOCK", 2000)
    rng = random.Random(3)
    vocabulary = ["New", "York", "city", "of", "the", "Ünïcode", "日本", "a b", "x_y", "(note)", "über", "\x00"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", ", ", ".  ", "\t", "\r\n"]).join(" ".join(rng.choices(vocabulary, weights=range(1, 13), k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    rows += [("en", "New York city hall " * 200), ("en", None), (None, ""), ("fr", "   .. ,"), ("en", "Z" * 5000 + " new york")] + [("de", "the same row twice over")] * 40
    df = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, n int").repartition(4)
    got = phrases.collocations(df, max_n=max_n, least=least, top=top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_phrases(rows, max_n, least, 50, top)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    with pytest.raises(ValueError, match="two words"):
        phrases.collocations(spark.createDataFrame([], "lang string, text string"), max_n=1)


def test_products_pass_64_bits(spark, monkeypatch):
    """Counts of some thousand millions, as a large corpus has them: scores stay exact."""
    word = spark.createDataFrame([("en", "a", 9_000_000_007), ("en", "b", 8_000_000_011)], "lang string, phrase string, f long")
    pair = spark.createDataFrame([("en", "a b", 7_999_999_999)], "lang string, phrase string, f long")
    total = spark.createDataFrame([("en", 10**12)], "lang string, n long")
    monkeypatch.setattr(phrases, "counted", lambda *a, **k: ([word, pair], total))
    r = phrases.collocations(word, max_n=2).first()
    assert r["score"] == 1000000 * 7_999_999_999**2 // (9_000_000_007 * 8_000_000_011)
