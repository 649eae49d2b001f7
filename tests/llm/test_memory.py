"""What Python workers hold: they live on from stage to stage, and their executor's memory is bounded."""

import tracemalloc

import pyarrow as pa
import pytest

from spanforge.llm import kernels, ngram_join, tokenize, toxicity


@pytest.mark.parametrize("work", [lambda c: ngram_join.token_sets(c, 5), toxicity.terms])
def test_other_work_drops_the_tokenizer(work):
    column = pa.array(["one two three four five six", None])
    before = list(tokenize.encoder(tokenize.default_path()).texts(column))[0][1].tolist()
    list(work(column))
    assert not tokenize._cache
    assert list(tokenize.encoder(tokenize.default_path()).texts(column))[0][1].tolist() == before


@pytest.mark.parametrize("work", [lambda c: ngram_join.token_sets(c, 5), toxicity.terms])
def test_blocks_of_many_texts_take_little_memory(work):
    column = pa.array([" ".join(f"w{i * k % 997}" for k in range(200)) for i in range(1, 4001)])  # about 3.5 MB
    kernels._powers.clear()
    tracemalloc.start()
    try:
        for _ in work(column):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20


def test_size_of_blocks_changes_no_set(monkeypatch):
    column = pa.array([" ".join(f"w{i * k % 97}" for k in range(i % 60)) for i in range(300)] + ["", None, "x " * 5000])
    whole = [(r, x.tolist()) for r, x in ngram_join.token_sets(column, 5)]
    for limit in (1, 1000, 1 << 20):
        monkeypatch.setattr(kernels.blocks, "__defaults__", (limit,))
        assert [(r, x.tolist()) for r, x in ngram_join.token_sets(column, 5)] == whole


def test_fit_starts_no_workers_for_its_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a vile word" if i % 3 == 0 else f"a word {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")

    def refused(*_, **__):
        raise AssertionError("a local list is a table by way of Python workers of another kind, which stay")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    model = toxicity.fit(docs, labels, hold_out=False)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in toxicity.score(docs, model).collect())
