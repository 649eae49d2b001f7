"""Detection, resolution, masking and evaluation: known results, parity with Python's re, and edge cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.config import COMMON_WORDS, Config, MaskingMode
from spanforge.functions import checksums
from spanforge.functions.regex import scan
from spanforge.operators import detectors, evaluate, masking, ocr, patterns, relational, resolver, rules
from spanforge.operators.chunks import skips_models, windows
from spanforge.plans import rpc
from spanforge.plans.engine import Engine, quantiles_of

PLAIN = Config(opf_enabled=False, gliner_enabled=False)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, PLAIN)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def column(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "good", "bad"),
    [
        (checksums.valid_fiscal_code, "RSSMRA80A01L219M", "RSSMRA80A01L219X"),
        (checksums.valid_vat_number, "01114601006", "01114601007"),
        (checksums.valid_iban, "IT60X0542811101000000123456", "IT61X0542811101000000123456"),
    ],
)
def test_checksums(spark, f, good, bad):
    assert [column(spark, f, v) for v in (good, good.lower(), bad, "", "x", None)] == [True, True, False, False, False, None]


KNOWN = [
    ("CF RSSMRA80A01L219X", "CF [CF_1]"),
    ("email mario.rossi@example.com", "email [EMAIL_1]"),
    ("a@b.it, c@d.it", "[EMAIL_1]"),
    ("P.IVA 01114601006", "P.IVA [PIVA_1]"),
    ("P.IVA IT 01234567890", "P.IVA IT [TEL_1]"),
    ("340\n1234567", "[TEL_1]\n[TEL_2]"),
    ("😀 a@b.it IP 8.8.8.8 300.1.1.1", "😀 [EMAIL_1] IP [IP_1] 300.1.1.1"),
    ("Tessera 80380030001234567890 matricola INPS 12345678.", "Tessera [TS_1] matricola INPS [MATRICOLA_1]."),
    ("doc ID-ABCDEF e via Roma 12, fine", "doc [DOCUMENTO_ID_1] e [INDIRIZZO_1], fine"),
    ("x@pec.pec.it poi X@PEC.pec.it e y@z.it", "[PEC_1] poi [PEC_1] e [EMAIL_1]"),
    ("", ""),
    ("niente", "niente"),
    (None, None),
]


def test_known_maskings(spark, engine):
    found = engine.analyze(texts(spark, *(t for t, _ in KNOWN))).orderBy("id").collect()
    assert [r.masked_text for r in found] == [m for _, m in KNOWN]
    assert found[-1].spans == [] and found[0].counts == {"CODICE_FISCALE": 1}


@pytest.mark.parametrize("mode", list(MaskingMode))
def test_modes_and_vault(spark, mode):
    df = Engine(spark, Config(opf_enabled=False, gliner_enabled=False, masking_mode=mode)).analyze(texts(spark, "a@b.it oppure A@B.it tel 3401234567"))
    r = df.select("masked_text", masking.vault(F.col("replacements")).alias("v"), masking.restored(F.col("masked_text"), masking.vault(F.col("replacements"))).alias("back"), masking.entity_map(F.col("replacements")).alias("m")).first()
    first, third = {"replace": ("[EMAIL_1]", "[TEL_1]"), "redact": ("██████", "██████████"), "generalize": ("[EMAIL]", "[TEL]"), "hash": (None, None)}[mode.value]
    if first:
        assert r.masked_text == f"{first} oppure {first} tel {third}"
    assert set(r.v) == {e.placeholder for e in r.m}
    with pytest.raises(ValueError):
        Config(masking_mode="other")


def test_restore_round_trip(engine):
    row = engine.analyze_text("Mario Rossi, CF RSSMRA80A01L219M, tel 3401234567")
    from spanforge.cli import restore

    assert restore(row["masked_text"], {r["replacement"]: {"original": r["original"]} for r in row["replacements"]}) == row["text"]


PYTHON = {r.label: r for r in rules.RULES}


def python_pattern(p):
    flags = re.I if "i" in p[2 : p.index(")")] else 0
    return re.compile(p[p.index(")") + 1 :], flags)


def test_offsets_equal_python(spark):
    rnd = random.Random(1)
    parts = ["RSSMRA80A01L219M", "a.b@c.it", "1.2.3.4", "340 123 4567", "011-1234567", " ", "\n", "é", "😀", "via Roma 12 int. 3", "AB 123 CD", "ID-ABC123", "P.IVA 01114601006", "inps: 12345678", "80380030001234567890", "ß", ",", "٣"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    df = texts(spark, *values)
    for rule in rules.RULES:
        rx = python_pattern(rule.pattern)
        got = {r.id: [(m.start, m.end) for m in r.m] for r in df.select("id", scan(F.col("text"), rule.pattern, rule.group).alias("m")).collect()}
        for i, t in enumerate(values):
            assert got[i] == [m.span(rule.group) for m in rx.finditer(t)], (rule.label, t)


def test_flat_address_pattern_equals_the_nested_one():
    words = r"\b(?:via|viale|piazza|piazzale|corso|largo|vicolo|lungarno|borgo|contrada|strada)"
    nested = re.compile(words + r"(?:[ \t]+[\w'.]+)+[ \t]+\d+(?:[ \t]+(?:int\.?[ \t]*[\w/]+|scala[ \t]+\w+|piano[ \t]+\d+))?", re.I)
    flat, rnd = python_pattern(rules.ADDRESS), random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice(["via", " ", "\t", "Roma", "12", "d'", ".", ",", "\n", "int", "scala", "x"]) for _ in range(rnd.randint(0, 16)))
        assert [m.span() for m in flat.finditer(t)] == [m.span() for m in nested.finditer(t)], t


def test_long_lines_do_not_overflow(engine):
    assert engine.process_text("via " + "parola " * 30000 + "12")[1] == {"INDIRIZZO": 1}


def spans(spark, text, *values):
    df = texts(spark, text)
    made = F.array(*(patterns.span(F.lit(a), F.lit(b), label, source, score, i) for i, (a, b, label, source, score) in enumerate(values)))
    return df.withColumn("raw", made)


def resolved(df):
    return [(s.start, s.end, s.label, s.source) for s in resolver.resolve(df, "raw").first().spans]


def test_resolution(spark):
    both = spans(spark, "Luca Bianchi,luca@mail.it,Mouse", (0, 13, "PERSONA", "opf", 0.9), (13, 25, "EMAIL", "pattern", 1.0), (26, 31, "PERSONA", "gliner", 0.5))
    assert resolved(both) == [(0, 12, "PERSONA", "opf"), (13, 25, "EMAIL", "pattern")]
    assert resolved(spans(spark, ", ;", (0, 3, "PERSONA", "opf", 1.0))) == []
    over = spans(spark, "x" * 30, (0, 10, "A", "gliner", 1.0), (5, 8, "B", "pattern", 1.0), (8, 20, "C", "opf", 1.0))
    assert resolved(over) == [(5, 8, "B", "pattern"), (8, 20, "C", "opf")]
    tie = spans(spark, "x" * 9, (0, 5, "A", "opf", 1.0), (0, 5, "B", "opf", 1.0))
    assert resolved(tie) == [(0, 5, "A", "opf")]


def test_folds_equal_windows(spark):
    rnd = random.Random(3)
    rows = [(d, a, a + rnd.randint(1, 9), rnd.choice(["CELL_IT", "TEL_IT", "EMAIL"]), rnd.choice(["opf", "gliner", "pattern"]), rnd.choice([0.5, 1.0]), i) for d in range(60) for i, a in enumerate(sorted(rnd.randrange(40) for _ in range(6)))]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, label string, source string, score double, ord int")
    made = F.struct("start", "end", "label", "source", "score", "ord", F.lit(None).cast("string").alias("checksum_valid")).cast(patterns.SPAN)
    folds = df.groupBy("doc_id").agg(F.collect_list(made).alias("raw")).withColumn("o", resolver.canonical(F.col("raw"))).select("doc_id", F.explode(resolver.merge_adjacent(F.lit(" " * 99), F.col("o"))).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.source", "s.score")
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, relational.islands(df).collect()))


def test_misreadings(spark):
    df = spans(spark, "item Laptop https://example.com www.sito.it A1 Anna Bianchi veicolo", (5, 11, "URL", "opf", 1.0), (12, 31, "URL", "opf", 1.0), (44, 46, "PERSONA", "opf", 1.0), (47, 59, "ACCOUNT_NUMBER", "opf", 1.0), (60, 67, "PATENTE", "opf", 1.0))
    found = df.select(resolver.drop_misread(F.col("text"), F.col("raw")).alias("s")).first().s
    assert [(s.start, s.label) for s in found] == [(12, "URL"), (47, "PERSONA")]
    assert "mouse" in COMMON_WORDS and len(set(COMMON_WORDS)) == 79


def fake():
    def detect(text):
        return [{"start": m.start(), "end": m.end(), "label": "person", "score": 0.91} for m in re.finditer("Mario Rossi", text)]

    return detect


def test_layers_and_occurrences(spark):
    e = Engine(spark, Config(opf_enabled=False, chunk_threshold=50, chunk_size=40, chunk_overlap=20), {"gliner": fake})
    long = "x " * 40 + "Mario Rossi poi MARIO ROSSI"
    rows = e.analyze(texts(spark, "Mario Rossi 3401234567", long, None, "")).orderBy("id").collect()
    assert rows[0].masked_text == "[PERSONA_1] [TEL_1]" and rows[0].spans[0].source == "gliner" and rows[0].spans[0].score == 0.91
    assert rows[1].masked_text == "x " * 40 + "[PERSONA_1] poi [PERSONA_1]"
    assert rows[2].masked_text is None and rows[3].masked_text == ""

    def missing():
        raise ImportError("no model")

    assert Engine(spark, Config(), {"opf": missing}).process_text("CF RSSMRA80A01L219X")[0] == "CF [CF_1]"
    assert detectors.plain_prediction({"start": 1, "end": 2}) is None


def test_window_query_covers_every_document(spark, tmp_path):
    from spanforge.plans import queries

    rows = {1: "short", 2: "", 3: "a b " * 500, 4: "word " * 1500}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in queries.QUERIES["chunk_windows"](spark, str(tmp_path)).collect())
    assert found == [(i, *w) for i, t in rows.items() for w in python_windows(t, 1500, 100)]


def python_windows(text, size, overlap):
    n, out, start = len(text), [], 0
    if n <= size:
        return [(0, n)]
    while True:
        end = min(start + size, n)
        if end < n:
            blank = max((i for i in range(end - max(1, size // 5), end) if text[i] in " \n\t\r"), default=None)
            end = end if blank is None else blank + 1
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - min(overlap, size // 2), start + 1)


def test_windows(spark):
    rnd = random.Random(4)
    values = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 200))) for _ in range(40)] + ["a" * 200]
    for size, overlap in ((20, 5), (33, 30), (50, 0)):
        for r in texts(spark, *values).select("text", windows(F.col("text"), size, overlap).alias("w")).collect():
            assert [(w.start, w.end) for w in r.w] == python_windows(r.text, size, overlap)
    df = spark.createDataFrame([("a/x.LOG", "y" * 9000), ("x.log", "y"), ("x.txt", "y" * 9000)], "path string, text string")
    assert [r[0] for r in df.select(skips_models(F.col("path"), F.col("text"))).collect()] == [True, False, False]


def test_evaluation(spark, engine, tmp_path):
    r = engine.evaluate(evaluate.synthetic_cases(spark)).first()
    assert r.documents == 31 and r.recall >= 0.9 and r.f1 >= 0.85
    (tmp_path / "c.jsonl").write_text('{"text": "CF RSSMRA80A01L219M", "labels": ["CODICE_FISCALE"]}\n\n{"text": "x", "labels": []}\n')
    assert engine.evaluate_file(str(tmp_path / "c.jsonl")).first().asDict() == {"documents": 2, "expected_labels": 1, "matched_labels": 1, "extra_labels": 0, "precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert engine.evaluate(evaluate.synthetic_cases(spark).limit(0)).first().recall == 1.0


def test_reports(spark, engine):
    df = engine.analyze(texts(spark, "<a@b.it> & x"))
    r = df.select(evaluate.highlighted(F.col("text"), F.col("spans")).alias("h"), evaluate.report_lines(F.col("audit")).alias("l"), F.to_json("audit", {"ignoreNullFields": "false"}).alias("a")).first()
    assert "#ffd54f" in r.h and "&lt;" in r.h and "&amp;" in r.h and "EMAIL via pattern" in r.h
    assert "- EMAIL: 1" in r.l and all(len(x) <= 110 for x in r.l)
    assert list(json.loads(r.a))[:3] == ["tool_version", "source_file", "output_file"]
    pages = spark.range(1).select(evaluate.report_pages(F.array_repeat(F.lit("x"), 100)).alias("p")).first().p
    assert [len(p) for p in pages] == [47, 47, 6]


def test_requests(spark, engine):
    lines = ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"id":"a","method":"tools/list"}', '{"id":2,"method":"tools/call","params":{"name":"anonymize_text","arguments":{"text":"CF RSSMRA80A01L219X"}}}', '{"id":3,"method":"tools/call","params":{"name":"other"}}', '{"method":"nope"}', " "]
    got = [json.loads(r.response) for r in rpc.responses(engine, spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert len(got) == 5 and got[0]["result"]["protocolVersion"] and got[1]["id"] == "a"
    assert got[2]["result"] == {"content": [{"type": "text", "text": "CF [CF_1]"}], "structuredContent": {"counts": {"CODICE_FISCALE": 1}}}
    assert [g["error"]["code"] for g in got[3:]] == [-32601, -32601] and got[4]["id"] is None


def test_recognised_words(spark):
    rows = spark.createDataFrame([(1, 0, 0, [[0.0, 0.0], [100.0, 0.0], [100.0, 10.0], [0.0, 10.0]], "ab cde")], "doc_id int, page int, line int, box array<array<double>>, text string")
    held = ocr.with_offsets(ocr.words(rows, "doc_id", "page", "line"), "doc_id").orderBy("number").collect()
    assert [(w.text, w.char_start, w.char_end, w.left, w.width) for w in held] == [("ab", 0, 2, 0.0, 50.0), ("cde", 3, 6, 50.0, 50.0)]
    df = spark.createDataFrame([(["mario", "r0ss1", "x", "ro", "ss1"], ["r0ss1"])], "t array<string>, w array<string>")
    r = df.select(ocr.page_matches(F.col("t"), F.col("w")).alias("e"), ocr.joined_matches(F.col("t"), F.col("w")).alias("j"), ocr.fuzzy_matches("t", "w").alias("f")).first()
    assert [(m["from"], m["count"]) for m in r.e] == [(1, 1)] and [(m["from"], m["count"]) for m in r.j] == [(1, 1)] and (1, 1) in [(m["from"], m["count"]) for m in r.f]
    assert spark.range(1).select(ocr.wrapped(F.lit("a" * 45 + "\n\nb\n"), 10).alias("w")).first().w == ["a" * 20, "a" * 20, "a" * 5, "", "b"]
    assert ocr.plain_rows(([([0], "t", 0.5)], 0.1)) == [([0], "t", 0.5)] and ocr.plain_rows(None) == []


def test_empty_frames(spark, engine):
    assert engine.analyze(texts(spark, "x").limit(0)).count() == 0
    assert quantiles_of(lambda: None, 3, 50)["pages_per_second"] > 0


def test_benchmark_page_has_fifteen_spans(engine):
    page = "CF RSSMRA80A01L219M, tel 3401234567; mail a@b.it\nIP 8.8.8.8 P.IVA 01114601006\n"
    assert sum(engine.process_text(page * 3)[1].values()) == 15

