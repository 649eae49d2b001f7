"""Folds, clusters, occurrences, intervals, windows, vaults, pages, files, SQL functions and request streams."""

import json
import random
import re
import time
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanforge import cli
from spanforge.config import Config
from spanforge.functions import folds
from spanforge.operators import detectors, masking, occurrences, pages, patterns, relational, resolver
from spanforge.plans import rpc, sql
from spanforge.plans.engine import Engine
from spanforge.sources import sink
from spanforge.streaming import rpc as rpc_stream

PLAIN = Config(opf_enabled=False, gliner_enabled=False)
WEIGHT = {"pattern": 3, "opf": 2, "gliner": 1}


def as_spans(rows):
    """Rows (start, end, source) as a literal-free column: from an array of structs named ``raw``."""
    return F.transform("raw", lambda s, i: patterns.span(s["start"], s["end"], "EMAIL", s["source"], 1.0, i))


def span_table(spark, lists):
    data = [(d, [Row(start=a, end=b, source=s) for a, b, s in rows]) for d, rows in enumerate(lists)]
    return spark.createDataFrame(data, "doc_id int, raw array<struct<start:int,end:int,source:string>>").withColumn("spans", as_spans("raw"))


def test_folds(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)] + [(None,)], "xs array<int>")
    step = lambda total, x: (total + x, F.when(x % 2 == 0, F.array(total + x)).otherwise(folds.empty("int")))
    got = [r[0] for r in df.select(folds.appended(F.col("xs"), F.lit(0), "int", step)).collect()]
    for n, out in zip((0, 1, 63, 64, 65, 1000), got, strict=False):
        assert out == [x * (x + 1) // 2 for x in range(0, n, 2)]
    assert got[-1] is None
    places = df.where("size(xs) > 0").select("xs", *(folds.place(F.col("xs"), lambda x, k=k: x < k).alias(f"p{k}") for k in (-1, 0, 7, 64, 2000))).collect()
    for r in places:
        assert [r[f"p{k}"] for k in (-1, 0, 7, 64, 2000)] == [sum(x < k for x in r.xs) for k in (-1, 0, 7, 64, 2000)]


def greedy(rows):
    kept = []
    for a, b, s in sorted(rows, key=lambda r: (-WEIGHT[r[2]], r[0] - r[1], r[0])):
        if not any(a < d and c < b for c, d, _ in kept):
            kept.append((a, b, s))
    return sorted(kept, key=lambda r: r[0])


def test_disjoint_spans_by_definition(spark):
    rnd = random.Random(7)
    lists = []
    for _ in range(250):
        wide, n, reach = rnd.choice([30, 300, 3000]), rnd.randint(0, 70), rnd.choice([3, 20, 200])
        starts = [rnd.randrange(wide) for _ in range(n)]
        lists.append([(a, a + rnd.randint(1, reach), rnd.choice(list(WEIGHT))) for a in starts])
    lists.append([(0, 100, "gliner"), *((a, a + 1, "pattern") for a in range(0, 100, 2))])
    lists.append([(0, 100, "pattern"), *((a, a + 1, "gliner") for a in range(0, 100, 2))])
    got = span_table(spark, lists).select("doc_id", resolver.keep_disjoint(F.col("spans")).alias("k")).collect()
    for r in got:
        assert [(s.start, s.end, s.source) for s in r.k] == greedy(lists[r.doc_id]), lists[r.doc_id]
        assert [s.ord for s in r.k] == list(range(len(r.k)))


def test_many_spans_of_one_text_are_settled_in_linear_time(spark):
    def took(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 37 % (20 * n)).cast("int").alias("start"), (i * 37 % (20 * n) + 1 + i % 60).cast("int").alias("end"), F.when(i % 2 == 0, "opf").otherwise("gliner").alias("source"))).alias("raw"))
        df = df.withColumn("spans", as_spans("raw")).select(F.size(resolver.keep_disjoint(F.col("spans"))).alias("n"))
        began = time.perf_counter()
        assert df.first().n > n // 5
        return time.perf_counter() - began

    took(1000)
    small, large = took(5000), took(50000)
    assert large < 25 * max(small, 0.2), (small, large)


def by_each_value(text, values):
    """(i, start, end) of every value, one after the other."""
    return sorted((i, m.start(), m.end()) for i, v in enumerate(values) for m in re.finditer(re.escape(v), text, re.IGNORECASE))


def test_values_together_equal_values_one_by_one(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(120):
        alphabet = rnd.choice(["AB ", "ABC ", "AÉ ß", "MARIO ROSSI", "a.\\E(Q) "])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200)))
        values = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, rnd.choice([3, 6, 40])))).strip().upper() for _ in range(rnd.randint(1, 30))}
        values |= {text[a : a + rnd.randint(1, 60)].strip().upper() for a in range(0, len(text), 23)}
        # one character for one: what changes its length in upper case is for the next test
        values = [v for v in values if v and "SS" not in v and "ß" not in v]
        rows.append((k, text.replace("ß", "s"), values or ["X"]))
    df = spark.createDataFrame(rows, "k int, text string, vs array<string>")
    values = F.array_sort(F.transform("vs", lambda v, i: F.struct(v.alias("value"), i.alias("i"))))
    for r in occurrences.with_together(df.withColumn("v", values), "text", "v", "h").select("k", "h").collect():
        _, text, vs = rows[r.k]
        assert sorted((h.i, h.start, h.end) for h in r.h) == by_each_value(text, vs), (text, vs)


def test_letters_whose_case_is_odd(spark):
    text, values = "ſtraße ΟΔΟΣ οδος İx ıX K k ẞ ß", ["STRASSE", "ΟΔΟΣ", "K", "S", "ẞ", "IX", "TRA"]
    df = spark.createDataFrame([(text, values)], "text string, vs array<string>").withColumn("v", F.array_sort(F.transform("vs", lambda v, i: F.struct(v.alias("value"), i.alias("i")))))
    both = occurrences.with_together(df, "text", "v", "h").withColumn("each", resolver.each_value(F.col("text"), F.col("v"))).first()
    assert sorted(map(tuple, both.h)) == sorted(map(tuple, both.each)) and both.h


def plain_occurrences(text, spans):
    """The definition: each value of two words or more, wherever else it stands."""
    covered, known, out = {(s, e) for s, e in spans}, {}, []
    for s, e in spans:
        value = " ".join(text[s:e].upper().split())
        if " " in value:
            known.setdefault(value, len(known))
    for v in known:
        for m in re.finditer(re.escape(v), text, re.IGNORECASE):
            if m.span() not in covered:
                out.append(m.span())
                covered.add(m.span())
    return out


@pytest.mark.parametrize("few", [resolver.SMALL, 0])
def test_other_occurrences_by_definition(spark, monkeypatch, few):
    monkeypatch.setattr(resolver, "SMALL", few)
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        text = " ".join(rnd.choice(["Mario", "ROSSI", "rossi", "Rossini", "via", "Roma", "x"]) for _ in range(rnd.randint(0, 80)))
        cuts = sorted((a, min(len(text), a + rnd.randint(2, 30))) for a in {rnd.randrange(len(text)) for _ in range(rnd.randint(0, 25))}) if text else []
        rows.append((k, text, [Row(start=a, end=b, source="opf") for a, b in cuts]))
    df = spark.createDataFrame(rows, "k int, text string, raw array<struct<start:int,end:int,source:string>>").withColumn("spans", as_spans("raw"))
    for r in resolver.other_occurrences(df, "spans").select("k", "more").collect():
        assert [(s.start, s.end) for s in r.more] == plain_occurrences(rows[r.k][1], [(x.start, x.end) for x in rows[r.k][2]])


def test_touching_intervals(spark):
    rnd = random.Random(2)
    words = [(d, a, a + rnd.randint(0, 9)) for d in (1, 2) for a in range(0, 5000, 11)] + [(1, None, 4), (None, 1, 2), (1, 3, 2)]
    ranges = [(d, a, a + rnd.choice([0, 5, 3000])) for d in (1, 2, 3) for a in (rnd.randrange(-50, 5000) for _ in range(60))] + [(1, 7, None)]
    left, right = spark.createDataFrame(words, "doc_id int, char_start int, char_end int"), spark.createDataFrame(ranges, "doc_id int, range_start int, range_end int")
    want = sorted((d, a, b, c, e) for d, a, b in words if d and a is not None and b >= a for f, c, e in ranges if f == d and e is not None and a <= e and b >= c)
    for size in (64, 1024):
        df = relational.touching(left, right, size=size)
        assert sorted(tuple(r[c] for c in ("doc_id", "char_start", "char_end", "range_start", "range_end")) for r in df.collect()) == want
    plan = relational.touching(left.hint("merge"), right, size=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan.split("Join Inner", 1)[1].splitlines()[0]


def words_of(text):
    return [{"start": m.start(), "end": m.end(), "label": "person", "score": 0.5} for m in re.finditer(r"N\d+", text)]


def test_windows_as_rows_equal_windows_in_a_row(spark):
    rnd = random.Random(9)
    texts = ["", "N1 x", "N2 " * 3000, "x" * 9000 + " N3", " ".join(f"N{rnd.randrange(99)}" for _ in range(4000))]
    df = spark.createDataFrame([(i, t, i == 3) for i, t in enumerate([*texts, texts[2], texts[4], None])], "id int, text string, off boolean")
    for source in ("gliner", "opf"):
        made = [f(df, lambda: words_of, source, "s", skip=F.col("off"), threshold=4000, size=1500, overlap=100) for f in (detectors.with_layer, detectors.with_layer_by_window)]
        one, other = ({r.id: r.s for r in m.collect()} for m in made)
        assert one == other and one[3] == [] and one[7] == [] and len(one[4]) > 4000
    plan = made[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("ArrowEvalPython") == 1
    python = plan.split("ArrowEvalPython", 1)[1]
    assert "off" in python and "posexplode" in python  # skipped rows are filtered away below, windows are rows
    spread = Engine(spark, Config(opf_enabled=False, pattern_enabled=False, spread_windows=True), {"gliner": lambda: words_of})
    plain = Engine(spark, Config(opf_enabled=False, pattern_enabled=False), {"gliner": lambda: words_of})
    assert {r.id: r.spans for r in spread.detect(df).collect()} == {r.id: r.spans for r in plain.detect(df).collect()}


def test_vault_of_another_run(spark, tmp_path):
    engine = Engine(spark, PLAIN)
    text = "a@b.it c@d.it " * 3 + " ".join(f"u{i}@x.it" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "tel 3401234567"), (3, "nothing"), (4, None), (None, "a@b.it"), (2, "tel 3401234567")], "doc_id int, text string")
    done = engine.mask(engine.detect(df)).select("doc_id", "text", "masked_text", "replacements").persist()
    masking.write_vault(done.where("doc_id is not null").dropDuplicates(["doc_id"]), str(tmp_path / "v"), buckets=4)
    back = masking.restore_from(done.select("doc_id", "masked_text", "text"), str(tmp_path / "v"), buckets=4)
    assert back.columns == ["doc_id", "masked_text", "text", "restored"]
    for r in back.collect():
        assert r.restored == (r.text if r.doc_id is not None else "[EMAIL_1]")
    assert back.count() == 6
    done.unpersist()


def test_files_are_there_all_or_none(spark, tmp_path):
    rows = [(f"{i % 3}/{i}.txt", bytes([i])) for i in range(20)] + [("none.txt", None)]
    df = spark.createDataFrame(rows, "target string, content binary").repartition(4)
    sink.write_files(df, str(tmp_path / "a"))
    assert sorted(str(p.relative_to(tmp_path / "a")) for p in (tmp_path / "a").rglob("*") if p.is_file()) == sorted(t for t, c in rows if c)
    assert (tmp_path / "a" / "1" / "7.txt").read_bytes() == b"\x07"

    @F.udf("binary")
    def failing(x):
        if x == b"\x0b":
            raise ValueError("no")
        return x

    with pytest.raises(Exception, match="no"):
        sink.write_files(df.withColumn("content", failing("content")), str(tmp_path / "b"))
    assert not [p for p in (tmp_path / "b").rglob("*")]
    # an attempt that was not the one that counts leaves nothing
    writer = sink.FilesWriter(str(tmp_path / "c"))
    first, second = writer.write(iter([("x.txt", b"1")])), writer.write(iter([("x.txt", b"2")]))
    assert first.attempt != second.attempt
    writer.commit([second])
    assert [p.name for p in (tmp_path / "c").rglob("*")] == ["x.txt"] and (tmp_path / "c" / "x.txt").read_bytes() == b"2"


def test_a_folder_leaves_no_clear_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "tel 3401234567"), ("b.txt", "a@b.it c@d.it"), ("c.bin", "x"), ("bad.json", "{")):
        (tmp_path / "in" / name).write_text(text)
    engine = Engine(spark, PLAIN)
    with engine.process_folder(str(tmp_path / "in"), str(tmp_path / "out")) as batch:
        assert {"text", "spans", "replacements"}.isdisjoint(batch.results.columns)
        assert engine.batch_audit(batch).first().asDict() == {"processed": 2, "opf_spans": 0, "gliner_spans": 0, "pattern_spans": 2, "merged_unique_spans": 2, "skipped": 2}
        again = batch.results.agg(F.count("*"), F.sum("report.entities_found.pattern_spans")).first()
        assert tuple(again) == (2, 2)
        assert {r.label: r.n_spans for r in engine.summary(batch.results).collect()} == {"TELEFONO_IT": 1, "EMAIL": 1}
        audits = {r.path.rsplit("/", 1)[-1]: r for r in engine.audits(batch).collect()}
        assert json.loads(audits["b.txt"].audit)["entities_found"]["by_category"] == {"EMAIL": 1} and audits["c.bin"].reason == "formato non supportato"
        held = batch.table
    at = spark._jvm.org.apache.hadoop.fs.Path(held)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    with engine.process_folder(str(tmp_path / "in"), dry_run=True, keep_text=True) as batch:
        assert {r.text for r in batch.results.collect()} == {"tel 3401234567", "a@b.it c@d.it"}
    names = [p.name for p in (tmp_path / "out").rglob("*")]
    assert sorted(names) == ["a_anonymized.txt", "a_anonymized.txt.audit.json", "b_anonymized.txt", "b_anonymized.txt.audit.json"]


def test_pages(spark):
    """Boxes by place, by value on other pages, once a page, black only for full blocks."""
    laid = [(1, p, i // 4, i % 4, w) for p, ws in enumerate(["Mario Rossi nato a Rorna", "vive Mario Ro-ssi qui MARI0 ROSSI", "MarioRossi. x y", "y"]) for i, w in enumerate(ws.split())]
    words, at = [], 0
    for d, p, line, n, w in laid:
        words.append((d, p, line, n, w, 10.0 * n, 5.0 * line, 8.0, 4.0, at, at + len(w)))
        at += len(w) + 1
    df = spark.createDataFrame(words, "doc_id int, page int, line int, number int, text string, left double, top double, width double, height double, char_start int, char_end int")
    wanted = [(1, 1, 0, 11, "Mario Rossi", "[PERSONA_1]"), (1, 2, 0, 11, "mario rossi", "████"), (1, 3, 900, 901, "y", "█"), (1, 4, 900, 901, "  ", "x"), (1, 5, 900, 901, "manca", "x"), (2, 1, 0, 3, "Mario", "x")]
    boxes = pages.redactions(df, spark.createDataFrame(wanted, "doc_id int, r int, start int, end int, original string, replacement string"))
    got = sorted(tuple(r[c] for c in ("page", "r", "x0", "y0", "x1", "y1", "fill", "label")) for r in boxes.collect())
    person = (1, "[PERSONA_1]")
    assert got == [
        (0, 1, 0.0, 0.0, 18.0, 4.0, *person),
        (1, 1, 0.0, 5.0, 18.0, 9.0, *person),
        (1, 1, 10.0, 0.0, 28.0, 4.0, *person),
        (2, 1, 0.0, 0.0, 8.0, 4.0, *person),
        (2, 3, 20.0, 0.0, 28.0, 4.0, 0, ""),
        (3, 3, 0.0, 0.0, 8.0, 4.0, 0, ""),
    ]


def test_expressions_as_sql(spark):
    """The text of an expression means what the expression means."""
    df = spark.createDataFrame([("a@b.it, C@D.it 'x' \\ 8.8.8.8",), (None,), ("",)], "text string")
    rule = next(r for r in patterns.RULES if r.label == "EMAIL")
    for made in (patterns.rule_spans(F.col("text"), rule), occurrences.folded(F.col("text")), F.when(~F.col("text").isin("", "x"), -F.length("text")).otherwise(0)):
        both = df.select(made.alias("a"), F.expr(sql.sql_text(made)).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]


def test_requests_as_a_stream(spark, tmp_path):
    engine = Engine(spark, PLAIN)
    lines = ['{"id": 1, "method": "tools/call", "params": {"name": "anonymize_text", "arguments": {"text": "a@b.it\\nx"}}}', "", "   ", '{"id": "x', "[1]", "7", '{"id": [1], "method": "initialize"}', '{"id": null, "method": "tools/list"}', '{"method": "tools/call", "params": {"name": "other"}}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    run = lambda: rpc_stream.answer(engine, rpc_stream.requests(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    run()
    (tmp_path / "in" / "b.txt").write_text(lines[0] + "\n")
    run()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    batch = rpc.responses(engine, spark.createDataFrame([(x,) for x in [*lines, lines[0]]], "value string"))
    assert got == sorted(r.response for r in batch.collect()) and len(got) == 8
    codes = [json.loads(x).get("error", {}).get("code") for x in got]
    assert codes.count(-32700) == 3 and codes.count(-32601) == 1
    assert [json.loads(x)["id"] for x in got if "protocolVersion" in x] == [[1]]


def test_command_line_of_folders_and_layers(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Anna a@b.it")
    (tmp_path / "in" / "b.log").write_text("Anna " * 10)
    (tmp_path / "in" / "c.bin").write_text("x")
    detectors = {"gliner": lambda: lambda text: [{"start": m.start(), "end": m.end(), "label": "person"} for m in re.finditer("Anna", text)]}
    options = ["--mode", "generalize", "--disable-layer", "opf", "--ml-skip-extensions", "log", "--ml-skip-min-chars", "5"]
    assert cli.main([str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--json", *options], spark, detectors) == 0
    said = capsys.readouterr().out.splitlines()
    audits = [json.loads(x) for x in said if x.startswith('{"path"')]
    assert len(audits) == 3 and {a["path"].rsplit("/", 1)[-1] for a in audits if "reason" in a} == {"c.bin"}
    totals = next(json.loads(x) for x in said if x.startswith('{"processed"'))
    assert (totals["processed"], totals["skipped"], totals["gliner_spans"], totals["pattern_spans"]) == (2, 1, 1, 1)
    assert (tmp_path / "out" / "a_anonymized.txt").read_text() == "[PERSONA] [EMAIL]"
    assert cli.main(["--supported-formats"], spark) == 0 and ".docx" in capsys.readouterr().out
    parsed = cli.config_of(cli.parser().parse_args(["--pattern-only", "--no-chunk-long-text", "--recall-mode", "balanced", "--ml-skip-extensions", ""]))
    assert parsed.layers == ["pattern"] and not parsed.chunk_long_text and parsed.ml_skip_extensions == () and parsed.opf_recall_mode == "balanced"


def test_predicates_reach_the_scan_and_rows_of_spans_detect_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a@b.it")], "doc_id int, lang string, text string").write.parquet(str(tmp_path / "d"))
    df = Engine(spark, PLAIN).analyze(spark.read.parquet(str(tmp_path / "d")))
    plan = df.where("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan.split("PushedFilters", 1)[1]
    below = relational.span_rows(df)._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1]
    assert not [line for line in below.splitlines() if line.strip(" +-:").startswith("Filter")]


def test_a_batch_is_not_held_as_python_objects():
    """Of what a detector finds, only a piece of a batch's rows is there as objects at a time."""
    class Held(dict):
        """A prediction that can be watched."""

    alive, most, made = weakref.WeakValueDictionary(), 0, 0

    def one(text):
        nonlocal most, made
        found = [Held(start=0, end=1, label=text, score=1.0) for _ in range(3)] if text else []
        for f in found:
            made += 1
            alive[made] = f
        most = max(most, len(alive))
        return found

    values = pa.array(["a", None, "bb", ""] * 1000)
    got = detectors.in_pieces(values, one, detectors._PREDICTIONS)
    assert made == 6000 and most <= 2 * 3 * 64
    assert [[p["label"] for p in ps] for ps in got.to_pylist()] == [[v] * 3 if v else [] for v in values.to_pylist()]
    assert detectors.in_pieces(values.slice(0, 0), one, detectors._PREDICTIONS).type == detectors._PREDICTIONS
