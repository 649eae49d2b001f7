"""File formats, folders, streams and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.cli import main
from spanforge.config import Config
from spanforge.plans.engine import Engine
from spanforge.sources import formats
from spanforge.streaming.masking import masked_stream, text_lines, to_folder, windowed_counts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PLAIN = Config(opf_enabled=False, gliner_enabled=False)


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("tel 3401234567") + '<w:p w:rsidR="1"><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>' + f"<w:tbl><w:tr><w:tc>{p('a@b.it')}</w:tc></w:tr></w:tbl>" + '<w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h1" Type="x/header" Target="header1.xml"/></Relationships>'
    core = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Mario</dc:creator></c:coreProperties>'
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/header1.xml": f"<w:hdr {W}>{p('head')}</w:hdr>", "docProps/core.xml": core})


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/{0}" Target="{1}"/></Relationships>'
    return package(
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": rel.format("worksheet", "worksheets/s1.xml"),
            "xl/sharedStrings.xml": f"<sst {s}><si><t>P.IVA 01114601006</t></si></sst>",
            "xl/worksheets/s1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><f>CONCAT(A1)</f><v>1</v></c></row><row><c r="A3"><v>5</v></c></row></sheetData></worksheet>',
            "xl/worksheets/_rels/s1.xml.rels": rel.format("comments", "../comments1.xml"),
            "xl/comments1.xml": f'<comments {s}><authors><author>Mario</author></authors><commentList><comment ref="A3" authorId="0"><text><t>tel 3401234567</t></text></comment></commentList></comments>',
        }
    )


CASES = [
    (".txt", b"tel 3401234567", "tel 3401234567", b"tel [TEL_1]"),
    (".json", b'{"user":"Giulia","n":1,"address":{"city":"Roma","m":"a\\nb","zip":"00100"}}', "Giulia\nRoma\n00100", None),
    (".json", b'{"a":"","b":"Mario"}', "\nMario", None),
    (".xml", b'<r a=" x "><b> tel 3401234567 </b>tail</r>', "x\ntel 3401234567", None),
    (".rtf", rb"{\rtf1\ansi tel 3401234567\par x\'e0}", "tel 3401234567x", None),
    (".doc", b"\x00\x01tel 3401234567\x00ab\x00", "tel 3401234567", b"tel [TEL_1]"),
]


@pytest.mark.parametrize(("suffix", "raw", "text", "masked"), CASES)
def test_formats(spark, suffix, raw, text, masked):
    kind = formats.FORMATS[suffix]
    got = kind.read(raw)
    assert got.text == text
    row = Engine(spark, PLAIN).analyze_text(got.text)
    out = kind.write(raw, formats.masked_leaves(got.leaves, row["replacements"]), False)
    if masked is not None:
        assert out.content == masked
    if "3401234567" in text:
        assert b"3401234567" not in out.content


def test_json_keeps_structure():
    raw = b'{"b":"x","a":[1,null,"y\\nz",{"k":"w"}]}'
    out = json.loads(formats.write_json(raw, ["X", "W"], False).content)
    assert out == {"b": "X", "a": [1, None, "y\nz", {"k": "W"}]} and list(out) == ["b", "a"]


def test_mail():
    raw = b"From: a@b.it\r\nTo: c@d.it\r\nSubject: tel\r\n\r\nbody 3401234567\r\n"
    text = formats.read_eml(raw).text
    assert text.startswith("From: a@b.it\nTo: c@d.it\nCc: \nSubject: tel\n\nbody 3401234567")
    assert b"a@b.it" not in formats.write_eml(raw, ["masked"], False).content


def test_office_files():
    d = formats.FORMATS[".docx"]
    got = d.read(docx())
    assert got.leaves == ["tel 3401234567", "new", "head", "a@b.it"]
    out = d.write(docx(), ["tel [TEL_1]", "new", "head", "[EMAIL_1]"], False)
    again = formats.Package(out.content)
    assert d.read(out.content).leaves == ["tel [TEL_1]", "new", "head", "[EMAIL_1]"] and b"delText" not in again.raw["word/document.xml"] and b"Mario" not in again.raw["docProps/core.xml"]
    assert "2 revisioni" in out.warnings[1]
    x = formats.FORMATS[".xlsx"]
    assert x.read(xlsx()).leaves == ["P.IVA 01114601006", "=CONCAT(A1)", "tel 3401234567"]
    out = x.write(xlsx(), ["P.IVA [PIVA_1]", "=CONCAT(A1)", "tel [TEL_1]"], False).content
    assert x.read(out).leaves == ["P.IVA [PIVA_1]", "=CONCAT(A1)", "tel [TEL_1]"] and b"Anonimo" in formats.Package(out).raw["xl/comments1.xml"]


def test_leaves_of_several_lines_shift_no_other():
    assert formats.masked_leaves(["a\nb", "tel 1"], [{"start": 8, "end": 9, "replacement": "[T]"}]) == ["a\nb", "tel [T]"]


def test_registry():
    assert len(formats.supported_extensions()) == 21
    assert formats.suffix_of("/a.b/c") == "" and formats.suffix_of("x/A.TXT") == ".txt" and formats.suffix_of(".log") == ""
    with pytest.raises(ValueError, match="non supportato"):
        formats.format_of("x.bin")


def test_folder(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "nested").mkdir(parents=True)
    (source / "a.txt").write_text("tel 3401234567")
    (source / "nested" / "b.log").write_text("tel 3401234567")
    (source / "raw.bin").write_bytes(b"\x00")
    (source / "bad.json").write_text("{")
    engine = Engine(spark, PLAIN)
    batch = engine.process_folder(str(source), str(out))
    assert batch.results.count() == 2 and {r.path.rsplit("/", 1)[-1] for r in batch.skipped.collect()} == {"raw.bin", "bad.json"}
    assert (out / "a_anonymized.txt").read_text() == (out / "nested" / "b_anonymized.log").read_text() == "tel [TEL_1]"
    audit = json.loads((out / "a_anonymized.txt.audit.json").read_text())
    assert audit["entities_found"]["by_category"] == {"TELEFONO_IT": 1} and audit["opf_recall_mode"] is None
    assert engine.batch_audit(batch).first().processed == 2
    dry = engine.process_folder(str(source), str(tmp_path / "none"), dry_run=True, recursive=False)
    assert dry.results.count() == 1 and not (tmp_path / "none").exists()


def test_places_of_files(spark, tmp_path):
    """Outputs lie at the same place below the output as the inputs below the input, however that is written."""
    source = tmp_path / "main" / "in"
    (source / "x in" / "in").mkdir(parents=True)
    for name in ("b.txt", "a.txt", "x in/in/c.txt"):
        (source / name).write_text("tel 3401234567")
    engine = Engine(spark, PLAIN)
    for k, folder in enumerate((str(source), str(source) + "/", f"file:{source}", f"file://{source}")):
        out = tmp_path / f"out{k}"
        batch = engine.process_folder(folder, str(out))
        assert [r.path.rsplit("/", 1)[-1] for r in batch.results.collect()] == ["a.txt", "b.txt", "c.txt"]
        assert sorted(str(p.relative_to(out)) for p in out.rglob("*.txt")) == ["a_anonymized.txt", "b_anonymized.txt", "x in/in/c_anonymized.txt"]
    with pytest.raises(ValueError, match="Cartella non trovata"):
        engine.process_folder(str(tmp_path / "none"), str(tmp_path / "out"))


def test_files_of_no_bytes(spark, tmp_path):
    for name, content in (("a.txt", b""), ("b.txt", b"a@b.it"), ("c.xyz", b""), ("d.docx", b""), ("e/f.txt", b""), ("e/g h/i.txt", b""), (".x.txt", b""), ("_t/j.txt", b"")):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    engine = Engine(spark, PLAIN)
    with engine.process_folder(str(tmp_path / "in"), str(tmp_path / "out")) as batch:
        root = f"file:{tmp_path}/in/"
        assert [r.path.removeprefix(root) for r in batch.results.collect()] == ["a.txt", "b.txt", "e/f.txt", "e/g h/i.txt"]
        assert [r.path.removeprefix(root) for r in batch.skipped.collect()] == ["c.xyz", "d.docx"]
        assert (batch.totals["processed"], batch.totals["skipped"], batch.totals["pattern_spans"]) == (4, 2, 1)
    assert (tmp_path / "out/e/g h/i_anonymized.txt").read_bytes() == b""
    assert json.loads((tmp_path / "out/a_anonymized.txt.audit.json").read_text())["entities_found"]["pattern_spans"] == 0
    with engine.process_folder(str(tmp_path / "in"), dry_run=True, recursive=False) as batch:
        assert batch.totals["processed"] == 2
    assert engine.process_file(str(tmp_path / "in/e/f.txt"), output_path=str(tmp_path / "one.txt"))["masked_text"] == ""
    assert (tmp_path / "one.txt").read_bytes() == b""


def test_single_files(spark, tmp_path):
    engine, batch_rows = Engine(spark, PLAIN), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    (tmp_path / "a.txt").write_text("tel 3401234567")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "x.bin").write_bytes(b"")
    row = engine.process_file(str(tmp_path / "a.txt"))
    assert row["masked_text"] == "tel [TEL_1]" and (tmp_path / "a_anonymized.txt").read_text() == "tel [TEL_1]"
    engine.process_file(str(tmp_path / "a.txt"), output_dir=str(tmp_path / "d"))
    assert (tmp_path / "d" / "a_anonymized.txt").exists()
    engine.process_file(str(tmp_path / "a.txt"), output_path=str(tmp_path / "e" / "named.txt"))
    assert (tmp_path / "e" / "named.txt").read_text() == "tel [TEL_1]" and json.loads((tmp_path / "e" / "named.txt.audit.json").read_text())["output_file"] == "named.txt"
    assert engine.process_file(str(tmp_path / "a.txt"), output_dir=str(tmp_path / "f"), dry_run=True)["counts"] == {"TELEFONO_IT": 1} and not (tmp_path / "f").exists()
    for name in ("bad.json", "x.bin"):
        with pytest.raises(ValueError):
            engine.process_file(str(tmp_path / name))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch_rows


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("tel 3401234567\nx\n\na@b.it\n")
    engine = Engine(spark, PLAIN)
    done = masked_stream(engine, text_lines(spark, str(tmp_path / "in")), "value").select("value", "masked_text")
    to_folder(done, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = engine.analyze(spark.read.text(str(tmp_path / "in")), "value").select("value", "masked_text")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a@b.it"), ("2024-01-01 00:02:00", "c@d.it"), ("2024-01-01 00:07:00", "x")], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    got = windowed_counts(Engine(spark, PLAIN).detect(df), "ts").collect()
    assert [(r.label, r.n_spans) for r in got] == [("EMAIL", 2)]


def test_command_line(spark, tmp_path, capsys):
    assert main(["--text", "CF RSSMRA80A01L219X", "--show-map", "--report", "--export-vault", str(tmp_path / "v.json")], spark) == 0
    said = capsys.readouterr().out
    assert said.startswith("CF [CF_1]\n[CF_1] -> CODICE_FISCALE") and "- CODICE_FISCALE: 1" in said
    (tmp_path / "m.txt").write_text("CF [CF_1]")
    assert main(["--restore", str(tmp_path / "m.txt"), "--vault", str(tmp_path / "v.json")]) == 0
    assert (tmp_path / "m_restored.txt").read_text() == "CF RSSMRA80A01L219X"
    assert main(["--write-synthetic", str(tmp_path / "s.jsonl")], spark) == 0 and main(["--evaluate", str(tmp_path / "s.jsonl")], spark) == 0
    assert main([], spark) == 2
