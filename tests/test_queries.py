"""Queries of masking against their SQL, over texts with values of other kinds than the SQL names."""

import os
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

from spanforge.config import Config  # noqa: E402
from spanforge.plans.engine import Engine  # noqa: E402
from spanforge.plans.queries import customers  # noqa: E402
from spanforge.sources import files  # noqa: E402

OTHERS = 'token = "0641917ea4e9", CF RSSMRA80A01L219M, tel 3401234567, via Roma 12'
TEXTS = [(1, "en", f"{OTHERS} from a@b.it to 10.0.0.42, then A@B.it"), (2, "it", OTHERS), (3, None, "c@d.org, then <8.8.8.8>"), (4, "it", None), (5, "en", "")]
NAMES = ["mask_replace", "mask_redact", "mask_generalize", "mask_hash", "entity_vault", "entity_map", "category_counts", "counts_by_lang", "counts_rollup", "audit_fields", "highlight_html", "report_lines", "streaming_mask", "rpc_stream"]


def same_rows(spark, folder, name, tables=("documents", "conversations")):
    """Whether a query gives the rows of its SQL."""
    df = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    said = con.sql(entry.oracle_sql()[name])
    order = [said.columns.index(c) for c in df.columns]
    return Counter(tuple(map(str, r)) for r in df.collect()) == Counter(tuple(str(r[i]) for i in order) for r in said.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory, TEXTS)


def tables(spark, tmp_path_factory, texts):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{at}/documents.parquet")
    turns = [(i, n, "user", text) for i in (1, 2) for n, text in enumerate([OTHERS, f"{OTHERS} a@b.it", "x"])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_masking_queries_find_what_their_sql_names(spark, folder, name):
    assert same_rows(spark, folder, name)


def test_folder_query_finds_what_its_sql_names(spark, tmp_path_factory):
    # without the empty text: Spark's reader of binary files passes over files of no bytes, which is open
    assert same_rows(spark, tables(spark, tmp_path_factory, TEXTS[:4]), "folder_audits")


NEAR = [(1, "en", "a@b.it, c@d.it; A@B.it"), (2, "it", "10.0.0.1, 10.0.0.2 10.0.0.1\n10.0.0.3"), (-13, "it", "x@y.org,z@y.org"), (14, "en", "")]


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory, NEAR)


@pytest.mark.parametrize("name", ["mask_replace", "entity_vault", "counts_by_lang", "highlight_html", "folder_audits"])
def test_values_near_each_other_stay_apart(spark, near, name):
    """Neighbours, an empty text (a file of no bytes) and a negative id."""
    assert same_rows(spark, near, name)


def test_folder_query_where_nothing_is_found(spark, tmp_path_factory):
    assert same_rows(spark, tables(spark, tmp_path_factory, [(1, "en", "none"), (2, "it", ""), (3, "it", None)]), "folder_audits")


def test_folder_query_reads_many_files_a_task(spark, tmp_path_factory):
    at = tables(spark, tmp_path_factory, [(i, "en", f"to a{i}@b.it") for i in range(300)])
    df = entry.queries()["folder_audits"](spark, at)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and df.count() == 300


def test_folders_are_not_listed_by_the_driver(spark, tmp_path_factory):
    """What reads files holds no list of them: neither those processed nor the audits of the query."""
    at = tables(spark, tmp_path_factory, [(i, "en", f"to a{i}@b.it" * (i % 3)) for i in range(-20, 40)])
    df = entry.queries()["folder_audits"](spark, at)
    assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString() and not df.inputFiles()
    assert df.count() == 60
    folder = tmp_path_factory.mktemp("some")
    for name in ("a b.txt", "è%20.txt", "deep/er/c.txt", "deep/none.txt", ".hidden/x.txt", "_SUCCESS"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("" if "none" in name else name)
    for recursive, names in ((True, {"a b.txt", "è%20.txt", "deep/er/c.txt", "deep/none.txt"}), (False, {"a b.txt", "è%20.txt"})):
        held = files.files(spark, str(folder), recursive)
        assert not held.inputFiles() and {(r.path, bytes(r.content).decode()) for r in held.collect()} == {(f"file:{folder}/{n}", "" if "none" in n else n) for n in names}
    assert [tuple(r) for r in files.files(spark, str(folder / "a b.txt")).collect()] == [(f"file:{folder}/a b.txt", bytearray(b"a b.txt"))]


def test_rules_by_label(spark):
    df = spark.createDataFrame([(OTHERS + " a@b.it",)], "text string")
    labels = lambda **c: [s.label for s in Engine(spark, Config(opf_enabled=False, gliner_enabled=False, **c)).detect(df).first().spans]
    assert labels() == ["TELEFONO_IT", "CODICE_FISCALE", "TELEFONO_IT", "INDIRIZZO", "EMAIL"]
    assert labels(pattern_labels=("EMAIL",)) == ["EMAIL"] and labels(pattern_labels=()) == []
    with pytest.raises(ValueError, match="NOPE"):
        labels(pattern_labels=("NOPE",))


@pytest.mark.parametrize("name", ["touching_words", "page_redactions"])
def test_words_get_their_places_in_their_rows(spark, folder, name):
    """No window sorts all words for their offsets, and the rows are those of the SQL."""
    df = entry.queries()[name](spark, folder)
    assert not [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "sum(" in x]
    assert same_rows(spark, folder, name)


def test_page_redactions_deal_no_words(spark, tmp_path_factory):
    """Texts of one to several pages, with equal and near words, values that stand on later pages, and boxes that coincide."""
    words = ["Rossi", "rOSSi", "a", "--", "Anna-Maria", "x1", "Il", "zio", "R", "ossi", "è", "\u00a0b"]
    texts = [(d, "it", " ".join(words[(i * (d + 3) + i // 7) % (d % 12 + 1)] for i in range(n))) for d, n in enumerate([0, 1, 5, 8, 12, 239, 240, 241, 480, 700, 1000, 37, 260])]
    at = tables(spark, tmp_path_factory, texts)
    df = entry.queries()["page_redactions"](spark, at)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 100 and same_rows(spark, at, "page_redactions")


@pytest.fixture(scope="module")
def short_rows(spark, tmp_path_factory):
    """A table whose rows are one task to read."""
    at = str(tmp_path_factory.mktemp("short"))
    rows = [(i, f"Customer#{i:09d}", ("BUILDING", "MACHINERY")[i % 2]) for i in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    assert spark.read.parquet(f"{at}/customer.parquet").rdd.getNumPartitions() == 1
    return at


def test_evaluation_of_a_small_file_runs_in_many_tasks(spark, short_rows):
    assert customers(spark, short_rows).groupBy(F.spark_partition_id()).count().count() == 4
    plan = entry.queries()["eval_metrics"](spark, short_rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan and "c_name" not in plan.partition("Repartition")[0]
    assert same_rows(spark, short_rows, "eval_metrics", ["customer"])


def test_files_made_of_a_small_file_are_read_in_many_tasks(spark, short_rows):
    found = entry.queries()["extract_txt"](spark, short_rows)
    assert found.groupBy(F.spark_partition_id()).count().count() == 4
    assert same_rows(spark, short_rows, "extract_txt", ["customer"])


@pytest.mark.parametrize("name", ["resolve_merge_folds", "resolve_merge_windows", "resolve_overlaps"])
def test_of_line_items_with_one_number_the_first_of_the_table_stays(spark, tmp_path_factory, name):
    """Files by name and not by size, as Spark reads them, and rows by their place: what DuckDB keeps when one thread reads in order."""
    at = str(tmp_path_factory.mktemp("items"))
    for part, n in enumerate((40, 400, 4000)):
        rows = [(i % 20, (i * 7919 + part * 31) % 1000, (i * 13 + part) % 7, i % 7 + 1, float(i % 50 + 1)) for i in range(n)]
        made = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1)
        made.write.parquet(f"{at}/made-{part}")
        os.makedirs(f"{at}/lineitem.parquet", exist_ok=True)
        (written,) = [f for f in os.listdir(f"{at}/made-{part}") if f.endswith(".parquet")]
        os.rename(f"{at}/made-{part}/{written}", f"{at}/lineitem.parquet/part-{part}.parquet")
    df = entry.queries()[name](spark, at)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet/*.parquet'")
    said = con.sql(entry.oracle_sql()[name])
    order = [said.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(str, r)) for r in df.collect()) == Counter(tuple(str(r[i]) for i in order) for r in said.fetchall())
