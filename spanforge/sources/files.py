"""Folders of files as DataFrames, and rebuilt files out of them.

A folder is listed in tasks (``sources/listing.py``) and its files' paths are dealt to all tasks, which read them: one row a file,
and nothing on the driver that grows with their number. In a store that pyarrow does not know Spark's ``binaryFile`` reads them.
All formats pass through one Arrow UDF, marked as not deterministic so that it runs once a file and is
never moved into other expressions. A file that can not be read is a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.rows import dealt
from spanforge.sources.formats import FORMATS, Format, format_of, masked_leaves, suffix_of
from spanforge.sources.listing import listed
from spanforge.sources.sink import write_files
from spanforge.sources.store import open_store

EXTRACTED = "struct<text:string,warnings:array<string>,ocr_words:string,error:string>"
REBUILT = "struct<content:binary,suffix:string,warnings:array<string>,metadata_stripped:boolean,error:string>"
UNSUPPORTED = "formato non supportato"


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, content`` of all files below a folder, or of a single file."""
    path, is_folder = _qualified(spark, folder)
    found = listed(spark, path, is_folder, recursive)
    if found is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")

    @F.pandas_udf("binary")
    def content(places: pd.Series) -> pd.Series:
        store, base = open_store(path)
        out = []
        for place in places:
            with store.open_input_file(f"{base}/{place}".rstrip("/")) as file:
                out.append(file.read())
        return pd.Series(out, dtype=object)

    return (dealt(found) if is_folder else found).select("path", content("place").alias("content"))


def rooted(spark: SparkSession, folder: str) -> tuple[str, bool]:
    """The folder (of a single file, the one that it lies in) as the file system writes it in paths, and whether it was a folder."""
    path, inside = _qualified(spark, folder)
    return (path if inside else path.rpartition("/")[0]), inside


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """A folder or file as the file system writes it in paths, and whether it is a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ValueError(f"Cartella non trovata: {path}")
    whole = fs.getFileStatus(at)
    return whole.getPath().toString().rstrip("/"), whole.isDirectory()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 16) -> Iterator[None]:
    """Arrow batches of a few rows while whole files pass through Python; the session's setting comes back afterwards."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def small_files(spark: SparkSession, cost: str = "64k") -> Iterator[None]:
    """Tasks of many small files while they are read. Spark reckons 4 MB for opening one, so that at most 32 are a task and
    beginning tasks takes most of the time; the session's setting comes back afterwards."""
    with _set(spark, "spark.sql.files.openCostInBytes", cost):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def suffix(path: str = "path"):
    """The lower-case suffix of a path column, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def supported(df: DataFrame, formats: dict[str, Format] | None = None) -> DataFrame:
    return df.where(suffix().isin(*(formats or FORMATS)))


def unsupported(df: DataFrame, formats: dict[str, Format] | None = None) -> DataFrame:
    """``path, reason`` of the files of unknown formats; their contents are not read."""
    return df.where(~suffix().isin(*(formats or FORMATS))).select("path", F.lit(UNSUPPORTED).alias("reason"))


def extract(df: DataFrame, formats: dict[str, Format] | None = None) -> DataFrame:
    """The files with ``text, warnings, ocr_words`` (as JSON) and ``error``."""

    @F.pandas_udf(EXTRACTED)
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        import json

        rows = []
        for path, content in zip(paths, contents, strict=True):
            try:
                got = format_of(path, formats).read(bytes(content))
                rows.append((got.text, got.warnings, json.dumps(got.ocr_words), None))
            except Exception as e:  # noqa: BLE001  one bad file is one bad row
                rows.append((None, [], "[]", str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "warnings", "ocr_words", "error"])

    return df.withColumn("_x", run.asNondeterministic()("path", "content")).select(*df.columns, "_x.*")


def rebuild(df: DataFrame, keep_metadata: bool = False, formats: dict[str, Format] | None = None) -> DataFrame:
    """Files with ``path, content, replacements`` (in text order) as ``path, output_name, output`` and what the writing says."""

    @F.pandas_udf(REBUILT)
    def run(paths: pd.Series, contents: pd.Series, plans: pd.Series) -> pd.DataFrame:
        rows = []
        for path, content, plan in zip(paths, contents, plans, strict=True):
            try:
                kind = format_of(path, formats)
                leaves = masked_leaves(kind.read(bytes(content)).leaves, sorted(plan, key=lambda r: r["start"]))
                out = kind.write(bytes(content), leaves, keep_metadata)
                rows.append((out.content, kind.suffix or suffix_of(path), out.warnings, out.metadata_stripped, None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, "", [], False, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["content", "suffix", "warnings", "metadata_stripped", "error"])

    kept = [c for c in df.columns if c not in ("content", "warnings", "error")]
    done = df.withColumn("_y", run.asNondeterministic()("path", "content", "replacements"))
    return done.select(*kept, output_name("path", F.col("_y.suffix")).alias("output_name"), F.col("_y.content").alias("output"), F.concat("warnings", "_y.warnings").alias("warnings"), F.col("_y.metadata_stripped").alias("metadata_stripped"), F.coalesce("error", "_y.error").alias("error"))


def output_name(path: str, ending):
    """The last part of the path with ``_anonymized`` before its (new) suffix."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.concat(stem, F.lit("_anonymized"), ending)


def save_files(df: DataFrame, folder: str, root: str, name: str | None = None) -> None:
    """Write ``output`` (and ``audit`` next to it, if there is one) at each file's place relative to ``root``, a path as
    ``rooted`` gives it; with ``name``, a single file under that name. All files or none are there afterwards.

    ``folder`` may be any URI pyarrow knows; all executors must see it.
    """
    prefix = root.rstrip("/") + "/"
    inside = F.when(F.startswith("path", F.lit(prefix)), F.regexp_extract(F.substring("path", len(prefix) + 1, 2**31 - 1), "^(.*/)[^/]*$", 1)).otherwise("")
    target = F.concat(inside, F.lit(name) if name else F.col("output_name"))
    audit = F.col("audit") if "audit" in df.columns else F.lit(None).cast("string")
    pair = F.array(F.struct(target.alias("target"), F.col("output").alias("content")), F.struct(F.concat(target, F.lit(".audit.json")).alias("target"), F.encode(audit, "UTF-8").alias("content")))
    write_files(df.where("error is null").select(F.inline(pair)), folder)
