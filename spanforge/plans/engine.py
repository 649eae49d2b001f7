"""The engine: detection, masking, audits and evaluation over DataFrames, folders and single texts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanforge.config import Config
from spanforge.functions.folds import empty
from spanforge.functions.rows import entries
from spanforge.operators import evaluate, masking, patterns, resolver
from spanforge.operators.chunks import skips_models
from spanforge.operators.detectors import Factory, joined, with_layer, with_layer_by_window
from spanforge.operators.patterns import SPAN
from spanforge.sources import files
from spanforge.sources.formats import Format
from spanforge.streaming.state import discard, stored


@dataclass(frozen=True)
class Batch:
    """What a folder gave: a row for each file processed, for each one skipped its reason, and totals counted on the way.

    The rows lie in a table in the shared folder, without the files' own texts unless they were asked for, until ``discard``
    or the end of a ``with`` block deletes it.
    """

    results: DataFrame
    skipped: DataFrame
    totals: dict[str, int]
    table: str

    def discard(self) -> None:
        discard(self.results.sparkSession, self.table)

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, *_) -> None:
        self.discard()


_LAYER_TOTALS = ("opf_spans", "gliner_spans", "pattern_spans", "merged_unique_spans")
#: Columns that hold what was masked.
_OWN = ("text", "spans", "replacements", "ocr_words")


class Engine:
    """``detectors`` holds the factories of the statistical layers ``opf`` and ``gliner``; without one, the layer finds nothing
    and costs nothing, as its UDF is not in the plan."""

    def __init__(self, spark: SparkSession, config: Config | None = None, detectors: dict[str, Factory] | None = None, formats: dict[str, Format] | None = None):
        self.spark, self.config, self.detectors, self.formats = spark, config or Config(), detectors or {}, formats

    # columns

    def detect(self, df: DataFrame, text_col: str = "text", *, skip=None, out: str = "spans") -> DataFrame:
        """The frame with final spans of a text column; ``skip`` is a column that is true where models are not to run."""
        c, layers = self.config, []
        own = df
        for name, on in (("opf", c.opf_enabled), ("gliner", c.gliner_enabled)):
            if on and name in self.detectors:
                threshold = c.chunk_threshold if c.chunk_long_text else 2**31 - 1
                layer = with_layer_by_window if c.spread_windows and not df.isStreaming else with_layer
                own = layer(own, self.detectors[name], name, f"_{name}", text_col=text_col, skip=skip, threshold=threshold, size=c.chunk_size, overlap=max(0, c.chunk_overlap))
                layers.append(f"_{name}")
        if c.pattern_enabled:
            own = patterns.with_raw_spans(own, text_col, "_pattern", c.pattern_labels)
            layers.append("_pattern")
        raw = F.col(layers[0]) if layers == ["_pattern"] else joined(*map(F.col, layers)) if layers else empty(SPAN)
        own = own.withColumn("_raw", raw)
        return resolver.with_resolved(own, "_raw", text_col, out, c.merge_gap).drop("_raw", *layers)

    def mask(self, df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
        """The frame with ``replacements`` and ``masked_text``."""
        return masking.with_masked(df, spans_col, text_col, self.config.masking_mode)

    def analyze(self, df: DataFrame, text_col: str = "text", *, skip=None) -> DataFrame:
        """The frame with ``spans, replacements, masked_text, counts, audit``. No shuffle; works on streams."""
        done = self.mask(self.detect(df, text_col, skip=skip), text_col)
        return done.withColumns({"counts": resolver.category_counts(F.col("spans")), "audit": evaluate.audit(F.col("spans"), self.config)})

    # single texts

    def analyze_text(self, text: str) -> dict:
        """Text, masked text, spans, replacements and audit of one text."""
        began = time.perf_counter()
        row = self.analyze(self.spark.createDataFrame([(text,)], "text string")).first().asDict(recursive=True)
        row["audit"]["processing_time_seconds"] = round(time.perf_counter() - began, 4)
        return row

    def process_text(self, text: str) -> tuple[str, dict[str, int]]:
        """The masked text and its counts by category."""
        row = self.analyze_text(text)
        return row["masked_text"], row["counts"]

    # files

    def process_folder(self, folder: str, output: str | None = None, *, dry_run: bool = False, recursive: bool | None = None, keep_text: bool = False) -> Batch:
        """Analyse all files below a folder and, unless ``dry_run``, write them masked, each with its audit, below ``output``
        at the same relative place. A file that fails is skipped with its message; the others go on. Rows come by path.
        With ``keep_text`` they hold texts, spans and replacements, which are what masking hides."""
        root, is_folder = files.rooted(self.spark, folder)
        if not is_folder:
            raise ValueError(f"Cartella non trovata: {folder}")
        held = files.files(self.spark, folder, self.config.recursive if recursive is None else recursive)
        done, table, totals = self._processed(held, None if dry_run else output, root, keep_text=keep_text)
        skipped = done.where("error is not null").select("path", F.col("error").alias("reason"))
        return Batch(done.where("error is null").drop("output").orderBy("path"), skipped.orderBy("path"), totals, table)

    def process_file(self, path: str, output_dir: str | None = None, output_path: str | None = None, *, dry_run: bool = False) -> dict:
        """Analyse one file and, unless ``dry_run``, write it masked to ``output_path``, or under its new name to
        ``output_dir`` (its own folder if there is none), with its audit. Fails if the file can not be read."""
        root, is_folder = files.rooted(self.spark, path)
        if is_folder:
            raise ValueError(f"{path} is a folder")
        folder, _, name = output_path.rpartition("/") if output_path else (output_dir or root, "", None)
        held = files.files(self.spark, path)
        if files.supported(held, self.formats).select("path").isEmpty():
            raise ValueError(files.UNSUPPORTED)
        done, table, _ = self._processed(held, None if dry_run else folder or ".", root, name, keep_text=True)
        row = done.drop("output").first().asDict(recursive=True)
        discard(self.spark, table)
        if row["error"] is not None:
            raise ValueError(row["error"])
        return row

    def _processed(self, held: DataFrame, output: str | None, root: str, name: str | None = None, *, keep_text: bool = False) -> tuple[DataFrame, str, dict[str, int]]:
        """The supported files, each extracted, analysed and rebuilt once into a table, and written from there; the others as
        rows with their reason. Totals are counted while the table is written."""
        read = files.extract(files.supported(held, self.formats), self.formats)
        skip = skips_models(F.col("path"), F.col("text"), self.config.ml_skip_extensions, self.config.ml_skip_min_chars)
        done = self.mask(self.detect(read, skip=skip)).withColumn("counts", resolver.category_counts(F.col("spans")))
        if output is None:
            stripped, target = F.lit(not self.config.keep_metadata), F.lit(None).cast("string")
            done = done.drop("content")
        else:
            done = files.rebuild(done, self.config.keep_metadata, self.formats)
            stripped, target = F.col("metadata_stripped"), F.lit(name) if name else F.col("output_name")
        report = evaluate.audit(F.col("spans"), self.config, source_file=F.col("path"), output_file=target, warnings=F.col("warnings"), metadata_stripped=stripped)
        done = done.withColumn("report", report).withColumn("audit", F.to_json("report", {"ignoreNullFields": "false", "pretty": "true"}))
        if not keep_text:
            done = done.drop(*_OWN)
        done = done.unionByName(files.unsupported(held, self.formats).withColumnRenamed("reason", "error"), allowMissingColumns=True)
        seen, fine = Observation(), F.col("error").isNull()
        layers = (F.coalesce(F.sum(F.when(fine, F.col("report.entities_found")[c])), F.lit(0)).alias(c) for c in _LAYER_TOTALS)
        done = done.observe(seen, F.count_if(fine).alias("processed"), F.count_if(~fine).alias("skipped"), *layers)
        with files.small_batches(self.spark), files.small_files(self.spark):
            done, table = stored(done, "files")
            if output is not None:
                files.save_files(done, output, root, name)
        return done, table, dict(seen.get)

    # evaluation and reports

    def evaluate(self, cases: DataFrame) -> DataFrame:
        """Precision, recall and F1 over ``text, labels``; null labels count as none."""
        found = self.detect(cases.where("text is not null"))
        labels = F.transform("spans", lambda s: s["label"])
        return evaluate.evaluation(evaluate.label_matches(found.withColumns({"_e": F.coalesce("labels", F.array().cast("array<string>")), "_d": labels}), "_e", "_d"))

    def evaluate_file(self, path: str) -> DataFrame:
        """The evaluation of a JSON-lines file; blank lines are passed over."""
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        return self.evaluate(lines.select(F.from_json("value", "text string, labels array<string>").alias("c")).select("c.*"))

    def summary(self, analyzed: DataFrame) -> DataFrame:
        """Spans by category over all documents, by name, from their spans or, where those are not kept, their counts."""
        if "spans" in analyzed.columns:
            return evaluate.counts_by(analyzed).orderBy("label")
        return entries(analyzed, "counts", key="label", value="n").groupBy("label").agg(F.sum("n").alias("n_spans")).orderBy("label")

    def batch_audit(self, batch: Batch) -> DataFrame:
        """How many files were processed and skipped, and totals of spans by layer: one row, as counted while they were processed."""
        names = ("processed", *_LAYER_TOTALS, "skipped")
        return self.spark.createDataFrame([tuple(batch.totals[n] for n in names)], ", ".join(f"{n} long" for n in names))

    def audits(self, batch: Batch) -> DataFrame:
        """A row a file, ``path, audit`` or ``path, reason``: the parts of the batch's audit, to be written as JSON lines."""
        done = batch.results.select("path", F.to_json("report", {"ignoreNullFields": "false"}).alias("audit"), F.lit(None).cast("string").alias("reason"))
        return done.unionByName(batch.skipped.withColumn("audit", F.lit(None).cast("string")))

    def view(self, df: DataFrame, name: str, text_col: str = "text") -> None:
        """Make the analysed frame a temporary view, for SQL."""
        self.analyze(df, text_col).createOrReplaceTempView(name)


def quantiles_of(run: Callable[[], object], repeats: int = 3, pages: int = 1) -> dict[str, float]:
    """Least, median and greatest seconds of ``run``, and pages a second at the median."""
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    took.sort()
    middle = took[len(took) // 2] if len(took) % 2 else (took[len(took) // 2 - 1] + took[len(took) // 2]) / 2
    return {"min_seconds": took[0], "median_seconds": middle, "max_seconds": took[-1], "pages_per_second": pages / middle if middle else float("inf")}
