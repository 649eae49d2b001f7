"""Relational forms of the span operators: one row a span, windows and joins instead of folds.

For analytics over span tables that come from elsewhere. Every window is partitioned by the
document, so a document's spans are one partition's rows and documents spread freely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.config import COMMON_WORDS
from spanforge.functions.rows import exploded
from spanforge.operators.resolver import MAX_GAP, normalized_label, priority


def span_rows(df: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """One row a span."""
    return exploded(df, spans_col, id_col).select(id_col, "s.start", "s.end", "s.label", "s.source", "s.score", "s.ord")


def islands(rows: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """The merge of neighbouring spans by gaps and islands.

    A group never leaves a run of equal labels in canonical order, and within a run the running
    maximum of ends is the group's own end, as any group that closes ends before the next one begins.
    """
    order = [F.col("start"), F.col("end"), -priority(F.col("source")), F.col("ord")]
    by_doc = Window.partitionBy(id_col).orderBy(*order)
    rows = rows.withColumn("label", normalized_label(F.col("label")))
    rows = rows.withColumn("run", F.sum(F.when(F.col("label") == F.lag("label").over(by_doc), 0).otherwise(1)).over(by_doc))
    before = F.max("end").over(Window.partitionBy(id_col, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    apart = F.col("before").isNull() | (F.col("start") > F.col("before") + MAX_GAP)
    if text_col:
        apart = apart | F.contains(F.substring(F.col(text_col), F.col("before") + 1, F.greatest(F.col("start") - F.col("before"), F.lit(0))), F.lit("\n"))
    rows = rows.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(by_doc))
    winner = F.struct(priority(F.col("source")).alias("p"), (F.col("end") - F.col("start")).alias("n"), F.col("score").alias("score"), (-F.row_number().over(by_doc)).alias("first"), F.col("source").alias("source"))
    grouped = rows.withColumn("w", winner).groupBy(id_col, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.max("w").alias("w"))
    return grouped.select(id_col, "start", "end", "label", F.col("w.source").alias("source"), F.col("w.score").alias("score"))


def without_common_words(rows: DataFrame, value_col: str = "value") -> DataFrame:
    """Anti join with the list of common words, of fixed size, broadcast."""
    words = rows.sparkSession.createDataFrame([(w,) for w in COMMON_WORDS], "word string")
    return rows.join(F.broadcast(words), F.lower(value_col) == F.col("word"), "left_anti")


def numbered(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Placeholder numbers by prefix in order of first appearance: ``label, norm, prefix, start`` -> ``n``."""
    first = rows.withColumn("first", F.min("start").over(Window.partitionBy(id_col, "label", "norm")))
    return first.withColumn("n", F.dense_rank().over(Window.partitionBy(id_col, "prefix").orderBy("first", "label", "norm"))).drop("first")


def binned(rows: DataFrame, start: str, end: str, size: int, out: str = "bin") -> DataFrame:
    """One row a bin of ``size`` offsets that an interval, both ends counted, reaches into; none for an interval that ends before it starts."""
    first, last = F.floor(F.col(start) / size), F.floor(F.col(end) / size)
    return rows.withColumn(out, F.explode(F.when(F.col(end) >= F.col(start), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def touching(words: DataFrame, ranges: DataFrame, id_col: str = "doc_id", *, size: int = 1024) -> DataFrame:
    """Interval join within documents: words and ranges that overlap or touch (both ends count).

    Both sides are dealt to bins of ``size`` offsets and meet in the bin where the later of the two starts, which is one that
    both reach into; so a document's words and ranges spread over its bins, and what is joined grows with what
    touches, not with words times ranges. Repeated rows stay repeated; null offsets touch nothing.
    """
    bin_col = "_bin"
    while bin_col in words.columns + ranges.columns:
        bin_col = f"_{bin_col}"
    left = binned(words, "char_start", "char_end", size, bin_col)
    right = binned(ranges, "range_start", "range_end", size, bin_col)
    later = F.floor(F.greatest("char_start", "range_start") / size) == F.col(bin_col)
    return left.join(right, [id_col, bin_col]).where((F.col("char_start") <= F.col("range_end")) & (F.col("char_end") >= F.col("range_start")) & later).drop(bin_col)


def overlaps_or_touches(start: str, end: str, other_start: str, other_end: str, gap: int = 0):
    """True where two intervals are at most ``gap`` apart."""
    return (F.col(start) <= F.col(other_end) + gap) & (F.col(other_start) <= F.col(end) + gap)
