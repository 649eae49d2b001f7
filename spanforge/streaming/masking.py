"""Masking as a stream: the batch plan, unchanged, over ``readStream``; and windowed counts of spans.

Masking keeps no state, so it runs in append mode with any source. Counts by event time keep
one row a window and label until the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.functions.rows import exploded
from spanforge.plans.engine import Engine


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of text files in a folder, as ``value``."""
    return spark.readStream.text(folder)


def masked_stream(engine: Engine, df: DataFrame, text_col: str = "text") -> DataFrame:
    """The stream with ``spans, replacements, masked_text, counts``."""
    return engine.analyze(df, text_col).drop("audit")


def windowed_counts(masked: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans by label and event-time window; rows later than ``late`` are dropped."""
    rows = exploded(masked.withWatermark(time_col, late), F.transform("spans", lambda s: s["label"]), time_col, name="label")
    return rows.groupBy(F.window(time_col, window).alias("w"), "label").agg(F.count("*").alias("n_spans")).select("w.start", "w.end", "label", "n_spans")


def to_folder(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to Parquet, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
