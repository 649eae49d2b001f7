"""JSON-RPC lines as a stream: requests that arrive as files of lines, answered once each.

The batch plan of ``plans.rpc`` runs over ``readStream``; the file source and the file sink with one checkpoint give
each request exactly one answer, also when the query is stopped and started again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanforge.plans import rpc
from spanforge.plans.engine import Engine


def requests(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of files that come into a folder, as ``value``; with ``per_trigger``, so many files a micro-batch."""
    read = spark.readStream
    return (read.option("maxFilesPerTrigger", per_trigger) if per_trigger else read).text(folder)


def answer(engine: Engine, lines: DataFrame, folder: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """Answer what is there now, one line of JSON a request line, to files of lines, and stop."""
    done = rpc.responses(engine, lines, column).select("response")
    return done.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
