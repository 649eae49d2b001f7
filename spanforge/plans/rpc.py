"""JSON-RPC requests as a DataFrame of lines, and their responses; batch or stream.

Requests that mask text go through the engine's plan as rows, so any number is one job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.config import VERSION
from spanforge.operators.resolver import category_counts

REQUEST = "method string, params struct<name:string,arguments:struct<text:string>>"
TOOL = "anonymize_text"
_INITIALIZE = {"protocolVersion": "2024-11-05", "serverInfo": {"name": "spanforge", "version": VERSION}, "capabilities": {"tools": {}}}
_TOOLS = {"tools": [{"name": TOOL, "description": "Anonimizza testo usando i detector locali configurati.", "inputSchema": {"type": "object", "properties": {"text": {"type": "string"}}, "required": ["text"]}}]}
_KEEP = {"ignoreNullFields": "false"}


def responses(engine, requests: DataFrame, column: str = "value") -> DataFrame:
    """The frame with ``response``, one JSON object a request line; blank and null lines give no row. A line that is no JSON
    object gets a parse error, with a null id."""
    df = requests.where(F.trim(column) != "").withColumn("_q", F.from_json(column, REQUEST))
    # an id may be of any JSON type and is given back as it came
    parsed = F.expr(f"try_parse_json(`{column}`)")
    raw_id = F.coalesce(F.to_json(F.try_variant_get(parsed, "$.id", "variant")), F.lit("null"))
    readable = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    wanted = (F.col("_q.method") == "tools/call") & (F.col("_q.params.name") == TOOL)
    df = df.withColumn("_text", F.when(wanted, F.coalesce("_q.params.arguments.text", F.lit(""))))
    df = engine.mask(engine.detect(df, "_text", out="_spans"), "_text", "_spans")
    masked = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("masked_text").alias("text"))).alias("content"), F.struct(category_counts(F.col("_spans")).alias("counts")).alias("structuredContent")), _KEEP)
    result = F.when(F.col("_q.method") == "initialize", json.dumps(_INITIALIZE)).when(F.col("_q.method") == "tools/list", json.dumps(_TOOLS)).when(wanted, masked)
    message = F.when(F.col("_q.method") == "tools/call", F.lit("Tool non disponibile")).otherwise(F.concat(F.lit("Metodo non supportato: "), F.coalesce("_q.method", F.lit("None"))))
    code, message = F.when(readable, -32601).otherwise(-32700), F.when(readable, message).otherwise("Richiesta non leggibile")
    error = F.concat(F.lit('"error": '), F.to_json(F.struct(code.alias("code"), message.alias("message"))))
    body = F.when(result.isNotNull(), F.concat(F.lit('"result": '), result)).otherwise(error)
    line = F.concat(F.lit('{"jsonrpc": "2.0", "id": '), raw_id, F.lit(", "), body, F.lit("}"))
    return df.withColumn("response", line).drop("_q", "_text", "_spans", "replacements", "masked_text")
