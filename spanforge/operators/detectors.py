"""Pluggable statistical detectors, run as Arrow-batched iterator UDFs.

A layer is any callable ``text -> predictions`` made once a worker by a factory. Predictions
are dicts or objects with ``start``, ``end``, one of ``label``, ``entity``, ``type``, and
maybe ``score``. A layer whose factory gives None, or raises ImportError, finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.config import GLINER_LABELS, OPF_LABELS
from spanforge.functions.folds import bound, empty
from spanforge.functions.regex import piece
from spanforge.operators.chunks import windows
from spanforge.operators.patterns import SPAN, by_keys, changed, span

PREDICTION = "struct<start:int,end:int,label:string,score:double>"
_PREDICTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))
Factory = Callable[[], Callable[[str], list] | None]


def plain_prediction(p) -> dict | None:
    """A prediction as a dict; None where its place or label is missing."""
    get = p.get if isinstance(p, dict) else lambda k, d=None: getattr(p, k, d)
    label = get("label") or get("entity") or get("type")
    if get("start") is None or get("end") is None or label is None:
        return None
    score = get("score", 1.0)
    return {"start": int(get("start")), "end": int(get("end")), "label": str(label), "score": float(1.0 if score is None else score)}


def predictor(factory: Factory):
    """A UDF over texts that gives each one's predictions; the detector is made once a worker."""

    @F.arrow_udf(f"array<{PREDICTION}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detect = _made(factory)
        for texts in batches:
            yield in_pieces(texts, lambda t: _predicted(detect, t), _PREDICTIONS)

    return run


def _made(factory: Factory):
    """The detector; None where the factory gives none or lacks a package."""
    try:
        return factory()
    except ImportError:
        return None


def _predicted(detect, text: str | None) -> list[dict]:
    return [p for p in map(plain_prediction, detect(text)) if p] if detect and text else []


def in_pieces(values: pa.Array, one: Callable, kind: pa.DataType, many: int = 64) -> pa.Array:
    """What ``one`` makes of each value. No more than ``many`` of them are Python objects at a time, however many rows a batch
    has and however much is found in them."""
    pieces = [pa.array(map(one, values.slice(at, many).to_pylist()), kind, size=len(values.slice(at, many))) for at in range(0, len(values), many)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


def mapped_label(label: Column, source: str) -> Column:
    """The project's label of a layer's own."""
    low = F.lower(F.trim(label)) if source == "opf" else F.lower(label)
    table = {"opf": OPF_LABELS, "gliner": GLINER_LABELS}.get(source, {})
    out = F.upper(label) if source == "opf" else F.replace(F.upper(label), F.lit(" "), F.lit("_"))
    for name, to in table.items():
        out = F.when(low == name, to).otherwise(out)
    return out


def to_spans(predictions: Column, source: str, shift: Column | int = 0) -> Column:
    """Predictions as spans of a source, moved by ``shift``."""
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    return F.transform(predictions, lambda p: span(p["start"] + shift, p["end"] + shift, mapped_label(p["label"], source), source, p["score"]))


def with_layer(df: DataFrame, factory: Factory, source: str, out: str, *, text_col: str = "text", skip: Column | None = None, threshold: int = 4000, size: int = 1500, overlap: int = 100) -> DataFrame:
    """The frame with the spans of one layer. Texts above ``threshold`` go through in overlapping windows.

    A text's windows are one array, evaluated in one Arrow batch with others; skipped rows reach the model as null. No
    shuffle; works on streams. ``with_layer_by_window`` deals the windows of a long text to several tasks.
    """
    text = F.when(~F.coalesce(skip, F.lit(False)), F.col(text_col)) if skip is not None else F.col(text_col)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length(F.col(text_col)).alias("end")))
    df = df.withColumn("_w", F.when(F.char_length(text_col) > threshold, windows(F.col(text_col), size, overlap)).otherwise(whole) if threshold >= 0 and size > 0 else whole)
    df = df.withColumn("_texts", F.when(text.isNotNull(), F.transform("_w", lambda w: piece(F.col(text_col), w["start"], w["end"]))).otherwise(empty("string")))
    df = df.withColumn("_p", _array_predictor(factory).asNondeterministic()(F.col("_texts")))
    spans = F.flatten(F.zip_with("_p", "_w", lambda p, w: to_spans(F.coalesce(p, empty(PREDICTION)), source, w["start"])))
    ordered = F.transform(spans, lambda s, i: changed(s, ord=i))
    if source == "gliner":
        ordered = by_keys(ordered, lambda s: (s["start"], s["end"], s["ord"]))
    return df.withColumn(out, F.coalesce(ordered, empty(SPAN))).drop("_w", "_texts", "_p")


def with_layer_by_window(df: DataFrame, factory: Factory, source: str, out: str, *, text_col: str = "text", skip: Column | None = None, threshold: int = 4000, size: int = 1500, overlap: int = 100) -> DataFrame:
    """As ``with_layer``, with each window a row of its own: those of a long text are dealt to all tasks, equal windows of
    equal texts are run once, and skipped or null texts never reach Python. Rows come in another order; batch only."""
    text, key = F.col(text_col), "_key"
    runs = text.isNotNull() & ~F.coalesce(skip if skip is not None else F.lit(False), F.lit(False))
    asked = df.where(runs).withColumn(key, F.sha2(F.encode(text, "UTF-8"), 256))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length(text).alias("end")))
    places = F.when(F.char_length(text) > threshold, windows(text, size, overlap)).otherwise(whole) if threshold >= 0 and size > 0 else whole
    rows = asked.select(key, F.posexplode_outer(bound(places, lambda ws: window_texts(text, ws))).alias("_n", "_w")).where("_n is not null")
    rows = rows.groupBy(key, "_n").agg(F.first("_w.start").alias("_start"), F.first("_w.text").alias("_text"))
    found = rows.select(key, "_n", "_start", predictor(factory).asNondeterministic()("_text").alias("_p"))
    found = found.select(key, "_n", to_spans(F.col("_p"), source, F.col("_start")).alias("_s")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_s"))).alias("_found"))
    ordered = F.transform(F.flatten(F.transform("_found", lambda f: f["_s"])), lambda s, i: changed(s, ord=i))
    if source == "gliner":
        ordered = by_keys(ordered, lambda s: (s["start"], s["end"], s["ord"]))
    done = asked.join(found.select(key, ordered.alias(out)), key).drop(key)
    return done.unionByName(df.where(~F.coalesce(runs, F.lit(False))).withColumn(out, empty(SPAN)))


def window_texts(text: Column, places: Column, many: int = 64) -> Column:
    """The texts of windows with their starts. A long text is cut into runs of ``many`` windows first, as cutting counts
    characters from the beginning of what it cuts."""

    def run(ws: Column) -> Column:
        first = F.get(ws, F.lit(0))["start"]
        cut = lambda held: F.transform(ws, lambda w: F.struct(w["start"].alias("start"), piece(held, w["start"] - first, w["end"] - first).alias("text")))
        return bound(piece(text, first, F.element_at(ws, -1)["end"]), cut)

    last = F.floor((F.greatest(F.size(places), F.lit(1)) - 1) / many).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: bound(F.slice(places, i * many + 1, F.lit(many)), run)))


def _array_predictor(factory: Factory):
    @F.arrow_udf(f"array<array<{PREDICTION}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detect = _made(factory)
        for rows in batches:
            yield in_pieces(rows, lambda texts: [_predicted(detect, t) for t in texts or ()], pa.list_(_PREDICTIONS))

    return run


def joined(*layers: Column) -> Column:
    """Spans of several layers, one after the other, each with its place among all."""
    return F.transform(F.concat(*layers), lambda s, i: changed(s, ord=i))
