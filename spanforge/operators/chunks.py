"""Overlapping text windows for statistical detectors, and the predicate that skips them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.folds import appended, empty
from spanforge.functions.regex import piece

WINDOW = "struct<start:int,end:int>"


def windows(text: Column, size: int = 1500, overlap: int = 100) -> Column:
    """Windows that cover the text: at most ``size`` long, each but the last moved back to just after the last blank in its
    final fifth if there is one, the next one ``overlap`` (at most half of size) before its end."""
    n = F.char_length(text)
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    if size <= 0:
        return whole
    overlap, fifth = max(0, min(overlap, size // 2)), max(1, size // 5)
    # every window moves on by at least this much
    least = max(1, size - fifth - overlap)

    def step(at: Column, _: Column) -> tuple[Column, Column]:
        hard = F.least(at + size, n)
        tail = piece(text, hard - fifth, hard)
        back = F.char_length(F.regexp_extract(tail, r"[ \n\t\r]([^ \n\t\r]*)\z", 1))
        end = F.when((hard < n) & tail.rlike(r"[ \n\t\r]"), hard - back).otherwise(hard)
        after = F.when(at < 0, at).when(end >= n, -1).otherwise(F.greatest(end - overlap, at + 1))
        return after, F.when(at < 0, empty(WINDOW)).otherwise(F.array(F.struct(at.alias("start"), end.alias("end"))))

    found = appended(F.sequence(F.lit(0), F.floor(n / least).cast("int")), F.lit(0), WINDOW, step)
    return F.when(n <= size, whole).otherwise(found)


def skips_models(path: Column, text: Column, extensions: tuple[str, ...] = (".log",), least: int = 8000) -> Column:
    """True for long texts from files with one of the extensions."""
    if not extensions:
        return F.lit(False)
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return suffix.isin(*[e.lower() for e in extensions]) & (F.char_length(text) >= least)
