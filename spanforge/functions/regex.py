"""Regular-expression scanning with code-point offsets, by built-in functions.

Spark's ``regexp_instr`` counts UTF-16 units. Here offsets come from the lengths of what
lies between matches (``split``) and of the matches themselves (``regexp_extract_all``), in
code points, added up once from left to right.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.folds import appended, empty

MATCH = "struct<start:int,end:int,value:string>"


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression that ``make`` builds from plain values, for as long as the JVM lives.

    Large expressions take thousands of calls to the JVM to build; column names do not change what they are.
    """
    kept: dict[tuple, tuple[object, Column]] = {}

    @wraps(make)
    def get(*key) -> Column:
        jvm = SparkContext._gateway
        if key not in kept or kept[key][0] is not jvm:
            kept[key] = (jvm, make(*key))
        return kept[key][1]

    return get


def scan(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """All matches of ``pattern`` from left to right as an array of (start, end, value).

    With ``group``, the group's place and value; the group must end where its match ends.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    # a match and the text before it; there is one text more than there are matches
    pairs = F.zip_with(F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rx, -1), lambda m, before: F.struct(m.alias("m"), before.alias("before")))
    if group:
        pairs = F.zip_with(pairs, F.regexp_extract_all(text, rx, F.lit(group)), lambda x, g: F.struct(x["m"].alias("m"), x["before"].alias("before"), g.alias("g")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + F.char_length(x["before"]) + F.char_length(x["m"])
        value = x["g"] if group else x["m"]
        return end, F.array(F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), value.alias("value")))

    return appended(F.filter(pairs, lambda x: x["m"].isNotNull()), F.lit(0), MATCH, step)


def scan_if(guard: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """``scan`` where ``guard`` and one quick search say there is something to find, else an empty array."""
    return F.when(guard & text.rlike(pattern), scan(text, pattern, group)).otherwise(empty(MATCH))


def quoted(value: Column) -> Column:
    """A pattern for exactly this value, in any case."""
    return F.concat(F.lit("(?iu)\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def piece(text: Column, start: Column, end: Column) -> Column:
    """The text from code point ``start`` to before ``end``."""
    return F.substring(text, start + 1, end - start)
