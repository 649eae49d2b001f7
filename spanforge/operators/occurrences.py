"""Many values searched for in one text at once.

The values become one pattern, a tree that shares what they begin with, and one pass finds at every place of
the text the longest value that begins there; values that it begins with are there as well. Hits meet
their values by sorting. The work grows with the text, the values and the hits, not with their product.
Each step is a column of its own, as one expression of all would be too deep for the analyzer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.folds import appended, bound, empty, first_of_runs, with_previous
from spanforge.functions.regex import built_once

#: Characters of a value that the tree shares; what follows them stands as it is.
DEPTH = 24
HIT = "struct<i:int,start:int,end:int>"
KEYED = "struct<key:string,start:int,i:int,value:string>"
_BLANK = "\n"


def folded(value: Column) -> Column:
    """The value with each character as a pattern in any case takes it: one lower-case character for one."""

    def one(c: Column) -> Column:
        up = F.upper(c)
        return F.left(F.lower(F.when(F.char_length(up) == 1, up).otherwise(c)), F.lit(1))

    each = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1))), lambda i: one(F.substring(value, i, F.lit(1))))
    return F.when(value.rlike(r"\A\p{ASCII}*\z"), F.lower(value)).otherwise(F.array_join(each, ""))


def keyed(values: Column) -> Column:
    """Values (value, i) with what they fold to, in its order; of several that fold to the same the first."""
    with_keys = F.array_sort(F.transform(values, lambda v: F.struct(folded(v["value"]).alias("key"), F.lit(-1).alias("start"), v["i"].alias("i"), v["value"].alias("value"))))
    return first_of_runs(with_keys, lambda x, p: x["key"] == p["key"])


def tree_pattern(entries: Column) -> Column:
    """One pattern for keyed values in ascending order: the longest first wherever one begins with another."""
    literal = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    opened = lambda x: F.least(F.coalesce(F.char_length(x["key"]), F.lit(0)), F.lit(DEPTH))

    def shared(x: Column, before: Column) -> Column:
        upto = F.least(opened(x), opened(before))
        return F.when(upto > 0, F.size(F.filter(F.sequence(F.lit(1), upto), lambda i: F.left(x["key"], i) == F.left(before["key"], i)))).otherwise(0)

    def branch(y: Column) -> Column:
        x, before, n = y["x"], y["p"], y["n"]
        steps = F.when(n < opened(x), F.array_join(F.transform(F.sequence(n + 1, opened(x)), lambda i: F.concat(literal(F.substring(x["value"], i, F.lit(1))), F.lit("(?:"))), "")).otherwise("")
        rest = F.when(F.char_length(x["key"]) > DEPTH, literal(F.substring(x["value"], F.lit(DEPTH + 1), F.char_length(x["key"])))).otherwise("")
        turn = F.when(before.isNull(), "").otherwise(F.concat(F.repeat(F.lit(")"), opened(before) - n), F.lit("|")))
        return F.concat(turn, steps, rest)

    with_shared = with_previous(F.reverse(entries), lambda x, p: F.struct(x.alias("x"), p.alias("p"), shared(x, p).alias("n")))
    return F.concat(F.lit("(?iu)(?=("), F.array_join(F.transform(with_shared, branch), ""), F.repeat(F.lit(")"), opened(F.get(entries, F.lit(0)))), F.lit("))"))


def longest_hits(text: Column, pattern: Column) -> Column:
    """(key, start) wherever a value begins: what the longest one folds to."""
    # with a blank before it no match is at the very beginning, where splitting would leave out the empty piece
    held = F.concat(F.lit(_BLANK), text)
    step = lambda at, piece: (at + F.char_length(piece), F.array(at + F.char_length(piece) - 1))
    starts = appended(F.split(held, pattern, -1), F.lit(0), "int", step)
    both = F.zip_with(F.regexp_extract_all(held, pattern, F.lit(1)), starts, lambda v, at: F.struct(v.alias("value"), at.alias("start")))
    return F.transform(F.filter(both, lambda m: m["value"].isNotNull()), lambda m: F.struct(folded(m["value"]).alias("key"), m["start"].alias("start")))


def probes(longest: Column, entries: Column) -> Column:
    """Every place where a value may begin, with what it would fold to. A value that another begins with is there too; where
    there are no such values this is spared."""
    at = lambda key, start: F.struct(key.alias("key"), start.alias("start"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("value"))
    nested = F.exists(with_previous(entries, lambda x, p: F.coalesce(F.startswith(x["key"], p["key"]), F.lit(False))), lambda x: x)
    lengths = F.array_distinct(F.transform(entries, lambda x: F.char_length(x["key"])))
    shorter = lambda m, ns: F.transform(F.filter(ns, lambda n: n <= F.char_length(m["key"])), lambda n: at(F.left(m["key"], n), m["start"]))
    return F.when(nested, bound(lengths, lambda ns: F.flatten(F.transform(longest, lambda m: shorter(m, ns))))).otherwise(F.transform(longest, lambda m: at(m["key"], m["start"])))


def hits(entries: Column, found: Column) -> Column:
    """All hits as (i, start, end): each value's from left to right, without overlaps among its own."""

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        known, free = state["key"] == x["key"], x["start"] >= state["upto"]
        end = x["start"] + F.char_length(x["key"])
        value = F.struct(x["key"].alias("key"), x["i"].alias("i"), F.lit(0).alias("upto"))
        taken = F.struct(state["key"].alias("key"), state["i"].alias("i"), end.alias("upto"))
        hit = (x["start"] >= 0) & known & free
        return F.when(x["start"] < 0, value).when(hit, taken).otherwise(state), F.when(hit, F.array(F.struct(state["i"].alias("i"), x["start"].alias("start"), end.alias("end")))).otherwise(empty(HIT))

    zero = F.struct(F.lit("").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("upto"))
    return appended(F.array_sort(F.concat(entries, found)), zero, HIT, step)


#: The steps in their order: a column's name, what it is made of, and how.
STEPS = (("_entries", ("_values",), keyed), ("_pattern", ("_entries",), tree_pattern), ("_longest", ("text", "_pattern"), longest_hits), ("_probes", ("_longest", "_entries"), probes), ("_together", ("_entries", "_probes"), hits))


@built_once
def _step(name: str, *columns: str) -> Column:
    return next(make for step, _, make in STEPS if step == name)(*map(F.col, columns))


def with_together(df: DataFrame, text_col: str, values_col: str, out: str, least: int = 0) -> DataFrame:
    """The frame with all hits of an array of values (value, i): those of each value from left to right, without overlaps among its
    own, as (i, start, end). Null where a text has no more than ``least`` values."""
    name = {"text": text_col, "_values": values_col}
    df = df.withColumn("_few", F.size(values_col) <= least)
    for step, needs, _ in STEPS:
        df = df.withColumn(step, F.when(~F.col("_few"), _step(step, *(name.get(n, n) for n in needs))))
    return df.withColumn(out, F.col("_together")).drop("_few", *(step for step, _, _ in STEPS))
