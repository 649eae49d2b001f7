"""Span resolution: from raw spans of all layers to disjoint, labelled spans.

Each step is a function of the text and an array of spans, so it needs no shuffle and works
in batch and in streams alike. ``with_resolved`` puts them together in stages, one column a
step, so that no step is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.config import ALIASES, COMMON_WORDS, PRIORITY, TRIMMED, VEHICLES
from spanforge.functions.folds import appended, bound, empty, first_of_runs, place
from spanforge.functions.regex import built_once, piece, quoted, scan
from spanforge.operators import occurrences
from spanforge.operators.patterns import SPAN, by_keys, changed, span
from spanforge.operators.rules import NAME_LIKE, URL_LIKE

MAX_GAP = 3
#: Spans of a cluster, and values of a text, up to which looking at each is quicker than sorting and halving.
SMALL = 12


def normalized_label(label: Column) -> Column:
    """The label in upper case, telephone labels as one."""
    low = F.upper(label)
    for old, new in ALIASES.items():
        low = F.when(F.upper(label) == old, new).otherwise(low)
    return low


def priority(source: Column) -> Column:
    """The weight of a source; 0 for one unknown."""
    out = F.lit(0)
    for name, weight in PRIORITY.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def _value(text: Column, s: Column) -> Column:
    return piece(text, s["start"], s["end"])


def split_lines(text: Column, spans: Column) -> Column:
    """Spans that hold line ends become one span a line; blank lines give none."""

    def parts(s: Column) -> Column:
        lines = F.split(_value(text, s), "\n", -1)

        def step(at: Column, line: Column) -> tuple[Column, Column]:
            end = at + F.char_length(line)
            one = F.array(span(at, end, s["label"], s["source"], s["score"], s["ord"]))
            return end + 1, F.when(line.rlike(r"(?U)\S"), one).otherwise(empty(SPAN))

        return appended(lines, s["start"], SPAN, step)

    return F.flatten(F.transform(spans, lambda s: F.when(F.contains(_value(text, s), F.lit("\n")), parts(s)).otherwise(F.array(s))))


def trim_separators(text: Column, spans: Column) -> Column:
    """Spans of statistical layers lose separators at both ends; those of nothing else are dropped."""

    def trimmed(s: Column) -> Column:
        value = _value(text, s)
        left = F.char_length(value) - F.char_length(F.regexp_replace(value, f"^[{TRIMMED}]+", ""))
        right = F.char_length(value) - F.char_length(F.regexp_replace(value, f"[{TRIMMED}]+\\z", ""))
        moved = changed(s, start=s["start"] + left, end=F.greatest(s["end"] - right, s["start"] + left))
        return F.when(s["source"].isin("opf", "gliner"), moved).otherwise(s)

    return F.filter(F.transform(spans, trimmed), lambda s: ~s["source"].isin("opf", "gliner") | (s["start"] < s["end"]))


def drop_common_words(text: Column, spans: Column) -> Column:
    """Spans that are one of the common words, in any case, are dropped."""
    return F.filter(spans, lambda s: ~F.lower(_value(text, s)).isin(*COMMON_WORDS))


def canonical(spans: Column) -> Column:
    """Spans by (start, end, priority descending, place among those found)."""
    return by_keys(spans, lambda s: (s["start"], s["end"], -priority(s["source"]), s["ord"]))


def merge_adjacent(text: Column, ordered: Column, gap: int = MAX_GAP) -> Column:
    """Neighbouring spans of one label, at most ``gap`` (three) characters apart on one line, become one.

    The merged span takes its source and score from the member that is first among the greatest by (priority, length,
    score). ``ordered`` must be in canonical order.
    """
    weighed = F.transform(ordered, lambda s: F.struct(s.alias("s"), normalized_label(s["label"]).alias("label"), priority(s["source"]).alias("p"), (s["end"] - s["start"]).alias("n")))

    def step(cur: Column, x: Column) -> tuple[Column, Column]:
        s = x["s"]
        near = cur.isNotNull() & (s["start"] <= cur["end"] + gap) & (x["label"] == cur["label"])
        joins = near & ~F.contains(F.substring(text, cur["end"] + 1, F.greatest(s["start"] - cur["end"], F.lit(0))), F.lit("\n"))
        rank = lambda y, score: F.struct(y["p"], y["n"], score)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), x["label"].alias("label"), F.struct(x["p"].alias("p"), x["n"].alias("n"), s["score"].alias("score"), s["source"].alias("source")).alias("best"))
        best = F.when(rank(x, s["score"]) > rank(cur["best"], cur["best"]["score"]), new["best"]).otherwise(cur["best"])
        wide = F.struct(cur["start"].alias("start"), F.greatest(cur["end"], s["end"]).alias("end"), cur["label"].alias("label"), best.alias("best"))
        return F.when(joins, wide).otherwise(new), F.when(joins | cur.isNull(), empty(SPAN)).otherwise(F.array(_closed(cur)))

    merged = appended(weighed, F.lit(None).cast(_OPEN), SPAN, step, lambda cur, out: F.when(cur.isNull(), out).otherwise(F.concat(out, F.array(_closed(cur)))))
    return F.transform(merged, lambda s, i: changed(s, ord=i))


_OPEN = "struct<start:int,end:int,label:string,best:struct<p:int,n:int,score:double,source:string>>"


def _closed(group: Column) -> Column:
    """A group of neighbours as a span."""
    return span(group["start"], group["end"], group["label"], group["best"]["source"], group["best"]["score"])


def keep_disjoint(spans: Column) -> Column:
    """The spans that overlap no span of higher priority, then greater length, then lower start; by start.

    Where no neighbours by start overlap, all stay. Else spans fall into clusters, each begun by a span that starts where
    or after all before it ended, and are settled within their cluster.
    """

    def settled(xs: Column) -> Column:
        overlaps = F.exists(F.transform(xs, lambda s, i: F.coalesce(F.get(xs, i - 1)["end"] > s["start"], F.lit(False))), lambda x: x)
        return F.when(overlaps, bound(_cluster_starts(xs), lambda at: F.flatten(F.transform(at, lambda a, i: _of_cluster(F.slice(xs, a, F.coalesce(F.get(at, i + 1), F.size(xs) + 1) - a)))))).otherwise(xs)

    by_start = by_keys(spans, lambda s: (s["start"], s["end"], s["ord"]))
    kept = bound(by_start, settled)
    return F.transform(by_keys(kept, lambda s: (s["start"], s["ord"])), lambda s, i: changed(s, ord=i))


def _cluster_starts(by_start: Column) -> Column:
    """The places, from 1, of the spans that begin a cluster."""

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        after = F.struct(F.greatest(state["reach"], s["end"]).alias("reach"), (state["at"] + 1).alias("at"))
        return after, F.when((state["at"] == 0) | (s["start"] >= state["reach"]), F.array(state["at"] + 1)).otherwise(empty("int"))

    return appended(by_start, F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("at")), "int", step)


def _of_cluster(spans: Column) -> Column:
    """The spans of one cluster that stay, by start."""

    def settled(xs: Column) -> Column:
        by_rank = by_keys(xs, lambda s: (-priority(s["source"]), s["start"] - s["end"], s["start"], s["ord"]))
        few = F.aggregate(by_rank, empty(SPAN), lambda kept, c: F.when(F.exists(kept, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"])), kept).otherwise(F.concat(kept, F.array(c))))
        return F.when(F.size(xs) == 1, xs).when(F.size(xs) <= SMALL, few).otherwise(F.aggregate(by_rank, empty(SPAN), _placed))

    return bound(spans, settled)


def _placed(kept: Column, c: Column) -> Column:
    """Disjoint spans by start, with one more in its place if it overlaps none: only the last that starts before its end can."""

    def put(at: Column) -> Column:
        return F.when((at > 0) & (F.get(kept, at - 1)["end"] > c["start"]), kept).otherwise(F.concat(F.slice(kept, F.lit(1), at), F.array(c), F.slice(kept, at + 1, F.size(kept))))

    return bound(place(kept, lambda k: k["start"] < c["end"]), put)


def drop_misread(text: Column, spans: Column) -> Column:
    """Persons with digits, links without a link, and licences that are vehicles are dropped; account numbers that read
    like names become persons."""

    def fine(s: Column) -> Column:
        v = _value(text, s)
        bad = (s["label"] == "PERSONA") & v.rlike(r"(?U)\d") | (s["label"] == "URL") & ~v.rlike(URL_LIKE) | (s["label"] == "PATENTE") & F.regexp_replace(F.lower(v), r"(?U)^\s+|\s+$", "").isin(*VEHICLES)
        return ~bad

    named = lambda s: changed(s, label=F.when((s["label"] == "ACCOUNT_NUMBER") & _value(text, s).rlike(NAME_LIKE), "PERSONA").otherwise(s["label"]))
    return F.transform(F.filter(spans, fine), named)


def wordy_values(text: Column, spans: Column) -> Column:
    """The values of two or more words, in upper case with single blanks, as (value, i): i is the place of the first span that has it."""
    collapse = lambda v: F.upper(F.regexp_replace(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    named = F.transform(spans, lambda s, i: F.struct(_value(text, s).alias("value"), i.alias("i")))
    several = F.filter(named, lambda x: x["value"].rlike(r"(?U)\S\s+\S"))
    wordy = F.array_sort(F.transform(several, lambda x: F.struct(collapse(x["value"]).alias("value"), x["i"].alias("i"))))
    return first_of_runs(wordy, lambda x, p: x["value"] == p["value"])


def each_value(text: Column, values: Column) -> Column:
    """The hits of values one after the other, as (i, start, end)."""
    return F.flatten(F.transform(values, lambda v: F.transform(scan(text, quoted(v["value"])), lambda m: F.struct(v["i"].alias("i"), m["start"].alias("start"), m["end"].alias("end")))))


def new_hits(hits: Column, spans: Column) -> Column:
    """Hits by (i, start) without those whose place is a span's or an earlier hit's."""
    places = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("i"))), F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["i"].alias("i"))))
    new = first_of_runs(F.array_sort(places), lambda x, p: (x["start"] == p["start"]) & (x["end"] == p["end"]))
    return F.array_sort(F.transform(F.filter(new, lambda x: x["i"] >= 0), lambda x: F.struct(x["i"].alias("i"), x["start"].alias("start"), x["end"].alias("end"))))


def covering(hits: Column, spans: Column) -> Column:
    """Spans for hits, each with label, source and score of the span that it is an occurrence of."""
    like = lambda h, n: bound(F.get(spans, h["i"]), lambda s: span(h["start"], h["end"], s["label"], s["source"], s["score"], F.size(spans) + n))
    return F.transform(hits, like)


def other_occurrences(df: DataFrame, spans_col: str, text_col: str = "text", out: str = "more") -> DataFrame:
    """The frame with spans for every further occurrence, in any case, of each value of two or more words; the value's first
    span gives label, source and score. More than some values of a text are searched for together."""
    df = df.withColumn("_wordy", _wordy(text_col, spans_col))
    df = occurrences.with_together(df, text_col, "_wordy", "_many", SMALL)
    df = df.withColumn("_hits", F.coalesce("_many", _each(text_col, "_wordy"))).withColumn("_new", _new("_hits", spans_col))
    return df.withColumn(out, _covering("_new", spans_col)).drop("_wordy", "_many", "_hits", "_new")


@built_once
def _wordy(text_col: str, spans_col: str) -> Column:
    text, s = F.col(text_col), F.col(spans_col)
    return wordy_values(text, s)


@built_once
def _each(text_col: str, values_col: str) -> Column:
    return each_value(F.col(text_col), F.col(values_col))


@built_once
def _new(hits_col: str, spans_col: str) -> Column:
    hits = F.col(hits_col)
    return F.when(F.size(hits) > 0, new_hits(hits, F.col(spans_col))).otherwise(hits)


@built_once
def _covering(hits_col: str, spans_col: str) -> Column:
    return covering(F.col(hits_col), F.col(spans_col))


def resolve(df: DataFrame, spans_col: str, text_col: str = "text", out: str = "spans", gap: int = MAX_GAP) -> DataFrame:
    """The frame with resolved spans: lines split, separators trimmed, common words dropped, neighbours merged, overlaps
    settled. No spans at all, before or after, give an empty array."""
    df = df.withColumn("_clean", _cleaned(text_col, spans_col))
    df = df.withColumn("_merged", _merged(text_col, "_clean", gap))
    return df.withColumn(out, _settled("_merged")).drop("_clean", "_merged")


@built_once
def _cleaned(text_col: str, spans_col: str) -> Column:
    text = F.col(text_col)
    return canonical(drop_common_words(text, trim_separators(text, split_lines(text, F.col(spans_col)))))


@built_once
def _merged(text_col: str, spans_col: str, gap: int) -> Column:
    return merge_adjacent(F.col(text_col), F.col(spans_col), gap)


@built_once
def _settled(spans_col: str) -> Column:
    return keep_disjoint(F.col(spans_col))


@built_once
def _read_right(text_col: str, spans_col: str) -> Column:
    return drop_misread(F.col(text_col), F.col(spans_col))


def with_resolved(df: DataFrame, raw_col: str, text_col: str = "text", out: str = "spans", gap: int = MAX_GAP) -> DataFrame:
    """The frame with final spans: resolved, misreadings dropped, all occurrences covered, and resolved again if any was added."""
    s, more = F.col("_once"), F.col("_more")
    df = resolve(df, raw_col, text_col, "_first", gap)
    df = df.withColumn("_once", _read_right(text_col, "_first")).drop("_first")
    df = other_occurrences(df, "_once", text_col, "_more")
    df = df.withColumn("_both", F.when(F.size(more) > 0, F.concat(s, more)).otherwise(empty(SPAN)))
    df = resolve(df, "_both", text_col, "_again", gap)
    return df.withColumn(out, F.when(F.size(more) > 0, F.col("_again")).otherwise(s)).drop("_once", "_more", "_both", "_again")


def category_counts(spans: Column) -> Column:
    """Spans by label, as a map in order of first appearance."""
    labels = F.transform(spans, lambda s: s["label"])
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x)))))


def source_counts(spans: Column, *more: Column) -> Column:
    """How many spans each layer gave, and all; further fields may follow."""
    many = lambda name: F.size(F.filter(spans, lambda s: s["source"] == name))
    return F.struct(many("opf").alias("opf_spans"), many("gliner").alias("gliner_spans"), many("pattern").alias("pattern_spans"), F.size(spans).alias("merged_unique_spans"), *more)
