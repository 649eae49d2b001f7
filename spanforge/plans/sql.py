"""The SQL surface: functions of the catalog for spans, masked texts and counts.

    create_functions(spark)
    SELECT doc_id, mask_text(text) FROM documents
    SELECT d.doc_id, s.* FROM documents d, LATERAL spans(d.text) s

They are SQL functions: their bodies are the text of the library's own expressions, so the optimizer sees built-in functions,
no Python runs, and whoever has the catalog can use them from any client. Each step of detection and masking is a
function of its own (``spanforge_...``), as one expression of all steps would be too deep for the analyzer; a step's
arguments are evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanforge.config import MaskingMode
from spanforge.operators import masking, occurrences, patterns, resolver
from spanforge.operators.patterns import SPAN

_INFIX = {"=", "==", "<=>", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "and", "or"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def sql_text(column: Column) -> str:
    """SQL that means what a column of built-in functions means."""
    return _written(column._jc.node())


def _written(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return node.sql()
    if kind == "UnresolvedAttribute":
        return ".".join(map(_name, _items(node.nameParts())))
    if kind == "UnresolvedNamedLambdaVariable":
        return _name(node.name())
    if kind == "Alias":
        return f"{_written(node.child())} AS {_name(node.name().apply(0))}"
    if kind == "Cast":
        how = "TRY_CAST" if node.evalMode().isDefined() and "TRY" in str(node.evalMode().get()).upper() else "CAST"
        return f"{how}({_written(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        arms = " ".join(f"WHEN {_written(b._1())} THEN {_written(b._2())}" for b in _items(node.branches()))
        return f"(CASE {arms}{f' ELSE {_written(node.otherwise().get())}' if node.otherwise().isDefined() else ''} END)"
    if kind == "LambdaFunction":
        names = [_name(a.name()) for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_written(node.function())}"
    if kind == "UnresolvedExtractValue":
        return f"{_written(node.child())}[{_written(node.extraction())}]"
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [_written(a) for a in _items(node.arguments())]
        low = name.lower()
        if low in _INFIX and len(args) == 2:
            return f"({args[0]} {low} {args[1]})"
        if low in ("not", "!"):
            return f"(NOT {args[0]})"
        if low in ("negative", "-") and len(args) == 1:
            return f"(- {args[0]})"
        if low == "in":
            return f"({args[0]} IN ({', '.join(args[1:])}))"
        return f"{name}({', '.join(args)})"
    raise ValueError(f"no SQL for {kind}")


_TEXT, _SPANS, _KEYS, _PLAN = ("text", "STRING"), ("s", f"ARRAY<{SPAN}>"), ("k", f"ARRAY<{masking._KEYED}>"), ("p", f"ARRAY<{masking.REPLACEMENT}>")
_VALUES, _ENTRIES, _FOUND, _HITS = ("v", "ARRAY<struct<value:string,i:int>>"), ("e", f"ARRAY<{occurrences.KEYED}>"), ("f", f"ARRAY<{occurrences.KEYED}>"), ("h", f"ARRAY<{occurrences.HIT}>")
_LONGEST = ("l", "ARRAY<struct<key:string,start:int>>")


def _steps(mode: MaskingMode) -> list[tuple[str, tuple, str, Column | str]]:
    """Name, parameters, result type, and body of each step, in an order in which each only calls those before it."""
    text, s, k, v, e, f, h, p = (F.col(c) for c in ("text", "s", "k", "v", "e", "f", "h", "p"))
    clean = resolver.canonical(resolver.drop_common_words(text, resolver.trim_separators(text, resolver.split_lines(text, s))))
    few = F.size(v) <= resolver.SMALL
    return [
        ("raw", (_TEXT,), _SPANS[1], patterns.detect_patterns(text)),
        ("clean", (_TEXT, _SPANS), _SPANS[1], clean),
        ("merged", (_TEXT, _SPANS), _SPANS[1], resolver.merge_adjacent(text, s)),
        ("disjoint", (_SPANS,), _SPANS[1], resolver.keep_disjoint(s)),
        ("resolved", (_TEXT, _SPANS), _SPANS[1], "{0}disjoint({0}merged(text, {0}clean(text, s)))"),
        ("read_right", (_TEXT, _SPANS), _SPANS[1], resolver.drop_misread(text, s)),
        ("values", (_TEXT, _SPANS), _VALUES[1], resolver.wordy_values(text, s)),
        ("entries", (_VALUES,), _ENTRIES[1], F.when(~few, occurrences.keyed(v))),
        ("pattern", (_ENTRIES,), "STRING", occurrences.tree_pattern(e)),
        ("longest", (_TEXT, ("r", "STRING")), _LONGEST[1], occurrences.longest_hits(text, F.col("r"))),
        ("probes", (_LONGEST, _ENTRIES), _FOUND[1], occurrences.probes(F.col("l"), e)),
        ("together", (_ENTRIES, _FOUND), _HITS[1], occurrences.hits(e, f)),
        ("search", (_TEXT, _ENTRIES), _HITS[1], "{0}together(e, {0}probes({0}longest(text, {0}pattern(e)), e))"),
        ("each", (_TEXT, _VALUES), _HITS[1], F.when(few, resolver.each_value(text, v))),
        ("hits", (_TEXT, _VALUES), _HITS[1], "coalesce({0}each(text, v), {0}search(text, {0}entries(v)))"),
        ("new", (_HITS, _SPANS), _HITS[1], resolver.new_hits(h, s)),
        ("covering", (_HITS, _SPANS), _SPANS[1], resolver.covering(h, s)),
        ("more", (_TEXT, _SPANS), _SPANS[1], "{0}covering({0}new({0}hits(text, {0}values(text, s)), s), s)"),
        ("both", (_TEXT, _SPANS, ("m", _SPANS[1])), _SPANS[1], "if(size(m) > 0, {0}resolved(text, concat(s, m)), s)"),
        ("expanded", (_TEXT, _SPANS), _SPANS[1], "{0}both(text, s, {0}more(text, s))"),
        ("spans", (_TEXT,), _SPANS[1], "if(text IS NULL, {0}raw(text), {0}expanded(text, {0}read_right(text, {0}resolved(text, {0}raw(text)))))"),
        ("keyed", (_TEXT, _SPANS), _KEYS[1], masking.keyed(text, s)),
        ("firsts", (_KEYS,), _KEYS[1], masking.first_of_each(k)),
        ("placed", (_KEYS, ("o", _KEYS[1])), _PLAN[1], masking.replacements(k, F.col("o"), mode)),
        ("plan", (_KEYS,), _PLAN[1], "{0}placed(k, {0}firsts(k))"),
        ("filled", (_TEXT, _PLAN), "STRING", F.when(F.size(p) > 0, masking.masked(text, p)).otherwise(text)),
        ("counts", (_SPANS,), "MAP<STRING, INT>", resolver.category_counts(s)),
    ]


def create_functions(spark: SparkSession, *, database: str | None = None, mode: MaskingMode | str = MaskingMode.REPLACE) -> None:
    """Create or replace ``mask_text(text)``, ``mask_counts(text)`` and the table function ``spans(text)`` in a database, and the
    functions of their steps.

    ``mask_text`` masks in the given mode (``mask`` is a function that Spark has itself); a null text stays null. ``mask_counts`` gives spans by label, ``spans`` a row a span
    with its value; a null text has none.
    """
    at = f"{_name(database)}." if database else ""
    step = f"{at}spanforge_"

    def create(name: str, parameters: tuple, returns: str, body: Column | str) -> None:
        written = body.format(step) if isinstance(body, str) else sql_text(body)
        spark.sql(f"CREATE OR REPLACE FUNCTION {name}({', '.join(f'{n} {t}' for n, t in parameters)}) RETURNS {returns} RETURN {written}")

    for name, parameters, returns, body in _steps(MaskingMode(mode)):
        create(step + name, parameters, returns, body)
    create(f"{at}mask_text", (_TEXT,), "STRING", "{0}filled(text, {0}plan({0}keyed(text, {0}spans(text))))")
    create(f"{at}mask_counts", (_TEXT,), "MAP<STRING, INT>", "{0}counts({0}spans(text))")
    fields = "s.start, s.end, substring(text, s.start + 1, s.end - s.start), s.label, s.source, s.score"
    create(f"{at}spans", (_TEXT,), "TABLE(start INT, end INT, value STRING, label STRING, source STRING, score DOUBLE)", f"SELECT {fields} FROM (SELECT explode(a) AS s FROM (SELECT {{0}}spans(text) AS a))")
