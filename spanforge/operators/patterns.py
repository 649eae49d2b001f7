"""The deterministic layer: pattern spans of a text as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.checksums import valid_fiscal_code, valid_iban, valid_vat_number
from spanforge.functions.folds import empty
from spanforge.functions.regex import built_once, scan_if
from spanforge.operators.rules import RULES, Rule

#: A span. ``ord`` is its place among spans as they were found; ``checksum_valid`` is set for fiscal codes alone.
SPAN = "struct<start:int,end:int,label:string,source:string,score:double,ord:int,checksum_valid:string>"


def span(start: Column, end: Column, label: Column | str, source: Column | str, score: Column | float = 1.0, order: Column | int = 0, checksum_valid: Column | None = None) -> Column:
    """A value of type ``SPAN``."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    valid = checksum_valid if checksum_valid is not None else F.lit(None).cast("string")
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        as_column(label).alias("label"),
        as_column(source).alias("source"),
        as_column(score).cast("double").alias("score"),
        as_column(order).cast("int").alias("ord"),
        valid.alias("checksum_valid"),
    )


FIELDS = ("start", "end", "label", "source", "score", "ord", "checksum_valid")


def changed(s: Column, **new: Column) -> Column:
    """A span with some fields replaced, spelt out field by field.

    ``s`` should be a plain variable or column: ``withField`` would repeat whatever it is once a field, and so would this.
    """
    return F.struct(*(new.get(f, s[f]).alias(f) for f in FIELDS))


def is_certified_mail(value: Column) -> Column:
    """True for addresses of certified electronic mail."""
    low = F.lower(value)
    return low.contains(".pec.") | low.endswith(".pec.it")


def valid_ipv4(value: Column) -> Column:
    """True if all four numbers are at most 255."""
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


_VALID = {"PARTITA_IVA": valid_vat_number, "IBAN_IT": valid_iban, "IP_ADDRESS": valid_ipv4}


def rule_spans(text: Column, rule: Rule, order: int = 0) -> Column:
    """The valid spans of one rule."""
    needs = {"digit": text.rlike(r"(?U)\d"), "@": text.contains("@"), "id-": text.rlike("(?iU)id-")}[rule.needs]
    found = scan_if(needs, text, rule.pattern, rule.group)
    if rule.label in _VALID:
        found = F.filter(found, lambda m: _VALID[rule.label](m["value"]))

    def one(m: Column) -> Column:
        label = F.when(is_certified_mail(m["value"]), "PEC").otherwise("EMAIL") if rule.label == "EMAIL" else rule.label
        valid = valid_fiscal_code(m["value"]).cast("string") if rule.label == "CODICE_FISCALE" else None
        return span(m["start"], m["end"], label, "pattern", 1.0, order, valid)

    return F.transform(found, one)


def detect_patterns(text: Column, labels: tuple[str, ...] | None = None) -> Column:
    """All pattern spans by (start, end), equal ones in rule order; an empty array for null. ``labels`` selects rules."""
    if unknown := set(labels or ()) - {rule.label for rule in RULES}:
        raise ValueError(f"no rules for {', '.join(sorted(unknown))}")
    parts = [rule_spans(text, rule, i) for i, rule in enumerate(RULES) if labels is None or rule.label in labels]
    if not parts:
        return empty(SPAN)
    interesting = text.rlike(r"(?U)\d|@|(?i:id-)")
    ordered = by_keys(F.concat(*parts), lambda s: (s["start"], s["end"], s["ord"]))
    return F.when(interesting, F.transform(ordered, lambda s, i: changed(s, ord=i))).otherwise(empty(SPAN))


def by_keys(spans: Column, keys) -> Column:
    """Spans in ascending order of what ``keys`` makes of each: whole values sort by their own order, without a comparator."""

    def keyed(s: Column) -> Column:
        return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys(s))), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, keyed)), lambda x: x["s"])


def with_raw_spans(df: DataFrame, text_col: str = "text", out: str = "raw_spans", labels: tuple[str, ...] | None = None) -> DataFrame:
    """The frame with the pattern spans of a text column, of the rules of ``labels`` if given."""
    return df.withColumn(out, _detected(text_col, labels))


@built_once
def _detected(text_col: str, labels: tuple[str, ...] | None) -> Column:
    return detect_patterns(F.col(text_col), labels)
