"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once; every token knows its character span (from the first
character it begins or continues, to the last it completes), and spans are joined to the
sections' character intervals by binary search on their sorted bounds: one pass, linear
in the tokens. A token whose span crosses a boundary goes by an explicit rule:

``first``  the section that holds its first character;
``last``   the section that holds its last character;
``most``   the section that holds most of its characters, the earlier one of equals.

Sections are disjoint intervals ``[begin, end)`` of code points. By default they are the
text's lines, each with its line end; ``from_fields`` makes them from several columns
joined into one text. Tokens of characters outside all sections, and the end token if
asked for, are counted for the section ``null``. So the counts of a document always sum
to the tokens of its whole text.

Cases: a null or empty text has one default section, empty, with no tokens; a null
section list has no sections; empty sections get 0; repeated rows are counted once
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import kernels as K
from spanforge.llm.tokenize import default_path, encoder

RULES = ("first", "last", "most")
SECTIONS = "array<struct<section:string,begin:bigint,end:bigint>>"


def attribute(step: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int, int]:
    """Tokens of each section, of none, and how many tokens crossed a boundary.

    ``step``: characters completed by each token; ``begins``, ``ends``: disjoint sections in order.
    """
    done = np.cumsum(step)
    first = done - step
    last = np.maximum(first, done - 1)
    k = len(begins)
    if not k:
        return np.zeros(0, np.int64), len(step), 0

    def holder(at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(begins, at, "right") - 1
        return np.where((i >= 0) & (at < ends[np.maximum(i, 0)]), i, k)

    a, b = holder(first), holder(last)
    crossing = np.flatnonzero(a != b)
    to = b if rule == "last" else a.copy()
    if rule == "most":
        for t in crossing.tolist():
            lo, hi = int(first[t]), int(last[t]) + 1
            i = max(0, int(np.searchsorted(ends, lo, "right")))
            best, share, inside = k, 0, 0
            while i < k and begins[i] < hi:
                n = min(hi, int(ends[i])) - max(lo, int(begins[i]))
                inside += n
                if n > share:
                    best, share = i, n
                i += 1
            to[t] = best if share >= hi - lo - inside else k
    counts = np.bincount(to, minlength=k + 1)
    return counts[:k], int(counts[k]), len(crossing)


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with its line end, as code point intervals."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def from_fields(docs: DataFrame, fields: list[str], *, separator: str = "\n", text_col: str = "text", sections_col: str = "sections") -> DataFrame:
    """Join columns into one text, and note each one's interval as a section of its name (a null field is empty)."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    begin, out = F.lit(0).cast("bigint"), []
    for name, value in zip(fields, values, strict=True):
        end = begin + F.char_length(value)
        out.append(F.struct(F.lit(name).alias("section"), begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))
        begin = end + len(separator)
    kept = [F.col(c) for c in docs.columns if c not in (text_col, sections_col)]
    return docs.select(*kept, F.concat_ws(separator, *values).alias(text_col), F.array(*out).alias(sections_col))


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, n_crossing, sections`` with each section's name, interval and tokens.

    The tokens outside all sections follow as a section of null name and bounds where there are any.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    K.set_batches(docs.sparkSession)
    path = tokenizer or default_path()
    given = [docs[sections_col].cast(SECTIONS).alias("_sections")] if sections_col else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n_tokens, n_crossing, edge, parts, named = [], [], [0], [], []
            for r, ids, step in enc.texts(batch.column(1), True):
                if sections_col:
                    some = sorted(batch.column(2)[r].as_py() or [], key=lambda s: (s["begin"], s["end"]))
                    names = [s["section"] for s in some]
                    begins, ends = np.array([s["begin"] for s in some], np.int64), np.array([s["end"] for s in some], np.int64)
                    if (begins > ends).any() or (ends[:-1] > begins[1:]).any():
                        raise ValueError("sections overlap or end before they begin")
                else:
                    begins, ends = lines(batch.column(1)[r].as_py() or "")
                    names = list(map(str, range(len(begins))))
                counts, none, crossing = attribute(step, begins, ends, rule)
                n_tokens.append(len(ids))
                n_crossing.append(crossing)
                parts.append((begins, ends, counts))
                named += names
                if none:
                    parts.append((np.array([-1]), np.array([-1]), np.array([none])))
                    named.append(None)
                edge.append(len(named))
            begins, ends, counts = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
            outside = begins < 0
            fields = [pa.array(named, pa.string()), pa.array(begins, mask=outside), pa.array(ends, mask=outside), pa.array(counts)]
            held = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(fields, ["section", "begin", "end", "n_tokens"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), held], ["doc_id", "n_tokens", "n_crossing", "sections"])

    section = T.StructType([T.StructField("section", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("begin", "end", "n_tokens")])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("sections", T.ArrayType(section))])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *given).mapInArrow(run, schema)


def per_section(counted: DataFrame) -> DataFrame:
    """The result of ``count`` as one row a section."""
    return counted.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section", "s.begin", "s.end", "s.n_tokens")
