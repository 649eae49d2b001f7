"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Base measures of a text are computed by built-in functions alone. For each (language,
source) the shares of junk (symbols, repeated lines, repeated words, and words that are too
short or too long on average) go into quantile sketches: counts of integer buckets whose
bounds grow geometrically, so that sketches of any parts of the data merge by addition
and a quantile is known to within the bucket's relative width, 1/128.

A group's upper limit is its own median plus a multiple of the distance from its lower
quartile to its median. Both lie in the clean part of the texts as long as less than half
of them are junk, so junk does not raise the limit that is to reject it, and a group whose
texts are alike has a tighter limit than one whose texts vary. Where that distance is next
to nothing (most texts have no symbols at all) a least spread stands for it. Lest a source
that is mostly junk set its own limit, that reaches beyond its language's median at most
``reach`` times as far as the language's own limit does, and at least as far as the least
spread allows; a language's is held to the corpus's likewise. Groups of few texts take their language's limit, and languages of few
texts the whole corpus's; the coarser sketches are sums of the finer ones.

Shuffles: narrow rows only. Sketch buckets are summed map-side, so a source with a third
of all rows sends no more than any other. The limits, one row a group, are broadcast
only while they are few; beyond that they are joined by the group, which adaptive
execution splits where it is skewed.

Cases: a null or empty text has no words and fails the base rule; a null language or
source is a group like others; equal rows are measured once each; an empty table gives
no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import kernels as K
from spanforge.llm.kernels import saved

WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("symbols", "dup_lines", "repeats", "short", "long")
#: The least spread (parts in 10,000; for short and long: 10,000 times words a letter, and letters a word times 100).
LEAST_SPREAD = {"symbols": 50, "dup_lines": 400, "repeats": 400, "short": 40, "long": 12}
#: Sketch buckets to each doubling; lesser whole numbers have one each.
SUB = 128
MAX_BROADCAST_GROUPS = 100_000


def measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with the columns of ``BASE``."""
    kept = [c for c in docs.columns if c not in BASE]
    t, w, lines, h = (K.free_name(docs.columns, c) for c in ("_t", "_w", "_l", "_h"))
    out = docs.select(*kept, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(t)).withColumns(
        {
            w: F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)),
            lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
        }
    )
    out = out.select(
        *kept,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _window_hashes(F.col(w)).alias(h),
    )
    return out.select(*kept, *BASE[:4], F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_covered(h)).cast("bigint").alias("n_repeat_words"))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three consecutive words."""
    n = F.size(words)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _covered(hashes: str) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Windows sort by (hash, place); those equal to a neighbour are repeats. Their places,
    sorted again, each cover three words less the overlap with the place before.
    """
    ordered = F.array_sort(F.transform(F.col(hashes), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = F.arrays_zip(ordered.alias("x"), F.slice(F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered), 1, F.size(hashes)).alias("p"), F.concat(F.slice(ordered, 2, F.size(hashes)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("n"))
    places = F.sort_array(F.transform(F.filter(pairs, lambda z: (z["x"]["h"] == z["p"]["h"]) | (z["x"]["h"] == z["n"]["h"])), lambda z: z["x"]["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])


def _shares() -> dict[str, Column]:
    """The junk measures as whole numbers, exact in SQL everywhere."""

    def part(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"10000 * {a} div {b}")).otherwise(F.lit(0)).cast("bigint")

    return {
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines * 12", "n_words"),
        "repeats": part("n_repeat_words", "n_words"),
        "short": part("n_words", "word_chars"),
        "long": F.when(F.col("n_words") > 0, F.expr("100 * word_chars div n_words")).otherwise(F.lit(0)).cast("bigint"),
    }


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number: those below SUB alone, then SUB to each doubling, so within 1/SUB of the value."""
    low = SUB.bit_length() - 1
    power = F.length(F.bin(F.greatest(value, F.lit(1).cast("bigint")))) - 1
    step = F.pow(F.lit(2.0), (power - low).cast("double")).cast("bigint")
    return F.when(value < SUB, value).otherwise((power - low + 1) * SUB + (F.floor(value / step) - SUB)).cast("int")


def upper(b: Column) -> Column:
    """The greatest whole number of a bucket."""
    step = F.pow(F.lit(2.0), (F.floor(b / SUB) - 1).cast("double"))
    return F.when(b < SUB, b).otherwise((F.pmod(b, F.lit(SUB)) + SUB + 1) * step - 1).cast("bigint")


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: rows (groups, measure, bucket, n). Sketches merge by summing n."""
    shares = _shares()
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(c).alias("bucket")) for m, c in shares.items())))
    return measured.select(*groups, pairs.alias("s")).groupBy(*groups, "s.measure", "s.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of sketches over coarser groups."""
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], qs: dict[str, float]) -> DataFrame:
    """Each group's and measure's quantiles and number of texts; the sketch's buckets are few, whatever the data."""
    held = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    found = sketches.groupBy(*groups, "measure").agg(held.alias("held"), F.sum("n").alias("total"))

    def at(q: float) -> Column:
        rank = F.ceil(F.col("total") * F.lit(round(q * 1000)) / 1000)
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("b"))
        hit = F.aggregate("held", zero, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["b"].isNotNull(), a["b"]).when(a["n"] + x["n"] >= rank, x["bucket"]).alias("b")), lambda a: a["b"])
        return upper(hit)

    return found.select(*groups, "measure", "total", *(at(q).alias(name) for name, q in qs.items()))


def limits(measured: DataFrame, *, groups: tuple[str, str] = ("lang", "source"), least: int = 50, spread: int = 8, reach: int = 4) -> DataFrame:
    """One row a (language, source): an upper limit for each measure.

    ``q50 + spread * (q50 - q25)`` of the group; at most ``reach`` times as far above its language's median as the
    language's limit, and at least ``spread`` least spreads; the language's limit where it has fewer than ``least`` texts.
    """
    lang, source = groups
    fine = sketch(measured, [lang, source])
    middle = merge(fine, [lang])
    coarse = merge(middle, [])
    floors = F.create_map(*(F.lit(x) for pair in LEAST_SPREAD.items() for x in pair))

    def rows(sketches: DataFrame, keys: list[str], level: str) -> DataFrame:
        q = quantiles(sketches, keys, {"q25": 0.25, "q50": 0.5})
        own = F.col("q50") + spread * F.greatest(F.col("q50") - F.col("q25"), F.element_at(floors, F.col("measure")).cast("bigint"))
        return q.select(*keys, "measure", (F.col("total") >= least).alias(f"_{level}_many"), F.col("q50").alias(f"_{level}_mid"), own.alias(f"_{level}"))

    a, b, c = rows(fine, [lang, source], "a"), rows(middle, [lang], "b").withColumnsRenamed({lang: "_lang", "measure": "_m"}), rows(coarse, [], "c").withColumnRenamed("measure", "_n")
    joined = a.join(b, a[lang].eqNullSafe(b["_lang"]) & (a["measure"] == b["_m"])).join(c, a["measure"] == c["_n"])

    def within(level: str, mid: str, limit: str) -> Column:
        most, fewest = F.expr(f"{mid} + {reach} * ({limit} - {mid})"), F.col(mid) + spread * F.element_at(floors, F.col("measure")).cast("bigint")
        return F.when(F.col(f"_{level}_many"), F.greatest(F.least(f"_{level}", most), fewest)).otherwise(F.col(limit))

    joined = joined.withColumn("_b", within("b", "_c_mid", "_c")).withColumn("_b_mid", F.when(F.col("_b_many"), F.col("_b_mid")).otherwise(F.col("_c_mid")))
    return joined.groupBy(lang, source).pivot("measure", list(MEASURES)).agg(F.first(within("a", "_b_mid", "_b"))).withColumnsRenamed({m: f"max_{m}" for m in MEASURES})


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), **options) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, the group's limits, and ``kept``: not failed and within all limits."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[groups[0]].alias("lang"), docs[groups[1]].alias("source"), docs[text_col].alias("text"))
    narrow = saved(measures(own).drop("text"), "quality")
    bounds = saved(limits(narrow, **options), "limits").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if bounds.count() <= MAX_BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    found = narrow.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for m, share in _shares().items():
        within = within & (share <= F.col(f"max_{m}"))
    return found.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"), *(f"max_{m}" for m in MEASURES))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, their own columns."""
    id_col = options.get("id_col", "doc_id")
    good = judge(docs, **options).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["_id"]), "left_semi")
