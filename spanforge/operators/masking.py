"""Masking: consistent placeholders, the masked text, the vault, and restoring from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.config import PREFIXES, MaskingMode
from spanforge.functions.folds import empty
from spanforge.functions.regex import built_once, piece
from spanforge.functions.rows import entries
from spanforge.operators.patterns import SPAN, by_keys

REPLACEMENT = "struct<start:int,end:int,label:string,original:string,replacement:string>"
_KEYED = "struct<start:int,end:int,label:string,original:string,prefix:string,norm:string>"


def normalized_value(value: Column) -> Column:
    """Upper case, white space collapsed and stripped: what counts as the same value."""
    return F.upper(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def prefix_of(label: Column) -> Column:
    """The placeholder prefix of a label."""
    out = label
    for name, prefix in PREFIXES.items():
        out = F.when(label == name, prefix).otherwise(out)
    return out


def applied(spans: Column) -> Column:
    """The spans by start, without any that begins before the end of one applied before it."""
    ordered = by_keys(spans, lambda s: (s["start"], s["ord"]))
    zero = F.struct(F.lit(0).alias("at"), empty(SPAN).alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")))
    return F.aggregate(ordered, zero, step, lambda acc: acc["out"])


def keyed(text: Column, spans: Column) -> Column:
    """The applied spans with their original, prefix and normalized value."""

    def one(s: Column) -> Column:
        value = piece(text, s["start"], s["end"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), value.alias("original"), prefix_of(s["label"]).alias("prefix"), normalized_value(value).alias("norm"))

    return F.transform(applied(spans), one)


def first_of_each(keys: Column) -> Column:
    """The first of the keyed spans of each (label, normalized value), in order of appearance."""
    step = lambda acc, k: F.when(F.exists(acc, lambda x: (x["label"] == k["label"]) & (x["norm"] == k["norm"])), acc).otherwise(F.concat(acc, F.array(k)))
    return F.aggregate(keys, empty(_KEYED), step)


def replacements(keys: Column, firsts: Column, mode: MaskingMode | str = MaskingMode.REPLACE) -> Column:
    """Each keyed span with its placeholder: that of the first span of equal label and normalized value."""
    mode = MaskingMode(mode)

    def placeholder(k: Column) -> Column:
        first = F.get(F.filter(firsts, lambda x: (x["label"] == k["label"]) & (x["norm"] == k["norm"])), F.lit(0))
        if mode == MaskingMode.REDACT:
            return F.repeat(F.lit("█"), F.greatest(F.lit(4), F.char_length(first["original"])))
        if mode == MaskingMode.GENERALIZE:
            return F.concat(F.lit("["), k["prefix"], F.lit("]"))
        if mode == MaskingMode.HASH:
            return F.concat(F.lit("[SHA256:"), F.substring(F.sha2(first["original"], 256), 1, 12), F.lit("]"))
        same = F.transform(F.filter(firsts, lambda x: x["prefix"] == k["prefix"]), lambda x: F.struct(x["label"], x["norm"]))
        return F.concat(F.lit("["), k["prefix"], F.lit("_"), F.array_position(same, F.struct(k["label"], k["norm"])).cast("string"), F.lit("]"))

    return F.transform(keys, lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["label"].alias("label"), k["original"].alias("original"), placeholder(k).alias("replacement")))


def masked(text: Column, plan: Column) -> Column:
    """The text with its replacements: gaps and placeholders in turn, then the tail."""
    zero = F.struct(F.lit(0).alias("at"), empty("string").alias("out"))
    step = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(piece(text, acc["at"], r["start"]), r["replacement"])).alias("out"))
    return F.aggregate(plan, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))


def with_masked(df: DataFrame, spans_col: str = "spans", text_col: str = "text", mode: MaskingMode | str = MaskingMode.REPLACE, plan: str = "replacements", out: str = "masked_text") -> DataFrame:
    """The frame with its masking plan and masked text. Null texts stay null; texts without spans are passed on."""
    MaskingMode(mode)
    df = df.withColumn("_keys", _keys(text_col, spans_col))
    df = df.withColumn("_firsts", _firsts("_keys"))
    df = df.withColumn(plan, _plan("_keys", "_firsts", str(mode))).drop("_keys", "_firsts")
    return df.withColumn(out, _masked(text_col, plan))


@built_once
def _keys(text_col: str, spans_col: str) -> Column:
    return keyed(F.col(text_col), F.col(spans_col))


@built_once
def _firsts(keys_col: str) -> Column:
    return first_of_each(F.col(keys_col))


@built_once
def _plan(keys_col: str, firsts_col: str, mode: str) -> Column:
    return replacements(F.col(keys_col), F.col(firsts_col), mode)


@built_once
def _masked(text_col: str, plan_col: str) -> Column:
    return F.when(F.size(plan_col) > 0, masked(F.col(text_col), F.col(plan_col))).otherwise(F.col(text_col))


def vault(plan: Column) -> Column:
    """Placeholder -> (label, original); of several originals the last stays, at the place of the first."""
    names = F.array_distinct(F.transform(plan, lambda r: r["replacement"]))
    last = lambda name: F.element_at(F.filter(plan, lambda r: r["replacement"] == name), -1)
    return F.map_from_entries(F.transform(names, lambda name: F.struct(name, F.struct(last(name)["label"].alias("label"), last(name)["original"].alias("original")))))


def vault_rows(df: DataFrame, id_col: str = "doc_id", plan: str = "replacements") -> DataFrame:
    """The vaults as a table: one row a document and placeholder."""
    return entries(df, vault(F.col(plan)), id_col).select(id_col, F.col("key").alias("placeholder"), F.col("value.label").alias("label"), F.col("value.original").alias("original"))


def bucket_of(id_col: str, buckets: int) -> Column:
    """The vault's part that a document's entries are in."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")


def write_vault(df: DataFrame, path: str, *, id_col: str = "doc_id", plan: str = "replacements", buckets: int = 64, mode: str = "error") -> None:
    """Store the vaults of masked documents: Parquet, one folder a bucket of documents, so that restoring some reads only
    their buckets. Entries keep their place in the plan. Whoever reads this folder can undo the masking."""
    places = F.posexplode_outer(F.map_entries(vault(F.col(plan)))).alias("place", "e")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), bucket_of(id_col, buckets).alias("bucket"), places).where("place is not null")
    rows = rows.select(id_col, "bucket", "place", F.col("e.key").alias("placeholder"), F.col("e.value.label").alias("label"), F.col("e.value.original").alias("original"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", id_col, "place").write.mode(mode).partitionBy("bucket").parquet(path)


def restore_from(masked_df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "masked_text", buckets: int = 64, out: str = "restored") -> DataFrame:
    """Documents with the originals that a stored vault has for them, longer placeholders first, then by their place.

    The entries of a document are gathered by (bucket, id), with which they were stored, and meet the document's rows in
    one join; only the buckets of these documents are read. Texts without entries, null texts and null ids stay as they are;
    entries without an original are passed over. Of repeated ids each row is restored.
    """
    held = masked_df.sparkSession.read.parquet(path).where("original is not null")
    entry = F.struct((-F.char_length("placeholder")).alias("n"), "place", F.col("placeholder").alias("k"), F.col("original").alias("v"))
    stored = held.groupBy(F.col("bucket").alias("_bucket"), F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    rows = masked_df.withColumn("_of", bucket_of(id_col, buckets))
    both = rows.join(stored, (F.col("_of") == F.col("_bucket")) & (F.col(id_col) == F.col("_id")), "left")
    whole = F.when(F.size("_entries") > 0, F.aggregate("_entries", F.col(text_col), lambda t, e: F.replace(t, e["k"], e["v"]))).otherwise(F.col(text_col))
    return both.withColumn(out, whole).drop("_of", "_bucket", "_id", "_entries")


def restored(text: Column, entries: Column) -> Column:
    """The masked text with every placeholder replaced by its original, longer placeholders first; null originals are passed over."""
    held = F.filter(F.map_entries(entries), lambda e: e["value"]["original"].isNotNull())
    placed = F.transform(held, lambda e, i: F.struct((-F.char_length(e["key"])).alias("n"), i.alias("i"), e["key"].alias("k"), e["value"]["original"].alias("v")))
    return F.aggregate(F.array_sort(placed), text, lambda t, e: F.replace(t, e["k"], e["v"]))


def entity_map(plan: Column) -> Column:
    """Placeholder and label of each placeholder, by placeholder, without originals."""
    pairs = F.transform(plan, lambda r: r["replacement"])
    first = lambda name: F.get(F.filter(plan, lambda r: r["replacement"] == name), F.lit(0))["label"]
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda name: F.struct(name.alias("placeholder"), first(name).alias("label")))
