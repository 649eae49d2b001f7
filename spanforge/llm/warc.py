r"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. One record a page; pages of equal payload of at least ``least`` bytes have one
response record (the page of largest id) and revisit records that refer to it. Only
(id, digest) rows are grouped, never payloads, and groups of one are dropped before the
join; the rest are broadcast only while they are few. Files are written by Spark's text
writer with the record end as separator, so its commit protocol holds.

Reading. Splits of archives are cut at every occurrence of the magic ``WARC/1.0\r\n`` by
all tasks in parallel, so one large file is read by many. Every occurrence is a candidate,
whose header says where its successor would begin. A candidate is a record only if it is
reached from the file's start by successors; magic inside a payload is not. Reaching is
found by pointer jumping: within blocks of a file (bounded numbers of narrow rows) by
vectorised doubling, between blocks by doubling joins over block exits alone. A record whose
payload holds the magic lies in several pieces, which are fetched and joined for such
records only. They are fetched by a digest of their bytes, which the first read took: how
a file is split among tasks may differ from read to read.

Cases: null html is an empty payload; a null ``page_id`` is kept (``null`` in the record
id); a null url is empty and line ends in urls are escaped; rows of equal page id and
payload are all responses if theirs is the largest id; an empty table writes no record;
what follows a broken link of the chain is not reached and not returned; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.kernels import fresh, saved

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BLOCK = 16 << 20
MAX_BROADCAST = 500_000


def write(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record a page below ``folder`` (by default a new one in the shared folder), and return the folder."""
    folder = folder or fresh(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha1(F.col("html").cast("binary"))})
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "to")
    same = saved(same, "copies")
    if same.count() <= MAX_BROADCAST:
        same = F.broadcast(same)
    rows = rows.join(same, (F.col("digest") == F.col("_digest")) & (F.col("size") >= least), "left")
    revisit = F.coalesce(F.col("to") != F.col("page_id"), F.col("to").isNotNull())
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(GAP), F.when(revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(folder)
    return folder


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between occurrences of the magic, in bytes: ``file, split, id`` (ascending within the split, in this read alone), ``value``."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))


def _field(name: str, pattern: str):
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *{pattern}(?=\r\n|$)", 1)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of the magic: ``file, off, size`` (of its piece), ``succ`` (null without a right header), the
    record's fields, and ``piece``, the digest of the whole piece."""
    head = F.when(F.instr(F.col("value").cast("string"), GAP) > 0, F.substring_index(F.col("value").cast("string"), GAP, 1))
    parsed = _pieces(spark, folder).select("file", "split", "id", F.octet_length("value").cast("bigint").alias("size"), "value", head.alias("head"))
    parsed = parsed.withColumns({"hl": F.octet_length("head").cast("bigint"), "length": F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\r\n)Content-Length: *(\\d{1,18})(?=\r\n|$)', 1), '') as bigint)")})
    payload = F.expr("substring(value, cast(hl + 5 as int), cast(length as int))")
    whole = F.col("hl") + 4 + F.col("length") <= F.col("size")
    parsed = parsed.select(
        "file",
        "split",
        "id",
        "size",
        "hl",
        "length",
        F.sha1("value").alias("piece"),
        F.when(whole, F.sha1(payload)).alias("digest"),
        _field("WARC-Type", "(\\w+)").alias("record_type"),
        _field("WARC-Record-ID", "<urn:page:(-?\\d+)>").alias("page_id"),
        _field("WARC-Refers-To", "<urn:page:(-?\\d+)>").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("said_digest"),
        _field("X-Payload-Bytes", "(\\d{1,18})").alias("said_bytes"),
    )
    narrow = saved(parsed, "pieces")
    # a file's bytes before a split are summed over its splits; those within, over the split's pieces in order
    sums = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = sums.selectExpr("file as _f", "split as _s", "coalesce(sum(bytes) over (partition by file order by split rows between unbounded preceding and 1 preceding), 0) as base")
    ordered = narrow.selectExpr("*", "coalesce(sum(size + 10) over (partition by file, split order by id rows between unbounded preceding and 1 preceding), 0) as inner_off")
    joined = ordered.join(before, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    # a piece follows its magic, so the magic begins one magic before the piece; the first piece of a file has none
    off = F.col("base") + F.col("inner_off") - len(MAGIC)
    return joined.select("file", off.alias("off"), "piece", "size", "hl", "length", "digest", "record_type", "page_id", "refers_to", "said_digest", "said_bytes").where("off >= 0").withColumn("succ", F.col("off") + len(MAGIC) + F.col("hl") + 4 + F.col("length") + 4)


def _local(offs: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """For sorted candidates of a block: the place of each one's successor in it, or its own place if there is none."""
    at = np.minimum(np.searchsorted(offs, succ), len(offs) - 1)
    return np.where(offs[at] == succ, at, np.arange(len(offs)))


def _exits(table: pa.Table) -> pa.Table:
    """For each candidate of a block, where the chain from it leaves the block."""
    table = table.sort_by("off")
    offs, succ = table["off"].to_numpy(), table["succ"].to_numpy()
    to = _local(offs, succ)
    while True:  # pointer jumping
        further = to[to]
        if (further == to).all():
            break
        to = further
    return pa.table([table["file"], table["off"], pa.array(succ[to])], ["file", "off", "exit"])


def _walk(table: pa.Table) -> pa.Table:
    """The candidates of a block reached from its entry."""
    table = table.sort_by("off")
    offs, to = table["off"].to_numpy(), _local(table["off"].to_numpy(), table["succ"].to_numpy())
    reached = table["entry"].to_numpy(zero_copy_only=False).copy()
    while True:  # pointer jumping: who is reached reaches whoever 2^k steps on
        more = reached.copy()
        more[to[reached]] = True
        further = to[to]
        if (more == reached).all() and (further == to).all():
            break
        reached, to = more, further
    return pa.table([table["file"], table["off"], pa.array(reached)], ["file", "off", "reached"]).filter(pa.array(reached)).select(["file", "off"])


def reached(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file, off`` of the candidates on the chain from their file's start."""
    links = found.where("succ is not null").select("file", "off", "succ", F.floor(F.col("off") / block).alias("block"))
    links = saved(links, "links")
    exits = saved(links.groupBy("file", "block").applyInArrow(_exits, "file string, off long, exit long"), "exits")
    entries = exits.where("off = 0").select("file", "off")
    # between blocks only the places where a chain enters a block matter
    doors = exits.select("file", F.col("exit").alias("off")).union(entries).distinct()
    jump, now = saved(exits.join(doors, ["file", "off"], "left_semi"), "jumps"), saved(entries, "entries")
    size = now.count()
    while size:
        more = now.join(jump, ["file", "off"]).select("file", F.col("exit").alias("off"))
        now = saved(now.union(more).distinct(), "entries")
        if (bigger := now.count()) == size:
            break
        size = bigger
        far = jump.select("file", F.col("off").alias("exit"), F.col("exit").alias("far"))
        jump = saved(jump.join(far, ["file", "exit"]).select("file", "off", F.col("far").alias("exit")), "jumps")
    marked = links.join(now.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInArrow(_walk, "file string, off long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and whether what the header says
    of the payload holds (``verified``; a revisit has no payload of its own to hold it against)."""
    found = saved(candidates(spark, folder), "candidates")
    records = found.join(reached(found), ["file", "off"], "left_semi")
    records = saved(records, "records")
    split_up = records.where("digest is null").select("file", F.col("off").alias("rec"), "succ", "hl", "length")
    if split_up.isEmpty():
        digests = None
    else:
        digests = _joined(spark, folder, found, saved(split_up, "split"))
        records = records.join(digests, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")
    response = F.col("record_type") == "response"
    return records.select(
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        F.when(response, F.col("length")).otherwise(F.expr("try_cast(said_bytes as bigint)")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("said_digest")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(nullif(refers_to, '') as bigint)").alias("refers_to"),
        (~response | (F.col("digest") == F.col("said_digest"))).alias("verified"),
    )


def _inside(found: DataFrame, records: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file, rec, hl, length, off, piece`` of the candidates within each of these records, which lie apart.

    Records and candidates are sorted together in blocks of the file, and each candidate takes the last record that began
    before it: a row in gives at most a row out, however many of both a block has.
    """
    parts = records.withColumn("block", F.explode(F.sequence(F.floor(F.col("rec") / block), F.floor((F.col("succ") - 1) / block))))
    begun = parts.select("file", "block", F.greatest("rec", F.col("block") * block).alias("off"), F.lit(0).alias("kind"), F.struct("rec", "succ", "hl", "length").alias("r"), F.lit(None).cast("string").alias("piece"))
    seen = found.select("file", F.floor(F.col("off") / block).alias("block"), "off", F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["r"].dataType).alias("r"), "piece")
    last = F.last("r", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("off", "kind"))
    both = begun.unionByName(seen).withColumn("r", last).where("kind = 1 and off < r.succ")
    return both.select("file", "r.rec", "r.hl", "r.length", "off", "piece")


def _whole(table: pa.Table) -> pa.Table:
    """The digest of the payload of one record, from its pieces."""
    table = table.sort_by("off")
    text = b"".join(MAGIC.encode() + x for x in table["value"].to_pylist())
    begin = len(MAGIC) + table["hl"][0].as_py() + len(GAP)
    digest = hashlib.sha1(text[begin : begin + table["length"][0].as_py()]).hexdigest()
    return pa.table([table["file"].slice(0, 1), table["rec"].slice(0, 1), pa.array([digest])], ["file", "off", "joined"])


def _joined(spark: SparkSession, folder: str, found: DataFrame, records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Digests of the payloads that hold the magic: ``file, off, joined``. Their pieces are found by their digests."""
    inside = saved(_inside(found, records, block), "inside")
    needed = _pieces(spark, folder).select(F.sha1("value").alias("piece"), "value").join(inside.select("piece").distinct(), "piece", "left_semi")
    pieces = inside.join(needed.dropDuplicates(["piece"]), "piece")
    return pieces.groupBy("file", "rec").applyInArrow(_whole, "file string, off long, joined string")
