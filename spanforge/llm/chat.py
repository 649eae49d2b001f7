"""Chat formatting with prefix-target expansion, by built-in functions alone.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled, ``<|`` becomes ``<\\|``, and in roles a line end becomes ``\\-``, so
no text can forge a mark and every text can be had back exactly.

``format_chats`` makes one row a conversation: its turns in order as one string, and for
each assistant turn the places of its reply. ``examples`` explodes every assistant turn into
an example of its own, with all preceding turns as context and only that reply under the
loss mask. What is stored is linear in the conversation: an example is a prefix of the
stored string, cut when it is read, so a conversation of many turns is not written once a
turn.

Turns are numbered and placed by one window and gathered by the same key, the conversation,
which is the unit of the output; nothing is gathered across conversations. Turns of the same number keep a fixed order (by role, then text).

Cases: a null or empty text or role is empty; a null ``turn`` comes first; a null
``conv_id`` is a conversation like others; repeated rows are repeated turns; a
conversation without assistant turns has no examples; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """The text with backslashes doubled and mark openings broken."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``, and of a role's line ends."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1))
    whole = F.array_join(F.transform(tokens, lambda t: F.when(t == "\\-", F.lit("\n")).when(t.startswith("\\"), F.substring(t, 2, 1)).otherwise(t)), "")
    return F.when(F.instr(text, "\\") == 0, text).otherwise(whole)


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = ASSISTANT) -> DataFrame:
    """``conv_id, formatted, replies``: replies has for each target turn its number among the turns (from 0), the code
    points before its reply in ``formatted``, and the reply's length there."""
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\-")), F.lit("\n"))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), head.alias("head"), escape(text).alias("text"))
    rows = rows.withColumn("size", F.char_length("head") + F.char_length("text") + len(END))
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    before = F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("conv_id", (F.row_number().over(turn) - 1).alias("k"), F.coalesce(before, F.lit(0)).cast("int").alias("at"), (F.col("role") == target_role).alias("target"), "head", "text")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "at", "target", "head", "text"))).alias("turns"))

    def reply(t: Column) -> Column:
        return F.struct(t["k"].alias("turn"), (t["at"] + F.char_length(t["head"])).alias("begin"), F.char_length(t["text"]).alias("length"))

    return held.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["target"]), reply).alias("replies"),
    )


def examples(formatted: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each target turn: ``conv_id, turn, context`` (all preceding turns and the reply's head, no loss) and
    ``target`` (the reply alone, under the loss mask; the closing mark follows it without loss), and the columns to keep."""
    one = formatted.select("conv_id", "formatted", *(c for c in keep if c != "formatted"), F.explode("replies").alias("r"))
    return one.select("conv_id", F.col("r.turn").alias("turn"), F.substring("formatted", F.lit(1), F.col("r.begin")).alias("context"), F.substring("formatted", F.col("r.begin") + 1, F.col("r.length")).alias("target"), *keep)


def per_conversation(found: DataFrame, *, target_role: str = ASSISTANT) -> DataFrame:
    """``conv_id, loss, n_examples`` of examples that keep ``formatted``: all text under the loss mask, unescaped, in order,
    and the number of examples. Fails on an example whose context is not all turns before its target and the reply's head."""
    context = F.col("context")
    heads = (F.char_length(context) - F.char_length(F.replace(context, F.lit(START), F.lit("")))) / len(START)
    head = F.lit(f"{START}{target_role}\n")
    right = F.startswith("formatted", F.concat(context, "target", F.lit(END))) & F.endswith(context, head) & (heads == F.col("turn") + 1)
    text = F.when(right, unescape(F.col("target"))).otherwise(F.raise_error(F.lit("an example's context is not the turns before its target")).cast("string"))
    held = found.select("conv_id", F.struct("turn", text.alias("text")).alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return held.select("conv_id", F.array_join(F.transform("e", lambda e: e["text"]), "").alias("loss"), F.size("e").cast("long").alias("n_examples"))


def turns_of(formatted: str | Column) -> Column:
    """The turns read back from a formatted conversation: an array of (role, text)."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.filter(F.split(column, r"<\|im_end\|>\n"), lambda s: s.startswith(START))

    def one(s: Column) -> Column:
        body = F.substring(s, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.lit(2**31 - 1))).alias("text"))

    return F.transform(parts, one)


def loss_text(formatted: str = "formatted", replies: str = "replies") -> Column:
    """All text under the loss mask of a conversation's examples, unescaped, in order."""
    return F.array_join(F.transform(F.col(replies), lambda r: unescape(F.substring(F.col(formatted), r["begin"] + 1, r["length"]))), "")
