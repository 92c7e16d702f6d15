"""Chat formatting: conversations as training text with a loss mask, and the way back.

Native. A conversation's turns are collected as structs and sorted, neighbours of one role become one
block, and the blocks are joined. Control strings inside texts are escaped, so text never ends a turn, and
formatted text is read back exactly.

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

``<|im_next|>`` stands between merged turns of one role, so merging loses no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.normalize import let

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"

#: Control strings of common chat templates, as first character and rest. None ends as another begins.
CONTROL = r"(?:<(?=\\*(?:/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>))|\[(?=\\*/?INST\]))"


def escape(text: Column) -> Column:
    r"""A control string gets a backslash after its first character, as does one that has backslashes there already."""
    return F.regexp_replace(text, rf"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, rf"({CONTROL})\\", "$1")


def _runs(turns: Column) -> Column:
    """array<struct<role, texts>>: neighbouring turns of one role together."""
    role = lambda i: F.get(turns, i)["role"]
    places = F.transform(turns, lambda _, i: i)
    starts = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))
    texts = lambda i, upto: F.transform(F.slice(turns, i + 1, upto - i), lambda x: x["text"])
    return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(role(i).alias("role"), texts(i, F.coalesce(F.get(s, k + 1), F.size(turns))).alias("texts"))))


def _block(run: Column) -> Column:
    return F.concat(F.lit(START), run["role"], F.lit(SEP), F.array_join(run["texts"], NEXT), F.lit(END))


def _lengths(run: Column) -> Column:
    """Characters of a block as (before, text) pairs: what stands before each text, and the text; the end counts to the next block."""
    first = F.lit(len(START) + len(SEP)) + F.length(run["role"])
    return F.transform(run["texts"], lambda t, i: F.struct(F.when(i == 0, first).otherwise(F.lit(len(NEXT))).alias("gap"), F.length(t).alias("n"), (F.when(i == F.size(run["texts"]) - 1, len(END)).otherwise(0)).alias("after"), run["role"].alias("role")))


def format_chats(turns: DataFrame, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    ``loss_spans`` are the places, array<struct<start, end>> in code points, of the texts of ``loss_role``:
    the loss mask. Turns go by ``turn``, null first, equal ones by role and text; repeated rows are
    repeated turns. A null role or text is empty. Turns without a conversation id stand alone, each in a
    row with a null id, so that they do not pile up in one group. A conversation, of any length, must fit
    into one row. An empty table gives no rows. Other columns are unread.
    """
    clean = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = sorted_turns.select("conv_id", _runs(F.col("turns")).alias("runs"))
    laid = blocks.select("conv_id", F.array_join(F.transform("runs", _block), "").alias("formatted"), F.flatten(F.transform("runs", _lengths)).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        span = F.array(F.struct(start.alias("start"), (start + p["n"]).alias("end")))
        return F.struct((start + p["n"] + p["after"]).alias("at"), F.when(p["role"] == escape(F.lit(loss_role)), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return laid.select("conv_id", "formatted", F.aggregate("pieces", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: the turns as they were, unescaped."""
    cut = lambda text, mark: F.split(text, rf"\Q{mark}\E", -1)

    def block(text: Column) -> Column:
        parts = cut(F.substring(text, len(START) + 1, F.length(text)), SEP)
        return let(parts, lambda p: F.transform(cut(F.get(p, 1), NEXT), lambda t: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(t).alias("text"))))

    whole = let(cut(formatted, END), lambda b: F.slice(b, F.lit(1), F.size(b) - 1))
    return F.flatten(F.transform(whole, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """array<string>: the unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def digests(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` made, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
