"""Chat formatting by event-sourced reconstruction (operator 7), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

START, END = "<|im_start|>", "<|im_end|>"
# Strings that chat templates give a meaning to; escaped inside texts.
CONTROL = (START, END, "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    r"""Backslashes become ``\b``; ``\i`` after the first character breaks every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for word in CONTROL:
        text = F.replace(text, F.lit(word), F.lit(word[0] + "\\i" + word[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\i"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    r"""A role also has its line ends escaped, as ``\n`` ends the head of a turn."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, number, turn, role, text): the final messages of an event log.

    ``log`` has conv_id, turn, seq, kind, role and text. Events of a conversation are ordered by turn,
    seq, role, text. ``message`` opens a message, ``delta`` adds to it, ``edit`` and ``regenerate``
    replace what it holds so far; other kinds count as ``delta``. The last role given stands. Null
    texts and roles are empty; a null conv_id is a conversation of its own; events before the first
    ``message`` form message 0. Repeated ``message`` rows are messages of their own. All steps keep
    the partitioning by conv_id, so the log is shuffled once; a conversation's text must fit a row.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "seq", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    kind = F.coalesce("kind", F.lit("delta"))
    marked = log.select(
        "conv_id", "turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("n"),
        F.sum(F.when(kind == "message", 1).otherwise(0)).over(order).alias("number"),
        F.sum(F.when(kind.isin("message", "edit", "regenerate"), 1).otherwise(0)).over(order).alias("fresh"))
    last = W.partitionBy("conv_id", "number")
    role = F.coalesce(F.max(F.when(F.col("role").isNotNull(), F.struct("n", "role"))).over(last)["role"], F.lit(""))
    kept = marked.withColumns({"latest": F.max("fresh").over(last), "role": role}).where("fresh = latest")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda e: e["text"]))
    return kept.groupBy("conv_id", "number").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), joined.alias("text"))


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask, loss_spans) from ``messages``.

    A turn is START, role, line end, escaped text, END, line end. loss_mask has one flag a turn;
    loss_spans are the masked texts as [start, end) in code points of ``formatted``.
    """
    order = W.partitionBy("conv_id").orderBy("number")
    part = turns.select("conv_id", "number", (F.col("role") == learn).alias("loss"), _head(F.col("role")).alias("head"),
                        escape(F.col("text")).alias("body"))
    part = part.withColumn("end", F.sum(F.length("head") + F.length("body") + len(START) + len(END) + 2).over(order)
                           - len(END) - 1).withColumn("start", F.col("end") - F.length("body"))
    text = F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END + "\n"))
    rows = part.select("conv_id", F.struct("number", text.alias("text"), "loss", "start", "end").alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.concat_ws("", F.col("t.text")).alias("formatted"), F.col("t.loss").alias("loss_mask"),
                       F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text, loss) taken from the formatted text and the mask alone."""
    split = formatted.withColumn("__pieces", F.split("formatted", r"<\|im_start\|>", -1))
    cut = split.withColumn("__pieces", F.slice("__pieces", F.lit(2), F.size("__pieces") - 1))
    turn = lambda p, i: F.struct(
        unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("\\l"), F.lit("\n"))).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2,
                             F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text"),
        F.get("loss_mask", i).alias("loss"))
    return cut.withColumn("turns", F.transform("__pieces", turn)).drop("__pieces")
