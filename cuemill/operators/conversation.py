"""Chats as tables of ``conv_id, turn, role, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def truncate(df: DataFrame, tokens: Column, context: int, threshold: float = 0.9) -> DataFrame:
    """The messages that stay when the oldest whole turns after the first are dropped until the rest fits.

    A turn begins at a user's message. The first turn (and what comes before
    it) and the last stay. Turns are dropped from the second on while the rest
    is over budget, so a turn goes if all before it are gone and what then is
    left is still too much: running sums tell, no loop.
    """
    budget = max(1, int(max(1, context) * min(1.0, max(0.1, threshold))))
    by = Window.partitionBy("conv_id")
    order = by.orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    m = df.withColumn("_n", tokens).withColumn("_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto))
    m = m.withColumn("_turns", F.max("_turn").over(by)).withColumn("_all", F.sum("_n").over(by))
    droppable = (F.col("_turn") >= 2) & (F.col("_turn") < F.col("_turns"))
    m = m.withColumn("_gone", F.coalesce(F.sum(F.when(droppable, F.col("_n")).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return m.filter(~(droppable & (F.col("_all") - F.col("_gone") > budget))).drop("_n", "_turn", "_turns", "_all", "_gone")


def previous_text(df: DataFrame, words: int = 60) -> DataFrame:
    """Adds ``context``: the last words of the message before; empty for the first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return df.withColumn("context", F.coalesce(X.last_words(F.lag("text").over(w), words), F.lit("")))


def with_context(prompt: Column, context: Column, lead: str = "Context from the previous segment:") -> Column:
    """A prompt with the context under it; the prompt alone without one."""
    return F.when(context == "", prompt).otherwise(F.concat(prompt, F.lit(f"\n\n{lead}\n"), context))


def newest_within(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Of each key's lines the newest that fit ``budget`` characters, line ends counted; the last one always."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    m = df.withColumn("_used", F.sum(F.length(text) + 1).over(w)).withColumn("_place", F.count("*").over(w))
    return m.filter((F.col("_used") - 1 <= budget) | (F.col("_place") == 1)).drop("_used", "_place")


def markdown(df: DataFrame) -> DataFrame:
    """``conv_id, markdown``: a section for each message but the system's, in order."""
    named = df.filter("role <> 'system'").withColumn("_part", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), X.strip("text")))
    parts = F.array_sort(F.collect_list(F.struct("turn", "_part")))
    return named.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["_part"]), "\n\n").alias("markdown"))


def as_json(df: DataFrame) -> DataFrame:
    """``conv_id, json``: the messages as an array of role and content."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return df.groupBy("conv_id").agg(F.to_json(F.transform(parts, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("content")))).alias("json"))


def normalized(df: DataFrame, media: str | None = None) -> DataFrame:
    """Messages with ``role`` folded and trimmed, ``text`` never null, and ``error``: what is wrong with a message, null if nothing is.

    Roles are system, user and assistant; with ``media`` (an array column), only a user's message may carry any.
    """
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string")
    at = lambda said: F.concat(F.lit("Chat message "), number, F.lit(said))
    error = F.when(~role.isin("system", "user", "assistant"), F.concat(at(" has an unsupported role: "), F.when(role == "", "<empty>").otherwise(role)))
    if media is not None:
        carried = F.size(F.filter(F.coalesce(F.col(media), F.array()), lambda m: X.strip(m) != "")) > 0
        error = error.when(carried & (role != "user"), at(": only user messages can carry media"))
    return df.withColumns({"error": error, "role": role, "text": F.coalesce("text", F.lit(""))})
