"""Conversation history over ``conversations(conv_id, turn, role, text)``.

One conversation may hold a large share of all rows, so nothing here gathers a
conversation in one task: first turns come from partial aggregates, positions
from two-level counts, and exports are one row per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellex import fixed_values as fv

BUCKET = 4096


def running_index(df: DataFrame, keys: list[str], order: str, name: str, group: Column | None = None) -> DataFrame:
    """0-based position of every row in its key, ordered by ``(group, order)``.

    Rows are numbered inside buckets of ``order``; bucket sizes are counted with
    partial aggregation and summed up over the buckets of a key. The largest
    window holds one bucket, not one key.
    """
    tagged = df.withColumn("_g", F.lit(0) if group is None else group).withColumn(
        "_b", F.floor(F.col(order) / BUCKET)
    )
    bucket = [*keys, "_g", "_b"]
    sizes = tagged.groupBy(*bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_g", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*bucket).orderBy(order)
    numbered = tagged.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts.hint("merge"), bucket)
        .withColumn(name, F.col("_start") + F.col("_i"))
        .drop("_g", "_b", "_i", "_start")
    )


def history_frame(conversations: DataFrame) -> DataFrame:
    """Number of earlier messages of every turn and whether there is a history."""
    indexed = running_index(conversations, ["conv_id"], "turn", "n_prior")
    return indexed.withColumn("has_history", F.col("n_prior") > 0)


def history_messages(conversations: DataFrame, asks: DataFrame) -> DataFrame:
    """Messages before each asked turn: ``asks(conv_id, ask_turn)``, one row per message."""
    return (
        conversations.join(asks.hint("merge"), "conv_id")
        .where(F.col("turn") < F.col("ask_turn"))
        .select("conv_id", "ask_turn", "turn", "role", "text")
    )


def full_history(numbered: DataFrame) -> DataFrame:
    """All earlier messages of every message of ``numbered(conv_id, turn, role, text, position)``, one row each."""
    asks = numbered.select("conv_id", F.col("turn").alias("ask_turn"), F.col("position").alias("n_prior"))
    return (
        numbered.join(asks.hint("merge"), "conv_id")
        .where(F.col("position") < F.col("n_prior"))
        .select("conv_id", "ask_turn", "n_prior", "position", "turn", "role", "text")
    )


def all_questions(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ask_turn)`` of every user turn of every conversation."""
    return conversations.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("ask_turn")).distinct()


def latest_questions(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ask_turn)`` of the last user turn of every conversation."""
    return (
        conversations.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("ask_turn"))
    )


def append_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Add messages after the last turn of their conversation, in their ``turn`` order."""
    last = conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("_next"))
    placed = (
        running_index(messages, ["conv_id"], "turn", "_at")
        .join(last.hint("merge"), "conv_id", "left")
        .withColumn("turn", (F.coalesce("_next", F.lit(0)) + F.col("_at")).cast("bigint"))
    )
    return conversations.unionByName(placed.select(*conversations.columns))


def clear_sessions(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drop all messages of the named conversations."""
    return conversations.join(sessions.select("conv_id").distinct(), "conv_id", "left_anti")


def conversation_list(conversations: DataFrame) -> DataFrame:
    """``(conv_id, title, n_messages)``: the title is the start of the first user message."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return conversations.groupBy("conv_id").agg(
        F.left(F.min_by("text", user), F.lit(fv.CONVERSATION_TITLE_CHARS)).alias("title"),
        F.count("*").alias("n_messages"),
    )


def recent_conversations(conversations: DataFrame, n: int = 12) -> DataFrame:
    """Newest conversations first, cut to ``n``; ids grow with time."""
    return conversation_list(conversations).orderBy(F.col("conv_id").desc()).limit(n)


def export_chat(conversations: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """JSON export, one line per message; the lines of a conversation form one JSON array.

    ``responses(conv_id, turn, confidence_score, has_penalty, citations)`` adds
    answer fields. Write with ``sinks.write_lines``: lines stay in order.
    """
    bounds = conversations.groupBy("conv_id").agg(
        F.min("turn").alias("_first"), F.max("turn").alias("_last")
    )
    fields = ["role", F.col("text").alias("content")]
    joined = conversations
    if responses is not None:
        joined = joined.join(responses.hint("merge"), ["conv_id", "turn"], "left")
        fields += ["confidence_score", "has_penalty", "citations"]
    return joined.join(bounds.hint("merge"), "conv_id").select(
        "conv_id",
        "turn",
        F.concat(
            F.when(F.col("turn") == F.col("_first"), F.lit("[")).otherwise(F.lit("")),
            F.to_json(F.struct(*fields)),
            F.when(F.col("turn") == F.col("_last"), F.lit("]")).otherwise(F.lit(",")),
        ).alias("line"),
    )
