"""Message lists for models: folds over conversations(conv_id, turn, role, text), and over streamed replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _turns(conversations: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return conversations.groupBy("conv_id").agg(turns.alias("turns"))


def prompt_fold(conversations: DataFrame) -> DataFrame:
    """(conv_id, system, prompt): system texts joined, other turns as ROLE:, line end, text."""
    system = F.transform(F.filter("turns", lambda t: t.role == "system"), lambda t: t.text)
    rest = F.transform(F.filter("turns", lambda t: t.role != "system"), lambda t: F.concat(F.upper(t.role), F.lit(":\n"), t.text))
    return _turns(conversations).select("conv_id", F.array_join(system, "\n\n").alias("system"), F.array_join(rest, "\n\n").alias("prompt"))


def responses_input(conversations: DataFrame) -> DataFrame:
    """(conv_id, instructions, input): system texts apart, the other turns in order."""
    system = F.transform(F.filter("turns", lambda t: t.role == "system"), lambda t: t.text)
    items = F.transform(F.filter("turns", lambda t: t.role != "system"), lambda t: F.struct(t.role.alias("role"), t.text.alias("content")))
    return _turns(conversations).select("conv_id", F.array_join(system, "\n\n").alias("instructions"), items.alias("input"))


def request_metrics(conversations: DataFrame) -> DataFrame:
    """(conv_id, message_count, message_chars, system_chars, approx_input_units), a partial sum before the shuffle."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    sums = conversations.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(chars).alias("message_chars"), F.sum(F.when(F.col("role") == "system", chars).otherwise(0)).alias("system_chars"))
    return sums.withColumn("approx_input_units", F.expr("message_chars div 4"))


def joined_deltas(events: DataFrame) -> DataFrame:
    """events(reply_id, ord, type, delta, error) -> (reply_id, content, completed, error): text deltas in order."""
    deltas = F.array_sort(F.collect_list(F.when(F.col("type") == "response.output_text.delta", F.struct("ord", "delta"))))
    return events.groupBy("reply_id").agg(
        F.array_join(F.transform(deltas, lambda d: d.delta), "").alias("content"), F.max(F.col("type") == "response.completed").alias("completed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error"),
    )


def tool_calls(deltas: DataFrame) -> DataFrame:
    """deltas(reply_id, ord, idx, id, name, arguments) -> one call per idx: its last id, names and arguments joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"))))
    made = deltas.groupBy("reply_id", "idx").agg(F.max_by("id", F.when(F.col("id") != "", F.col("ord"))).alias("id"), parts.alias("parts"))
    return made.select("reply_id", "idx", "id", F.array_join(F.transform("parts", lambda p: p["name"]), "").alias("name"), F.array_join(F.transform("parts", lambda p: p.arguments), "").alias("arguments"))
