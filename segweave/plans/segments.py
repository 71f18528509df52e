"""From blocks of text to segments, the fact rows that passes work on.

segments(session_id, seg_id, position, turn, role, kind, tool_class, path, text, token_count, mutation_class,
stability_rank): one session is one context, its rows ordered by position from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TokenCounter, mutation_class, stability_rank, token_count
from ..shared import unbounded

ROLES = ["system", "user", "assistant", "tool"]
KINDS = [
    "system_prompt", "tool_schema", "compact_summary", "file_read", "dir_listing", "tool_output", "diff", "stack_trace",
    "test_output", "reasoning_trace", "conversation_turn",
]
KEY = ["session_id", "seg_id"]


def checked(value: Column, allowed: list[str], what: str) -> Column:
    """value, or an error that names it if it isn't allowed."""
    return F.when(value.isin(allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def tool_class_of(kind: Column, given: Column) -> Column:
    """A tool output's class, unknown if none is given; null for other kinds."""
    return F.when(kind == "tool_output", F.coalesce(given, F.lit("unknown")))


def segment(blocks: DataFrame, counter: TokenCounter = token_count) -> DataFrame:
    """blocks(session_id, position, role, kind, text[, tool_class, path, turn]) -> segments; position is from 0 and gapless."""
    has = lambda name, other: F.col(name) if name in blocks.columns else other
    none = F.lit(None).cast("string")
    return blocks.select(
        "session_id", F.col("position").cast("long").alias("seg_id"), F.col("position").cast("int").alias("position"),
        has("turn", F.col("position")).cast("int").alias("turn"), "role", "kind",
        tool_class_of(F.col("kind"), has("tool_class", none)).alias("tool_class"), has("path", none).alias("path"), "text",
        counter(F.col("text")).alias("token_count"), mutation_class(F.col("kind")).alias("mutation_class"), stability_rank(F.col("kind")).alias("stability_rank"),
    )


def ranked(keys: DataFrame, *order: str, spans: int = 1) -> DataFrame:
    """keys with position: their place from 0 in the session by order.

    spans: into how many stretches of the first column of order, a number or a time, a session is cut. Each is ranked by
    itself, and counts of those before it are added, so that no task holds a hot session whole.
    """
    if spans < 2:
        return keys.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)
    lead = F.col(order[0]).cast("double")
    cuts = keys.groupBy("session_id").agg(F.array_distinct(F.percentile_approx(lead, [k / spans for k in range(1, spans)])).alias("cuts"))
    cut = keys.join(cuts, "session_id").withColumn("span", F.size(F.filter("cuts", lambda c: c < lead))).drop("cuts")
    counts = cut.groupBy("session_id", "span").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("session_id", "span", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("session_id", "span").orderBy(*order))
    return cut.withColumn("position", inside).join(starts, ["session_id", "span"]).withColumn("position", (F.col("before") + F.col("position") - 1).cast("int")).drop("span", "before")


def positioned(rows: DataFrame, *order: str, spans: int = 1) -> DataFrame:
    """rows with position: their place in the session from 0 by order, columns that tell the rows of a session apart.

    Only keys are ranked; what else a row holds, its text above all, meets its position by key.
    """
    keys = ["session_id", *order]
    return rows.join(unbounded(ranked(rows.select(*keys), *order, spans=spans)), keys)
