"""Passes: each proposes an action for some segments.

A pass is a function of segments and a context that gives proposals(session_id, seg_id, action, reason, rendered,
new_tokens, reconstruct, base_id). What a pass needs of other rows it takes from one aggregated row for each group, joined
back by key, so that texts aren't shuffled into windows and a large group costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DEDUP_KINDS, DROPPABLE_KINDS, has_conclusion, symbols, token_count
from ..operators import codecs
from ..operators.transforms import symbols_of
from ..operators.vectors import hash_embedding
from ..shared import discard, unbounded, written
from .segments import KEY

PROPOSAL = "session_id string, seg_id long, action string, reason string, rendered string, new_tokens int, reconstruct string, base_id long"


@dataclass
class Context:
    """task: what the session is about; registry(session_id, tool_class, latest_turn): runs known from earlier turns."""

    task: str = ""
    registry: DataFrame | None = None
    options: dict = field(default_factory=dict)


Pass = Callable[[DataFrame, Context], DataFrame]


def _proposal(rows: DataFrame, action: str, reason: str, rendered: Column | None = None, reconstruct: str | None = None, base: Column | None = None) -> DataFrame:
    rendered = F.lit(None).cast("string") if rendered is None else rendered
    return rows.select(
        *KEY, F.lit(action).alias("action"), F.lit(reason).alias("reason"), rendered.alias("rendered"),
        F.when(rendered.isNotNull(), token_count(rendered)).alias("new_tokens"), F.lit(reconstruct).cast("string").alias("reconstruct"),
        (F.lit(None) if base is None else base).cast("long").alias("base_id"),
    )


def last_positions(segments: DataFrame) -> DataFrame:
    return segments.groupBy("session_id").agg(F.max("position").alias("last_position"))


def older(segments: DataFrame, rows: DataFrame, keep: int) -> DataFrame:
    """Of rows those that aren't among the session's last keep positions."""
    return rows.join(unbounded(last_positions(segments)), "session_id").where(F.col("last_position") - F.col("position") >= keep).drop("last_position")


def supersession(segments: DataFrame, ctx: Context) -> DataFrame:
    """Tool outputs of which the session, or its registry, has a later run of the same class."""
    outputs = segments.where("kind = 'tool_output'").select(*KEY, "position", "turn", "tool_class")
    latest = outputs.groupBy("session_id", "tool_class").agg(F.max("position").alias("latest"))
    rows = outputs.join(unbounded(latest), ["session_id", "tool_class"])
    stale = F.col("position") < F.col("latest")
    if ctx.registry is not None:
        rows = rows.join(unbounded(ctx.registry.select("session_id", "tool_class", "latest_turn")), ["session_id", "tool_class"], "left")
        stale = stale | F.coalesce(F.col("latest_turn") > F.col("turn"), F.lit(False))
    return _proposal(rows.where(stale), "drop", "superseded")


def file_bases(segments: DataFrame) -> DataFrame:
    """session_id, path, base_id, base_position: the first read of each file."""
    reads = segments.where("kind = 'file_read' and path is not null")
    first = reads.groupBy("session_id", "path").agg(F.min(F.struct("position", "seg_id")).alias("b"))
    return first.select("session_id", "path", F.col("b.seg_id").alias("base_id"), F.col("b.position").alias("base_position"))


def file_delta(segments: DataFrame, ctx: Context) -> DataFrame:
    """Later reads of a file with other content: a delta against the first read."""
    reads = segments.where("kind = 'file_read' and path is not null").select(*KEY, "path", "text")
    bases = file_bases(segments).join(unbounded(reads.select("session_id", F.col("seg_id").alias("base_id"), F.col("text").alias("base_text"))), ["session_id", "base_id"])
    rows = reads.join(unbounded(bases), ["session_id", "path"]).where((F.col("seg_id") != F.col("base_id")) & (F.col("text") != F.col("base_text")))
    return _proposal(rows, "replace", "duplicate", codecs.delta("base_text", "text"), "delta", F.col("base_id"))


def envelope_dedup(segments: DataFrame, ctx: Context) -> DataFrame:
    """Tool outputs that are small deltas of an earlier one; the smallest delta, of several the earliest base.

    Accepted if the delta has less than share of the output's tokens. A delta holds every line that the base lacks, so a
    base whose lines leave more than that can't be accepted and isn't compared. Such a base holds at least one of the
    output's rarest lines that together have that many tokens; only bases that share one of these are met, so that lines
    which every output has bring none together.
    """
    share = ctx.options.get("envelope_share", 0.6)
    outputs = segments.where("kind = 'tool_output'").select(*KEY, "position", "text", "token_count")
    lines = outputs.select(*KEY, "position", "token_count", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    lines = written(lines.select(*KEY, "position", "token_count", F.xxhash64("line").alias("line_hash"), F.char_length("line").alias("size")))
    frequency = lines.groupBy("session_id", "line_hash").agg(F.count("*").alias("holders")).where("holders > 1")
    rarest = Window.partitionBy(*KEY).orderBy("holders", "line_hash").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.join(unbounded(frequency), ["session_id", "line_hash"], "left").withColumn("holders", F.coalesce("holders", F.lit(1).cast("long")))
    counted = counted.withColumn("rarer", F.coalesce(F.sum("size").over(rarest), F.lit(0)))
    prefix = counted.where((F.col("holders") > 1) & (F.col("rarer") / 4 < share * F.col("token_count"))).select(*KEY, "position", "line_hash")
    earlier = lines.select("session_id", F.col("seg_id").alias("base_id"), F.col("position").alias("base_position"), "line_hash")
    met = prefix.join(unbounded(earlier), ["session_id", "line_hash"]).where("base_position < position").select(*KEY, "base_id", "base_position").distinct()
    shared = met.join(unbounded(lines), KEY).join(unbounded(earlier.drop("base_position")), ["session_id", "base_id", "line_hash"])
    shared = shared.groupBy(*KEY, "base_id", "base_position").agg(F.sum("size").alias("kept"))
    distinct = lines.groupBy(*KEY, "token_count").agg(F.sum("size").alias("all_size"))
    near = shared.join(unbounded(distinct), KEY).where((F.col("all_size") - F.col("kept")) / 4 < share * F.col("token_count"))
    pairs = near.select(*KEY, "base_id", "base_position", "token_count").join(unbounded(outputs.select(*KEY, "text")), KEY)
    pairs = pairs.join(unbounded(outputs.select("session_id", F.col("seg_id").alias("base_id"), F.col("text").alias("base_text"))), ["session_id", "base_id"])
    patched = pairs.withColumn("rendered", codecs.delta("base_text", "text")).withColumn("patch_tokens", token_count(F.col("rendered")))
    best = patched.where(F.col("patch_tokens") < share * F.col("token_count")).groupBy(*KEY).agg(F.min(F.struct("patch_tokens", "base_position", "base_id", "rendered")).alias("b"))
    return _proposal(best, "replace", "duplicate", F.col("b.rendered"), "delta", F.col("b.base_id"))


def exact_dedup(segments: DataFrame, ctx: Context) -> DataFrame:
    """Later copies of an earlier text, of whatever kinds both are."""
    rows = segments.where(F.col("kind").isin(DEDUP_KINDS)).select(*KEY, "position", F.sha2("text", 256).alias("content"))
    first = rows.groupBy("session_id", "content").agg(F.min("position").alias("first"))
    return _proposal(rows.join(unbounded(first), ["session_id", "content"]).where("position > first"), "drop", "duplicate")


def json_compaction(segments: DataFrame, ctx: Context) -> DataFrame:
    rows = segments.where("kind <> 'file_read'").where(F.regexp_replace("text", r"^\s+", "").rlike(r"^[\[{]")).select(*KEY, "token_count", codecs.json_crush("text").alias("rendered"))
    rows = rows.where(F.col("rendered").isNotNull()).where(token_count(F.col("rendered")) < F.col("token_count"))
    return _proposal(rows, "replace", "duplicate", F.col("rendered"), "json_columnar")


def log_compaction(segments: DataFrame, ctx: Context) -> DataFrame:
    lines = F.regexp_count("text", F.lit("\n")) >= codecs.LEAST_LINES - 1
    rows = segments.where("kind <> 'file_read'").where(lines & F.try_parse_json("text").isNull()).select(*KEY, "token_count", codecs.log_crush("text").alias("rendered"))
    rows = rows.where(F.col("rendered").isNotNull()).where(token_count(F.col("rendered")) < F.col("token_count"))
    return _proposal(rows, "replace", "duplicate", F.col("rendered"), "log_columnar")


def segment_symbols(segments: DataFrame) -> DataFrame:
    """session_id, seg_id, symbol: the distinct symbols of each segment."""
    return segments.select(*KEY, F.explode(symbols(F.col("text"))).alias("symbol"))


def relevance_closure(segments: DataFrame, task: str) -> DataFrame:
    """session_id, seg_id of segments that share a symbol with the task, or with a segment that does, and so on.

    Each turn joins the symbols not yet met with those of the segments met last; it ends when no segment is new.
    """
    known = written(segment_symbols(segments))
    return spread(known, written(known.where(F.col("symbol").isin(sorted(symbols_of(task)))).select(*KEY).distinct()))


def spread(known: DataFrame, newest: DataFrame) -> DataFrame:
    """newest(session_id, seg_id) and all that it reaches through shared symbols of known(session_id, seg_id, symbol), a written table that goes."""
    met = written(newest)
    while not newest.isEmpty():
        reached = known.join(unbounded(newest), KEY, "left_semi").select("session_id", "symbol").distinct()
        newest = written(known.join(unbounded(reached), ["session_id", "symbol"], "left_semi").select(*KEY).distinct().join(unbounded(met), KEY, "left_anti"))
        both = written(met.union(newest))
        discard(met)
        met = both
    discard(known)
    return met


def relevance(segments: DataFrame, ctx: Context) -> DataFrame:
    """Older droppable segments outside the closure of the task; nothing without symbols of a task."""
    if not symbols_of(ctx.task):
        return segments.sparkSession.createDataFrame([], PROPOSAL)
    rows = older(segments, segments.where(F.col("kind").isin(DROPPABLE_KINDS)).select(*KEY, "position"), ctx.options.get("relevance_keep", 6))
    return _proposal(rows.join(unbounded(relevance_closure(segments, ctx.task)), KEY, "left_anti"), "drop", "irrelevant")


def relevance_by_session(segments: DataFrame, how: DataFrame) -> DataFrame:
    """As relevance, with a task and a recency of its own for each session: how(session_id, task, keep); keep null: the session is left alone."""
    asked = how.where("keep is not null").select("session_id", "keep", symbols(F.col("task")).alias("wanted")).where(F.size("wanted") > 0)
    asked = written(asked)
    known = written(segment_symbols(segments.join(unbounded(asked.select("session_id")), "session_id", "left_semi")))
    seeds = asked.select("session_id", F.explode("wanted").alias("symbol"))
    newest = written(known.join(unbounded(seeds), ["session_id", "symbol"], "left_semi").select(*KEY).distinct())
    met = spread(known, newest)
    old = segments.where(F.col("kind").isin(DROPPABLE_KINDS)).select(*KEY, "position").join(unbounded(asked.select("session_id", "keep")), "session_id")
    old = old.join(unbounded(last_positions(segments)), "session_id").where(F.col("last_position") - F.col("position") >= F.col("keep"))
    return _proposal(old.join(unbounded(met), KEY, "left_anti"), "drop", "irrelevant")


def reasoning_prune(segments: DataFrame, ctx: Context) -> DataFrame:
    """Older reasoning without a conclusion."""
    rows = segments.where("kind = 'reasoning_trace'").where(~has_conclusion(F.col("text"))).select(*KEY, "position")
    return _proposal(older(segments, rows, ctx.options.get("reasoning_keep", 3)), "drop", "evicted")


def embedding_salience(segments: DataFrame, ctx: Context) -> DataFrame:
    """Older droppable segments whose embedding is far from the task's; opt-in."""
    import numpy as np

    wanted = " ".join(sorted(symbols_of(ctx.task)))
    least = ctx.options.get("least_similarity", 0.1)
    if not wanted:
        return segments.sparkSession.createDataFrame([], PROPOSAL)
    query = hash_embedding(wanted)

    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def similarity(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(np.dot(hash_embedding(t or ""), query)))

    rows = older(segments, segments.where(F.col("kind").isin(DROPPABLE_KINDS)).select(*KEY, "position", "text"), ctx.options.get("relevance_keep", 6))
    return _proposal(rows.where(similarity("text") < least), "drop", "irrelevant")


STRUCTURAL: list[Pass] = [supersession, file_delta, envelope_dedup, exact_dedup, json_compaction, log_compaction]
QUERY: list[Pass] = [relevance, reasoning_prune]
