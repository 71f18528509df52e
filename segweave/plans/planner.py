"""From proposals to a sound plan within a budget, and from a plan to what is emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, symbols
from ..operators import codecs
from ..operators.transforms import symbols_of
from ..shared import discard, unbounded, written
from .passes import QUERY, STRUCTURAL, Context, Pass, segment_symbols
from .segments import KEY

ACTION_TOKENS = "CASE action WHEN 'keep' THEN token_count WHEN 'replace' THEN new_tokens ELSE 0 END"
FUTURE, FREQUENT = 1_000_000_000, 100_000


def resolve(segments: DataFrame, proposals: list[DataFrame]) -> DataFrame:
    """The plan: of several proposals for a segment that of the latest pass, else keep."""
    every = None
    for n, p in enumerate(proposals):
        p = p.withColumn("pass_no", F.lit(n))
        every = p if every is None else every.unionByName(p)
    rows = segments.select(*KEY, "position", "stability_rank", "mutation_class", "token_count")
    if every is None:
        none = lambda kind: F.lit(None).cast(kind)
        return rows.select("*", F.lit("keep").alias("action"), none("string").alias("reason"), none("string").alias("rendered"), none("int").alias("new_tokens"), none("string").alias("reconstruct"), none("long").alias("base_id"))
    last = every.groupBy(*KEY).agg(F.max_by(F.struct("action", "reason", "rendered", "new_tokens", "reconstruct", "base_id"), "pass_no").alias("p"))
    return rows.join(unbounded(last), KEY, "left").select(*rows.columns, F.coalesce("p.action", F.lit("keep")).alias("action"), "p.reason", "p.rendered", "p.new_tokens", "p.reconstruct", "p.base_id")


def _kept(plan: DataFrame, revert) -> DataFrame:
    """plan with the rows where revert holds turned back to keep."""
    back = F.coalesce(revert, F.lit(False))
    gone = lambda c: F.when(~back, F.col(c)).alias(c)
    return plan.select(*[F.when(back, "keep").otherwise(F.col(c)).alias(c) if c == "action" else gone(c) if c in ("reason", "rendered", "new_tokens", "reconstruct", "base_id") else F.col(c) for c in plan.columns])


def enforce(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with unsound actions turned back to keep: on frozen segments, replacements that save nothing or can't be undone, deltas whose base goes.

    Turning back only adds kept rows, so one look for missing bases settles them all. The plan is written before its
    replacements are judged, as all passes would else stand in one query twice.
    """
    plan = proposed = written(_kept(plan, (F.col("mutation_class") == "frozen") & (F.col("action") != "keep")))
    replaced = plan.where("action = 'replace'").select(*KEY, "rendered", "reconstruct", "base_id")
    texts = segments.select(*KEY, "text")
    bases = segments.select("session_id", F.col("seg_id").alias("base_id"), F.col("text").alias("base_text"))
    judged = replaced.join(unbounded(texts), KEY).join(unbounded(bases), ["session_id", "base_id"], "left")
    delta_ok = codecs.apply_delta("base_text", "rendered").eqNullSafe(F.col("text"))
    sound = F.when(F.col("reconstruct") == "delta", delta_ok).otherwise(codecs.round_trips("text", "rendered"))
    lossless = judged.select(*KEY, F.coalesce(sound, F.lit(False)).alias("lossless"))
    plan = plan.join(unbounded(lossless), KEY, "left")
    plan = _kept(plan, (F.col("action") == "replace") & ((F.col("new_tokens") >= F.col("token_count")) | ~F.coalesce("lossless", F.lit(False)))).drop("lossless")
    plan = written(plan)
    discard(proposed)
    there = plan.where("action = 'keep'").select("session_id", F.col("seg_id").alias("base_id"), F.lit(True).alias("base_kept"))
    plan = plan.join(unbounded(there), ["session_id", "base_id"], "left")
    out = _kept(plan, (F.col("reconstruct") == "delta") & F.col("base_kept").isNull())
    return out.select(*[c for c in plan.columns if c not in ("base_kept",)])


def coreference(known: DataFrame) -> DataFrame:
    """session_id, seg_id, frequency: other segments that share a symbol, of known(session_id, seg_id, symbol).

    A symbol's holders are one long for each 64 neighbouring segments that hold some, a rare symbol's a few numbers; what a
    segment meets is the union of its symbols' longs, so no pair of segments is ever a row.
    """
    bit = F.expr("shiftleft(1L, int(pmod(seg_id, 64)))")
    holders = known.groupBy("session_id", "symbol", F.expr("seg_id div 64").alias("block")).agg(F.bit_or(bit).alias("holders"))
    unions = known.join(holders, ["session_id", "symbol"]).groupBy(*KEY, "block").agg(F.bit_or("holders").alias("m"))
    return unions.groupBy(*KEY).agg((F.sum(F.bit_count("m")) - 1).alias("frequency"))


def priorities(segments: DataFrame, task: str, tasks: DataFrame | None = None) -> DataFrame:
    """session_id, seg_id, future_need, frequency, priority of every segment; tasks(session_id, task): tasks of their own."""
    known = written(segment_symbols(segments))
    summaries = segments.where("kind = 'compact_summary'").select(*KEY)
    plans = known.join(summaries, KEY, "left_semi").select("session_id", "symbol")
    if tasks is None:
        asked = known.where(F.col("symbol").isin(sorted(symbols_of(task)))).select(*KEY)
    else:
        asked = known.join(tasks.select("session_id", F.explode(symbols(F.col("task"))).alias("symbol")), ["session_id", "symbol"], "left_semi").select(*KEY)
    needed = asked.union(known.join(plans.distinct(), ["session_id", "symbol"], "left_semi").select(*KEY)).distinct().withColumn("future_need", F.lit(1))
    rows = segments.select(*KEY, "position").join(needed, KEY, "left").join(coreference(known), KEY, "left")
    rows = rows.select(*KEY, "position", F.coalesce("future_need", F.lit(0)).alias("future_need"), F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
    return rows.withColumn("priority", F.col("future_need") * F.lit(FUTURE).cast("long") + F.col("frequency") * FREQUENT + F.col("position"))


def evict(segments: DataFrame, plan: DataFrame, task: str, budget: int, floor: float = 0.0) -> DataFrame:
    """The plan with segments of the least priority dropped while a session is over its budget; frozen ones stay.

    floor raises a session's budget to that share of its tokens.
    """
    return _evicted(plan, priorities(segments, task), budget, floor)


def evict_by_session(segments: DataFrame, plan: DataFrame, tasks: DataFrame, budget: int, floor: float = 0.0) -> DataFrame:
    """As evict, with a task of its own for each session: tasks(session_id, task)."""
    return _evicted(plan, priorities(segments, "", tasks), budget, floor)


def _evicted(plan: DataFrame, ranks: DataFrame, budget: int, floor: float) -> DataFrame:
    totals = plan.groupBy("session_id").agg(F.sum(F.expr(ACTION_TOKENS)).alias("net"), F.sum("token_count").alias("input"))
    limit = F.greatest(F.lit(budget), F.ceil(F.col("input") * floor)) if floor else F.lit(budget)
    over = totals.select("session_id", "net", limit.alias("budget")).where("net > budget")
    tokens = F.expr(ACTION_TOKENS)
    rows = plan.where("mutation_class <> 'frozen' and action <> 'drop'").select(*KEY, tokens.alias("tokens")).join(ranks.select(*KEY, "priority"), KEY).join(over, "session_id")
    before = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("priority", "seg_id").rowsBetween(Window.unboundedPreceding, -1))
    gone = rows.withColumn("before", F.coalesce(before, F.lit(0))).where("net - before > budget").select(*KEY, F.lit(True).alias("gone"))
    out = plan.join(gone, KEY, "left")
    away = F.coalesce("gone", F.lit(False))
    return out.select(*[F.when(away, {"action": "drop", "reason": "evicted"}.get(c)).otherwise(F.col(c)).alias(c) if c in ("action", "reason") else F.when(~away, F.col(c)).alias(c) if c in ("rendered", "new_tokens", "reconstruct", "base_id") else F.col(c) for c in plan.columns])


def make_plan(segments: DataFrame, task: str = "", budget: int | None = None, passes: list[Pass] | None = None, ctx: Context | None = None, floor: float = 0.0, strict: bool = False) -> DataFrame:
    """The plan of the passes, sound and within the budget.

    strict looks for missing bases once more after evicting, and so never leaves a delta without its base, at the price of
    going over the budget.
    """
    ctx = ctx or Context(task)
    ctx.task = ctx.task or task
    segments = written(segments)  # every pass reads the columns that it needs of one table
    plan = enforce(segments, resolve(segments, [p(segments, ctx) for p in (STRUCTURAL + QUERY if passes is None else passes)]))
    if budget is not None:
        plan = evict(segments, plan, ctx.task, budget, floor)
        if strict:
            plan = enforce(segments, plan)
    return plan


def emit(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """session_id, ordinal, seg_id, text, tokens of what survives: frozen, slow, fast, each in order of position."""
    actions = plan.select(*KEY, "action")
    keys = segments.select(*KEY, "position", "stability_rank").join(actions, KEY, "left").where(F.coalesce("action", F.lit("keep")) != "drop")
    order = Window.partitionBy("session_id").orderBy("stability_rank", "position")
    ordered = keys.select(*KEY, "action", (F.row_number().over(order) - 1).alias("ordinal"))
    rows = ordered.join(segments.select(*KEY, "text", "token_count"), KEY).join(plan.where("action = 'replace'").select(*KEY, "rendered", "new_tokens"), KEY, "left")
    new = F.coalesce(F.col("action") == "replace", F.lit(False))
    return rows.select("session_id", "ordinal", "seg_id", F.when(new, F.col("rendered")).otherwise(F.col("text")).alias("text"), F.when(new, F.col("new_tokens")).otherwise(F.col("token_count")).alias("tokens"))


def joined_context(emitted: DataFrame) -> DataFrame:
    """session_id, context: the survivors of each session in order, a line of three dashes between."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return emitted.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n---\n").alias("context"))


def report(plan: DataFrame) -> DataFrame:
    """session_id, input_tokens, net_tokens, kept, dropped, replaced, ratio."""
    counts = [F.count_if(F.col("action") == a).alias(n) for a, n in (("keep", "kept"), ("drop", "dropped"), ("replace", "replaced"))]
    out = plan.groupBy("session_id").agg(F.sum("token_count").alias("input_tokens"), F.sum(F.expr(ACTION_TOKENS)).alias("net_tokens"), *counts)
    return out.withColumn("ratio", F.round(ratio(F.col("net_tokens"), F.col("input_tokens")), 6))


def dropped(plan: DataFrame) -> DataFrame:
    """session_id, seg_id, reason of what goes, to be listed beside the report."""
    return plan.where("action = 'drop'").select(*KEY, "reason")


def naive_truncation(segments: DataFrame, budget: int) -> DataFrame:
    """session_id, seg_id of the most recent segments that fit a budget; the last always stays, and the first that doesn't fit ends it."""
    recent = Window.partitionBy("session_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.select(*KEY, "position", F.sum("token_count").over(recent).alias("upto"), F.max("position").over(Window.partitionBy("session_id")).alias("last"))
    return rows.where((F.col("upto") <= budget) | (F.col("position") == F.col("last"))).select(*KEY)


def compress(segments: DataFrame, task: str = "", budget: int | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(emitted, report) of the whole pipeline."""
    plan = written(make_plan(segments, task, budget, **how))
    return emit(segments, plan), report(plan)
