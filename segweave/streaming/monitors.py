"""Monitors of a session's turns: a streak of poor cache hits halts it, a jump of its output tokens makes it back off.

Both are folds over a session's turns in order. In batch they are native: the streak by gaps and islands, the moving
average by an aggregate over the session's sorted turns. As streams they keep a session's few numbers as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STREAK, ALPHA, FACTOR, WARM_UP, ADAPT = 3, 0.3, 1.75, 2, 5


def halted_turns(turns: DataFrame, floor: Column | float, streak: int = STREAK) -> DataFrame:
    """turns(session_id, turn, hit_rate) with below_run and halted: whether streak turns in a row had been below the floor by then.

    A turn without a hit rate changes nothing. A halt is for good.
    """
    by = Window.partitionBy("session_id").orderBy("turn")
    seen = F.col("hit_rate").isNotNull()
    good = F.coalesce(seen & (F.col("hit_rate") >= floor), F.lit(False))
    rows = turns.withColumn("island", F.sum(good.cast("int")).over(by)).withColumn("low", (seen & ~good).cast("int"))
    run = F.sum("low").over(Window.partitionBy("session_id", "island").orderBy("turn"))
    rows = rows.withColumn("below_run", run.cast("int"))
    return rows.withColumn("halted", F.max((F.col("below_run") >= streak).cast("int")).over(by) == 1).drop("island", "low")


def spiking_turns(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn, output_tokens) with baseline (after the turn) and spiking.

    A session's turns are folded as one array of pairs of numbers; their texts take no part.
    """
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", F.col("output_tokens").cast("double").alias("out"))))
    start = F.struct(F.lit(None).cast("double").alias("baseline"), F.lit(0).alias("n"), F.lit(0).alias("run"), F.array().cast("array<struct<turn:int,baseline:double,spiking:boolean>>").alias("done"))

    def fold(s: Column, t: Column) -> Column:
        over = F.coalesce((s["n"] >= WARM_UP) & (t["out"] > s["baseline"] * FACTOR), F.lit(False))
        run = F.when(over, s["run"] + 1).otherwise(0)
        shifted = over & (run >= ADAPT)
        base = F.when(over & ~shifted, s["baseline"]).otherwise(F.coalesce(t["out"] * ALPHA + s["baseline"] * (1 - ALPHA), t["out"]))
        row = F.struct(t["turn"].cast("int").alias("turn"), base.alias("baseline"), (over & ~shifted).alias("spiking"))
        return F.struct(base.alias("baseline"), (s["n"] + 1).alias("n"), run.alias("run"), F.concat(s["done"], F.array(row)).alias("done"))

    done = turns.groupBy("session_id").agg(F.aggregate(sorted_turns, start, fold)["done"].alias("done"))
    return done.select("session_id", F.inline("done"))


def observe_output(state: tuple, out: float) -> tuple[tuple, bool]:
    """One turn of the output monitor: state (baseline or None, turns, run of spikes) -> new state and whether it spikes."""
    baseline, n, run = state
    over = baseline is not None and n >= WARM_UP and out > baseline * FACTOR
    run = run + 1 if over else 0
    shifted = over and run >= ADAPT
    if not over or shifted:
        baseline = out if baseline is None else ALPHA * out + (1 - ALPHA) * baseline
    return (baseline, n + 1, run), over and not shifted


def monitor_stream(turns: DataFrame, floor: float, ttl_ms: int = 0) -> DataFrame:
    """A stream of turns(session_id, turn, hit_rate, output_tokens) with halted and spiking as after each turn.

    Within a micro-batch a session's turns are taken in order of turn. ttl_ms, if not 0, forgets sessions that long idle.
    """
    schema = "session_id string, turn int, halted boolean, spiking boolean"
    state_schema = "below int, halted boolean, baseline double, n int, run int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        below, halted, baseline, n, run = state.get if state.exists else (0, False, None, 0, 0)
        rows = []
        for turn in pd.concat(frames).sort_values("turn").itertuples():
            if turn.hit_rate is not None and turn.hit_rate == turn.hit_rate:
                below = below + 1 if turn.hit_rate < floor else 0
                halted = halted or below >= STREAK
            (baseline, n, run), spiking = observe_output((baseline, n, run), float(turn.output_tokens))
            rows.append((key[0], int(turn.turn), bool(halted), bool(spiking)))
        state.update((int(below), bool(halted), baseline, int(n), int(run)))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=["session_id", "turn", "halted", "spiking"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy("session_id").applyInPandasWithState(step, schema, state_schema, "append", timeout)
