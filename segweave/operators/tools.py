"""Tools that an agent calls: transforms that keep the originals of what they shorten, to be looked up again."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import content_id, token_count
from . import transforms

#: What follows a shortened text.
EXPANDABLE = "\n[full original available by expand, id={}]"


def call_tools(calls: DataFrame) -> DataFrame:
    """calls(call_id, tool, content[, path, task, max_field, max_rows]) with id, result and short (whether it was shortened).

    tool: skeletonize, compact_lossy, slim_schema, telegraphic, compact_html, compact_csv or deref_images; a text that a tool
    doesn't shorten comes back as it was, without an id. An unknown tool gives a null result.
    """
    has = lambda n, other: F.col(n) if n in calls.columns else F.lit(other)
    by_name = {
        "skeletonize": transforms.skeleton_text("content", has("path", "")),
        "compact_lossy": transforms.lossy_by_row("content", has("task", ""), has("max_field", 0), has("max_rows", 0)),
        "slim_schema": transforms.schema_text("content"), "telegraphic": transforms.telegraphic_text("content"), "compact_html": transforms.html_text("content"),
        "compact_csv": transforms.csv_udf()("content"), "deref_images": transforms.images_text("content"),
    }
    out = None
    for tool, made in by_name.items():
        rows = calls.where(F.col("tool") == tool).select("call_id", "tool", "content", made.alias("made"))
        out = rows if out is None else out.unionByName(rows)
    out = out.unionByName(calls.where(~F.col("tool").isin(list(by_name)) | F.col("tool").isNull()).select("call_id", "tool", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("made")))
    short = F.col("made").isNotNull()
    before, after = EXPANDABLE.split("{}")
    number = content_id(F.col("content"))
    result = F.when(short, F.concat("made", F.lit(before), number, F.lit(after))).otherwise(F.col("content"))
    return out.select("call_id", "tool", "content", "made", F.when(short, number).alias("id"), result.alias("result"), short.alias("short"))


def originals(called: DataFrame) -> DataFrame:
    """id, text of what call_tools() shortened, each once."""
    return called.where("short").groupBy("id").agg(F.min("content").alias("text"))


def expand(asked: DataFrame, store: DataFrame, strict: bool = False) -> DataFrame:
    """asked(id, ...) with text from the store of originals; an unknown id has null and an error, or with strict ends the job."""
    rows = asked.join(store.select("id", "text"), "id", "left")
    unknown = F.concat(F.lit("unknown id "), F.col("id"), F.lit(": nothing was shortened under it"))
    if strict:
        return rows.withColumn("text", F.coalesce("text", F.raise_error(unknown).cast("string")))
    return rows.withColumn("error", F.when(F.col("text").isNull(), unknown))


def savings(called: DataFrame) -> DataFrame:
    """saved_in, saved_out, saved, pct, retrievable: one row over all that was shortened."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("short"), token_count(F.col(c)))), F.lit(0)).cast("long")
    s = called.agg(n("content").alias("saved_in"), n("made").alias("saved_out"), F.count_distinct("id").alias("retrievable"))
    saved = F.greatest(F.col("saved_in") - F.col("saved_out"), F.lit(0))
    return s.select("saved_in", "saved_out", saved.alias("saved"), F.when(F.col("saved_in") > 0, F.round(100.0 * saved / F.col("saved_in"), 6)).otherwise(0.0).alias("pct"), "retrievable")


def or_as_it_was(transform: Callable[[Column], Column], text: Column) -> Column:
    """transform(text), and the text itself where the transform gives nothing."""
    return F.coalesce(transform(text), text)


def shell(command: list[str], seconds: float = 30.0) -> Callable[[Column], Column]:
    """A column function that sends each text through a command's input and takes its output; a failing command changes nothing."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=seconds)
            except (OSError, subprocess.TimeoutExpired):
                return text
            return done.stdout if done.returncode == 0 and done.stdout else text

        return texts.map(one)

    return run


def probe(command: list[str]) -> bool:
    """Whether the command runs here and gives something back."""
    try:
        done = subprocess.run(command, input="probe", capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return False
    return done.returncode == 0 and bool(done.stdout)
