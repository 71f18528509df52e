"""The engine of a session that goes on: what earlier turns ran and read is known when the next is planned."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .passes import Context, Pass
from .planner import make_plan, report


@dataclass(frozen=True)
class SessionState:
    """registry(session_id, tool_class, latest_turn); files(session_id, path, text, version): the latest read of each file."""

    registry: DataFrame
    files: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> SessionState:
        return SessionState(spark.createDataFrame([], "session_id string, tool_class string, latest_turn int"), spark.createDataFrame([], "session_id string, path string, text string, version long"))

    def after(self, segments: DataFrame) -> SessionState:
        """The state once the segments of a turn are recorded; reading a file again raises its version.

        Both tables are written, so a turn costs what it and the state hold, however many turns came before.
        """
        runs = segments.where("kind = 'tool_output'").select("session_id", "tool_class", F.col("turn").alias("latest_turn"))
        registry = self.registry.unionByName(runs).groupBy("session_id", "tool_class").agg(F.max("latest_turn").alias("latest_turn"))
        reads = segments.where("kind = 'file_read' and path is not null").groupBy("session_id", "path").agg(F.max_by("text", "position").alias("text"), F.count("*").alias("n"))
        both = self.files.withColumnsRenamed({"text": "old", "version": "was"}).join(reads, ["session_id", "path"], "full")
        files = both.select("session_id", "path", F.coalesce("text", "old").alias("text"), (F.coalesce("was", F.lit(-1)) + F.coalesce("n", F.lit(0))).cast("long").alias("version"))
        return replace(self, registry=written(registry), files=written(files))


def plan_turn(state: SessionState, segments: DataFrame, task: str = "", budget: int | None = None, passes: list[Pass] | None = None) -> tuple[DataFrame, SessionState]:
    """(plan, next state) of one more turn's segments."""
    now = state.after(segments)
    return make_plan(segments, task, budget, passes, Context(task, registry=now.registry)), now


def frozen_prefix(segments: DataFrame) -> DataFrame:
    """session_id, prefix_hash: of each session's frozen texts in order; a change means that the cache is cold."""
    texts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return segments.where("mutation_class = 'frozen'").groupBy("session_id").agg(F.sha2(F.array_join(F.transform(texts, lambda t: t["text"]), "\x1f"), 256).alias("prefix_hash"))


def latest_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


class SessionStore:
    """A session state for each micro-batch below a shared folder; a batch that is run again reads what it read before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, batch: int) -> str:
        return f"{self.path}/state/{batch}"

    def load(self, before: int) -> SessionState:
        """The state that the batch before left; the empty one for the first."""
        empty = SessionState.empty(self.spark)
        if before <= 0:
            return empty
        read = lambda name, df: self.spark.read.schema(df.schema).parquet(f"{self._at(before - 1)}/{name}")
        return SessionState(read("registry", empty.registry), read("files", empty.files))

    def save(self, batch: int, state: SessionState) -> None:
        state.registry.write.mode("overwrite").parquet(f"{self._at(batch)}/registry")
        state.files.write.mode("overwrite").parquet(f"{self._at(batch)}/files")

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/reports")


def plan_stream(segments: DataFrame, store: SessionStore, checkpoint: str, task: str = "", passes: list[Pass] | None = None):
    """A writer that plans each micro-batch of a stream of segments against the state of all before, and keeps reports and state.

    Reports of a batch overwrite those of an earlier try of it.
    """

    def turn(batch: DataFrame, number: int) -> None:
        batch = written(batch)
        plan, state = plan_turn(store.load(number), batch, task, passes=passes)
        report(plan).write.mode("overwrite").parquet(f"{store.path}/reports/batch={number}")
        store.save(number, state)

    return segments.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint)
