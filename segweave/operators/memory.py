"""A deduplicated memory of texts with provenance, as two tables: memories(id, content, content_hash, created_at) and provenance(memory_id, source)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMORIES = "id long, content string, content_hash string, created_at timestamp"
PROVENANCE = "memory_id long, source string"


@dataclass(frozen=True)
class Memory:
    memories: DataFrame
    provenance: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Memory:
        return Memory(spark.createDataFrame([], MEMORIES), spark.createDataFrame([], PROVENANCE))

    @staticmethod
    def read(spark: SparkSession, path: str) -> Memory:
        return Memory(spark.read.schema(MEMORIES).parquet(f"{path}/memories"), spark.read.schema(PROVENANCE).parquet(f"{path}/provenance"))

    def write(self, path: str) -> None:
        """Into a folder other than the one that it was read from."""
        self.memories.write.mode("overwrite").parquet(f"{path}/memories")
        self.provenance.write.mode("overwrite").parquet(f"{path}/provenance")

    def remember(self, items: DataFrame) -> Memory:
        """With items(content, source, ord): a content that is known keeps its id and gains the source; new ones get ids in order of ord.

        Ids come from the number of new contents before each range of ord: only counts meet in one task.
        """
        hashed = items.withColumn("content_hash", F.sha2("content", 256))
        new = hashed.groupBy("content_hash").agg(F.min_by("content", "ord").alias("content"), F.min("ord").alias("ord")).join(self.memories.select("content_hash"), "content_hash", "left_anti")
        # One row: the highest id so far.
        top = self.memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        numbered = numbered_by(new, "ord").crossJoin(F.broadcast(top)).select((F.col("number") + F.col("top")).alias("id"), "content", "content_hash", F.current_timestamp().alias("created_at"))
        memories = self.memories.unionByName(numbered)
        sources = hashed.select("content_hash", "source").distinct().join(memories.select("content_hash", F.col("id").alias("memory_id")), "content_hash").select("memory_id", "source")
        return Memory(memories, self.provenance.unionByName(sources).distinct())

    def recall(self, query: str, limit: int) -> DataFrame:
        """id, content, score, sources: contents by how many of the query's words they hold, newest first among equals; no query: the newest."""
        words = query.lower().split()
        held = F.lower("content")
        score = sum((F.contains(held, F.lit(w)).cast("int") for w in words), F.lit(0))
        rows = self.memories.select("id", "content", score.alias("score"))
        rows = (rows.where("score > 0") if words else rows).orderBy(F.desc("score"), F.desc("id")).limit(limit)
        sources = self.provenance.groupBy(F.col("memory_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
        return rows.join(sources, "id", "left").withColumn("sources", F.coalesce("sources", F.lit(""))).orderBy(F.desc("score"), F.desc("id"))

    def forget(self, ids: DataFrame) -> Memory:
        """Without the memories of ids(id), and what names them."""
        return Memory(self.memories.join(ids, "id", "left_anti"), self.provenance.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"))

    def stats(self) -> DataFrame:
        """memories, sources: how many there are of each."""
        both = self.memories.select(F.lit(1).alias("one"), F.lit(None).cast("string").alias("source")).unionByName(self.provenance.select(F.lit(None).cast("int").alias("one"), "source"))
        return both.agg(F.count("one").alias("memories"), F.count_distinct("source").alias("sources"))


def numbered_by(rows: DataFrame, key: str, span: int = 10_000) -> DataFrame:
    """rows with number: their rank by a whole-numbered key from 1, by counts of spans of it."""
    part = F.floor(F.col(key) / span)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return rows.withColumn("part", part).withColumn("at", inside).join(before, "part").withColumn("number", F.col("before") + F.col("at")).drop("part", "at", "before")
