"""Grouped statistics behind the encodings and the reports, over rows of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import lines_of, output_category, ratio, token_count


def modal(rows: DataFrame, by: list[str], value: Column, name: str = "value") -> DataFrame:
    """by, name, n: the most frequent value of each group, of several the smallest, and how often it occurs."""
    counts = rows.groupBy(*by, value.alias(name)).agg(F.count("*").alias("n"))
    least = F.min(F.struct((-F.col("n")).alias("less"), F.col(name)))
    return counts.groupBy(*by).agg(least.alias("m")).select(*by, F.col(f"m.{name}").alias(name), (-F.col("m.less")).alias("n"))


def constant_columns(rows: DataFrame, by: str, columns: list[str], least: int = 3) -> DataFrame:
    """by and, of each group of at least so many rows, for each column whether it has one value throughout."""
    same = [(F.min(c) == F.max(c)).alias(f"{c}_constant") for c in columns]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *same).where(F.col("n") >= least).drop("n")


def split_row(row: Column, mark: str) -> Column:
    """The cells of a delimited row; quotes mean nothing, empty cells count."""
    return F.split(row, "\\Q" + mark + "\\E", -1)


def dominant_fields(texts: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """key, width, n: into how many fields most lines fall that have at least so many, of several widths the smallest."""
    lines = texts.select(key, F.explode(lines_of(F.col(text))).alias("line")).select(key, F.size(split_row(F.col("line"), " ")).cast("long").alias("width"))
    return modal(lines.where(F.col("width") >= least), [key], F.col("width"), "width")


def constant_fields(texts: DataFrame, key: str, text: str, widths: DataFrame, least: int = 3) -> DataFrame:
    """key, place, value: fields that are the same in all lines of the dominant width, where there are at least so many."""
    fields = texts.select(key, F.explode(lines_of(F.col(text))).alias("line")).select(key, split_row(F.col("line"), " ").alias("f"))
    rows = fields.join(widths.where(F.col("n") >= least), key).where(F.size("f") == F.col("width")).select(key, F.posexplode("f").alias("place", "value"))
    same = rows.groupBy(key, F.col("place").cast("long").alias("place")).agg(F.min("value").alias("value"), F.max("value").alias("other"))
    return same.where("value = other").drop("other")


def boundary(rows: DataFrame, by: list[str], order: str, n: int = 3) -> DataFrame:
    """The first and the last n rows of each group."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("from_start", F.row_number().over(w.orderBy(order))).withColumn("from_end", F.row_number().over(w.orderBy(F.desc(order))))
    return numbered.where((F.col("from_start") <= n) | (F.col("from_end") <= n)).drop("from_start", "from_end")


def omission_runs(rows: DataFrame, by: list[str], order: str, keep: Column) -> DataFrame:
    """by, after_kept, omitted: each longest run of rows that aren't kept, by how many kept ones stand before it."""
    island = F.sum(keep.cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*by, island.alias("after_kept"), keep.alias("kept")).where("not kept").groupBy(*by, "after_kept").agg(F.count("*").alias("omitted"))


def saved_by_category(rows: DataFrame, text: str, short: str) -> DataFrame:
    """category, n, mean: the mean share of tokens that is saved, by category of the output."""
    saved = 1 - ratio(token_count(F.col(short)), token_count(F.col(text)))
    return rows.select(output_category(F.col(text)).alias("category"), saved.alias("saved")).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("saved"), 6).alias("mean"))
