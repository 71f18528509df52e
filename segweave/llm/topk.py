"""Exact top-k search by a Voronoi kNN join.

Largest inner products become nearest neighbours: a data vector gets one more component, the root of M - |x|^2 with M the
largest |x|^2, a query gets 0 there. Then |q - x|^2 = |q|^2 + M - 2 q.x. Data and queries are grouped by their nearest
pivot, and each cell is cut into rings by distance to its pivot. From counts and bounds of the rings alone each query gets
a distance within which k rows must lie, and by the triangle inequality it needs only rings that reach into it; only those
rings' rows are copied to the query's block. The groups are then solved exactly on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import best_rows, block_of, deal_blocks, matrix, packed, row_batches, sample, search_units, unpacked, valid_vectors, with_rows

K, QUERY_STEP, RINGS = 5, 50, 4
#: Rows for each pivot, and the least and most pivots.
ROWS_A_PIVOT, PIVOTS = 4096, (8, 1024)


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, or all if fewer: the first, then always the one farthest from those chosen."""
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        at = int(far.argmax())
        if far[at] == 0:
            break
        chosen.append(at)
        far = np.minimum(far, ((points - points[at]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def needed_rings(to_pivots: np.ndarray, cell: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, slack: float) -> list[np.ndarray]:
    """For each row of distances to the pivots the rings that may hold one of its k nearest; rings given by cell, count and distances to the pivot."""
    d = to_pivots[:, cell]
    farthest = d + high[None, :]
    order = np.argsort(farthest, axis=1)
    held = np.cumsum(count[order], axis=1)
    # The query's own row may be among those counted.
    enough = np.minimum((held < k + 1).sum(axis=1), len(cell) - 1)
    within = np.take_along_axis(farthest, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
    within = np.where(held[:, -1] < k + 1, np.inf, within)
    nearest = np.maximum(np.maximum(d - high[None, :], low[None, :] - d), 0)
    return [np.flatnonzero(row) for row in nearest <= within[:, None] * (1 + 1e-9) + slack]


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by step, its k largest integer inner products with other rows.

    Components x count as floor(256 x). Vectors that are null, empty or hold null or non-finite components take no part,
    nor do null ids; rows that repeat an id are queries and candidates of their own. Shorter vectors end in zeros. Ties go to
    the smaller id; with fewer rows than k there are fewer ranks; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    whole = valid_vectors(rows, id_col, vector_col, zero=True).select("id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    whole = scratch.write(with_rows(whole))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("m"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    n, dim, m = facts.n, facts.dim or 1, facts.m or 0.0
    # Products of smaller integers are exact in doubles.
    kind = np.float64 if (facts.most or 0) ** 2 * dim < 2**53 else np.int64
    lifted = lambda x: np.column_stack((x, np.sqrt(np.maximum(m - (x.astype(np.float64) ** 2).sum(axis=1), 0))))
    flat = lambda x: np.column_stack((x, np.zeros(len(x))))
    seen = lifted(sample(whole, dim))
    pivots = choose_pivots(seen, min(max(n // ROWS_A_PIVOT, PIVOTS[0]), PIVOTS[1])) if n else np.zeros((1, dim + 1))
    reach = float(np.sqrt(m)) * 2 + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            x = matrix(batch.column("v"), dim, kind)
            d = distances(lifted(x), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell]), packed(x)], names=["id", "row", "cell", "away", "vec"])

    placed = scratch.write(whole.mapInArrow(assign, "id long, row long, cell int, away double, vec binary"))
    # Rings of a cell: equal steps between its nearest and farthest row.
    spans = placed.groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far"))
    ring = F.least(F.floor((F.col("away") - F.col("near")) / F.greatest((F.col("far") - F.col("near")) / RINGS, F.lit(1e-9))), F.lit(RINGS - 1)).cast("int")
    ringed = placed.join(spans, "cell").select("id", "row", "vec", "away", "cell", (F.col("cell") * RINGS + ring).alias("unit"))
    units = ringed.groupBy("unit", "cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    units = scratch.write(units)
    summary = units.orderBy("unit").toPandas()  # at most RINGS rows for each pivot
    cell, count, low, high = (summary[c].to_numpy() for c in ("cell", "n", "low", "high"))
    numbers = summary["unit"].to_numpy()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            x = matrix(batch.column("v"), dim, kind)
            d = distances(flat(x), pivots)
            need = [numbers[u].astype(np.int32) for u in needed_rings(d, cell, count, low, high, k, reach * 1e-7)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(d.argmin(axis=1), pa.int32()), packed(x), pa.array(need, pa.list_(pa.int32()))], names=["id", "row", "cell", "vec", "units"])

    asked = scratch.write(whole.where(F.col("id") % step == 0).mapInArrow(ask, "id long, row long, cell int, vec binary, units array<int>"))
    blocks = deal_blocks({r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}) or {0: (0, 1)}
    queries = asked.select("id", "row", block_of(F.col("cell"), blocks, F.col("row")).alias("block"), "vec", "units")

    def local(mine: pd.DataFrame, theirs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, ids = unpacked(mine["vec"], dim, kind), mine["row"].to_numpy()
        q, own = unpacked(theirs["qvec"], dim, kind), theirs["qrow"].to_numpy()
        out_q, out_d, out_s = [], [], []
        for at in range(0, len(q), 512):
            s = (q[at : at + 512] @ x.T).astype(np.float64 if kind is np.float64 else np.int64)
            mask = own[at : at + 512, None] == ids[None, :]
            least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
            s = np.where(mask, least, s)
            best = best_rows(s, k)
            row = np.repeat(np.arange(len(s)), best.shape[1])
            column = best.ravel()
            good = ~mask[row, column]
            out_q.append(row[good] + at)
            out_d.append(column[good])
            out_s.append(s[row, column][good].astype(np.int64))
        return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_s)

    return search_units(ringed.select("unit", "id", "row", "vec"), queries, units.select("unit", "n"), local, k, "long", []).drop("query_row")
