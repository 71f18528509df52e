"""What the two searches share: valid vectors, bounded samples, and joins of query blocks with data units.

Data rows lie in units (a cell's ring, an inverted list) and queries name the units that they need. A unit with many rows
is dealt into parts, queries into blocks, so one task meets at most CHUNK rows with QUERY_BLOCK queries, however hot a
unit or a vector is. Each such meeting gives a query's best rows of the part, and the best of all parts are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, QUERY_BLOCK = 8192, 8192
#: Rows of a bounded sample, taken in order of a hash of their ids.
SAMPLE = 16_384


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, v (array<double>) of rows whose vectors are whole: not null or empty, all components finite; zero: zero vectors stay.

    Rows that repeat an id are rows of their own; rows with a null id, which no result could name, are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(vector_col, lambda x: x.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, finite)
    if not zero:
        ok = ok & F.exists(vector_col, lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def with_rows(vectors: DataFrame) -> DataFrame:
    """vectors with row, a number that tells rows apart; to be written before it is read twice."""
    return vectors.withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(lists.flatten(), kind)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), kind)
    for i, (end, n) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
        out[i, :n] = flat[end - n : end]
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows' bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(0, (len(rows) + 1) * width, max(width, 1), dtype=np.int32)[: len(rows) + 1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pd.Series, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def sample(vectors: DataFrame, dim: int, n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, the same for the same table."""
    return matrix(vectors.orderBy(F.xxhash64("id", "v"), "id", "v").limit(n).select("v").toArrow().column("v"), dim)


def row_batches(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores the places of its k largest, ties to the smaller place; places beyond a row's finite ones may follow."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    # The k-th largest bounds the candidates; ties at it are resolved by place.
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    out = np.empty((len(scores), k), np.int64)
    for i, (row, bound) in enumerate(zip(scores, kth, strict=True)):
        at = np.flatnonzero(row >= bound)
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def search_units(data: DataFrame, queries: DataFrame, units: DataFrame, local: Callable, k: int, score_type: str, carry: list[str]) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: each query's k best rows of the units that it names.

    data(unit, id, row, vec, *carry), queries(id, row, block, vec, units array<int>[, least]), units(unit, n). local(pandas data in
    order of id, pandas queries) -> (query numbers, data numbers, scores) of at least each query's k best rows of the part.
    """
    parts = units.select("unit", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    need = queries.select(F.col("block").alias("to"), F.explode("units").alias("unit")).distinct()
    rows = data.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).join(need, "unit")
    rows = rows.select(F.col("to").alias("block"), "unit", "part", "id", "row", "vec", *carry)
    more = [c for c in queries.columns if c == "least"]
    asks = queries.select("block", F.col("id").alias("qid"), F.col("row").alias("qrow"), F.col("vec").alias("qvec"), *more, F.explode("units").alias("unit"))
    asks = asks.join(parts, "unit").select("block", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "qrow", "qvec", *more)

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_row": np.empty(0, np.int64), "query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64 if score_type == "long" else np.float64)})
        mine = mine.sort_values(["id", "row"])
        q, d, s = local(mine, theirs)
        return pd.DataFrame({"query_row": theirs["qrow"].to_numpy()[q], "query_id": theirs["qid"].to_numpy()[q], "vec_id": mine["id"].to_numpy()[d], "score": s})

    keys = ["block", "unit", "part"]
    met = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, f"query_row long, query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def block_of(cell: Column, blocks: dict[int, tuple[int, int]], key: Column) -> Column:
    """The query block of a cell: blocks[cell] = (first block, number of blocks that the cell's queries are dealt to)."""
    at = F.create_map(*[x for c, (first, n) in blocks.items() for x in (F.lit(c), F.struct(F.lit(first).alias("first"), F.lit(n).alias("n")))])
    b = F.try_element_at(at, cell)
    return (b["first"] + F.pmod(F.xxhash64(key), b["n"])).cast("int")


def deal_blocks(counts: dict[int, int], most: int = QUERY_BLOCK) -> dict[int, tuple[int, int]]:
    """Blocks of at most about most queries from neighbouring cells; a cell with more has blocks of its own."""
    out, block, size = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if size and size + n > most:
            block, size = block + 1, 0
        own = max(1, -(-n // most))
        out[cell] = (block, own)
        if own > 1:
            block, size = block + own, 0
        else:
            size += n
    return out
