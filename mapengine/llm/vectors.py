"""Whole-number vectors, and searches of a query set against all rows, block by block.

Rows are dealt to blocks and queries to groups, both by a hash of their id, and a task gets one
block and one group. What is shuffled is every row once for each group and every query once for
each block; both sizes are parameters, so a task's memory is bounded however many rows share a
label, a vector or a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapengine.llm.common import stored

Task = Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]

BLOCK_ROWS = 8192
GROUP_ROWS = 4096

# Whole numbers up to this are exact in a double, and so is any sum that stays below it.
_EXACT = 2.0**53


def taking_part(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """``id``, ``vector`` and, where asked for, ``label`` of the rows that take part, stored.

    Rows without an id, a vector or an asked label, and vectors with a NULL or non-finite
    component, take no part. Of rows that share an id the smallest (vector, label) counts.
    """
    asked = [F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")]
    if label is not None:
        asked.append(F.col(f"`{label}`").cast("long").alias("label"))
    rows = embeddings.select(*asked).dropna().where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    least = F.min(F.struct(*[c for c in rows.columns if c != "id"]))
    return stored(rows.groupBy("id").agg(least.alias("row")).select("id", "row.*"), "vectors")


def matrix(vectors: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * x) of every component, x as double; short vectors are filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are while every product sum is exact in a double, else as Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    if most < _EXACT:
        return queries, rows
    whole = np.vectorize(int, otypes=[object])
    return tuple(whole(m) if m.size else m.astype(object) for m in (queries, rows))


def both(queries: pa.Table, rows: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a task as two exact matrices of one width."""
    q, x = matrix(queries["vector"], scale), matrix(rows["vector"], scale)
    width = max(q.shape[1], x.shape[1])
    fill = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x)]
    return exact(*fill)


def in_blocks(
    queries: DataFrame, rows: DataFrame, task: Task, schema: str, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """What ``task`` gives for every block of ``rows`` with every group of ``queries``.

    Both are stored tables with ``id``; a group or block of no rows gives nothing.
    """
    blocks = max(1, math.ceil(rows.count() / block_rows))
    groups = max(1, math.ceil(queries.count() / group_rows))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.expr(f"cast(pmod(xxhash64(id), {parts}) as int)")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = dealt(queries, "group", groups, "block", blocks).groupBy("block", "group")
    right = dealt(rows, "block", blocks, "group", groups).groupBy("block", "group")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(task(left, right)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(found, arrow) if found else arrow.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)
    return left.cogroup(right).applyInArrow(run, schema)


def first(found: DataFrame, by: list[str], k: int, id_: str) -> DataFrame:
    """The first ``k`` of each ``by``: highest score first, ties by smaller id, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(id_))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(key: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of every key, keys ascending, best first."""
    order = np.lexsort((ids, -scores, key))
    own = key[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k]
