"""Exact top-k search by inner product: aggregation of sorted lists without random access.

Each task holds a block of rows and a group of queries. The block keeps one list per component,
its rows sorted by that component. A query reads a list from the top where its own component is
positive and from the bottom where it is negative, so the products come in descending order. All
lists are read in turn to a growing depth. What has been read bounds every row's score:

* upper bound: what was read, and, where a row was not met yet, the last product read;
* lower bound: what was read, and, where a row was not met yet, the list's smallest product.

A query stops when at most ``RESOLVED`` rows of the block can still reach its k-th best score:
all other rows are outsiders. Only then are the scores of those rows resolved. Bounds of all
queries of a group come from the same entries read, as two products of matrices. The k-th best
score found in one part of a block bounds the parts after it, and the first k of every block are
merged by a window that is limited before its shuffle.

Rows without an id, NULL vectors and vectors with a NULL or non-finite component take no part;
of rows that share an id the smallest vector counts, so (query_id, rank) is a key. Shorter
vectors count as filled with zeros, an empty one scores 0. Ties go to the smaller id. Fewer than k
candidates give fewer rows; an empty table gives none. Extra columns are not read. Scores must
fit 64 bits, else the job stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.llm import vectors

# Rows whose lists are sorted together, and queries whose bounds are computed together.
PART_ROWS = 2048
PART_QUERIES = 256
# Shares of the lists that are read before the bounds are looked at.
DEPTHS = (0.5, 0.75, 0.9, 1.0)
# Rows of a part that may be resolved for one query once all others are out.
RESOLVED = 64

_FOUND = "query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of a part of a block, read from both ends to a growing depth."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, axis=0)
        self.lowest, self.highest = self.sorted[0], self.sorted[-1]
        # Entries met so far: from the top for positive query components, from the bottom for negative ones.
        self.top_met, self.bottom_met = np.zeros(rows.shape, bool), np.zeros(rows.shape, bool)
        self.depth = 0

    def read(self, depth: int) -> None:
        """Reads on in every list up to ``depth`` entries."""
        columns = np.arange(self.rows.shape[1])[None, :]
        self.top_met[self.order[self.n - depth : self.n - self.depth], columns] = True
        self.bottom_met[self.order[self.depth : depth], columns] = True
        self.depth = depth
        self.last_top, self.last_bottom = self.sorted[self.n - depth], self.sorted[depth - 1]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every query's score with every row."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)

        def summed(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
            return up @ np.where(self.top_met, self.rows, top).T + down @ np.where(self.bottom_met, self.rows, bottom).T

        return summed(self.lowest, self.highest), summed(self.last_top, self.last_bottom)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; nothing is known where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    if scores.dtype == object:
        return np.sort(scores, axis=1)[:, -k]
    return np.partition(scores, -k, axis=1)[:, -k]


def _in_part(
    query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of rows and scores of all that may be among the first k.

    ``known`` is a score that k rows of other parts are known to reach.
    """
    lists, open_, out = Lists(rows), np.arange(len(queries)), []
    for share in DEPTHS:
        lists.read(max(1, int(share * len(rows))))
        waiting = []
        for at in range(0, len(open_), PART_QUERIES):
            own = open_[at : at + PART_QUERIES]
            lower, upper = lists.bounds(queries[own])
            itself = query_ids[own][:, None] == ids[None, :]
            lower[itself] = -np.inf
            may = (upper >= np.maximum(known[own], _kth(lower, k))[:, None]) & ~itself
            done = (may.sum(1) <= RESOLVED) | (lists.depth == len(rows))
            q, r = np.nonzero(may & done[:, None])
            out.append((own[q], r, (queries[own[q]] * rows[r]).sum(1)))
            waiting.append(own[~done])
        open_ = np.concatenate(waiting) if waiting else open_
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query ids, row ids and scores of the first k rows of every query, its own row left out."""
    place, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    known = np.full(len(queries), -np.inf, rows.dtype)
    for at in range(0, len(rows), PART_ROWS):
        part = slice(at, at + PART_ROWS)
        q, r, s = _in_part(query_ids, queries, known, ids[part], rows[part], k)
        place, found, score = np.r_[place, q], np.r_[found, ids[part][r]], np.r_[score, s]
        keep = vectors.best(place, found, score, k)
        place, found, score = place[keep], found[keep], score[keep]
        full = np.flatnonzero(np.bincount(place, minlength=len(queries)) == k)
        last = np.searchsorted(place, full, side="right") - 1
        known[full] = score[last]
    return query_ids[place], found, score


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    block_rows: int = vectors.BLOCK_ROWS,
    group_rows: int = vectors.GROUP_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of every query, by exact inner product.

    ``is_query`` is a condition on ``id``. Components are floor(scale * x).
    """
    rows = vectors.taking_part(embeddings)

    def task(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        queries, own = vectors.both(left, right, scale)
        found = search(left["id"].to_numpy(), queries, right["id"].to_numpy(), own, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(x) for x in c] if c.dtype == object else c.astype(np.int64), pa.int64()) for c in found],
            ["query_id", "vec_id", "score"])

    found = vectors.in_blocks(rows.where(is_query), rows, task, _FOUND, block_rows, group_rows)
    return vectors.first(found, ["query_id"], k, "vec_id").select("query_id", "rank", "vec_id", "score")
